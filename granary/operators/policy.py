"""Which entries of an archive may be extracted, as column expressions: nothing outside the target folder, no links, no devices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_DEPTH = 32


def lowest_depth(path: Column) -> Column:
    """How deep under the target the path leads at its lowest; below 0 it leaves the target."""
    step = lambda p: F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least"))
    move = lambda a, p: F.struct((a["depth"] + step(p)).alias("depth"), F.least(a["least"], a["depth"] + step(p)).alias("least"))
    return F.aggregate(F.split(path, "/"), start, move)["least"]


def depth(path: Column) -> Column:
    return F.size(F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))) - 1


def violation(path: Column, kind: Column, allow_symlinks: bool = False, allow_special: bool = False, allow_absolute: bool = False, max_depth: int = MAX_DEPTH) -> Column:
    """Why an entry is refused; null if it isn't. Dots inside a name (a..b) are harmless."""
    expr = F.when(F.lit(not allow_absolute) & path.startswith("/"), "absolute path").when(lowest_depth(path) < 0, "path traversal")
    expr = expr.when(F.lit(max_depth > 0) & (depth(path) > max_depth), "too deep")
    return expr.when(F.lit(not allow_symlinks) & (kind == "symlink"), "symlink").when(F.lit(not allow_special) & (kind == "special"), "special file")
