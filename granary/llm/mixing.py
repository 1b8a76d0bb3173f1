"""Mixing sources to target weights.

Every document gets a hash-random key. Within its source the documents stand in key order, and a document is taken as far
as the source's budget reaches in that order; a budget above the source's size starts whole epochs anew. The order is cut
into key ranges, so that a source of any size is spread over many tasks: the sums of the ranges are summed up first
(a few rows per source), then each range adds its own prefix sums. The number of ranges changes no result.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import WORD, materialise, n_words, with_rows

#: Weights by the sources' rank, repeating.
WEIGHTS = (5, 2, 1)
#: The mix takes 1.5 times all sizes; a source gives 2 times its size at most.
SHARE, MOST_EPOCHS = 1.5, 2
RANGE_ROWS = 2_000
KEY_BITS = 52


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size -> target as well. One row per source comes in, so this is small.

    A target is weight * level, but stops at most_epochs * source_size. In order of cap / weight the first
    source whose cap exceeds what the rest can still share fixes the level.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.select("source", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * most_epochs).alias("cap"))
    all_rows, order = Window.partitionBy(), Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.lit(share) * F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    levels = ranked.withColumn("level", left / F.sum("weight").over(after))
    level = F.min(F.when(F.col("weight") * F.col("level") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(all_rows)["level"]
    capped = F.col("cap").cast("double")
    return levels.select("source", "source_size", F.coalesce(F.least(capped, F.col("weight") * level), capped).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42, range_rows: int = RANGE_ROWS, weights=WEIGHTS, share: float = SHARE, most_epochs: int = MOST_EPOCHS, row_col: str | None = None) -> DataFrame:
    """One row per row of docs: id, size, source_size, target, taken.

    size is the number of words (null text: 0), taken the words that the mix takes of the document, repeats counted. The
    document at which the budget ends gives the part up to it. A null source is a source like any other, ranked last.
    Ties in the random key are broken by id and size, so reruns agree whatever the partitioning; rows equal in all of these
    are interchangeable. row_col, a number of each row, breaks these ties as well and is returned too. Other columns are not read. An empty table gives an empty result; an empty source has target 0.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    key = F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")
    rows = materialise(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), key.alias("key"), *([F.col(row_col).alias("row")] if row_col else [])))
    ranges = max(1, -(-rows.count() // range_rows))
    rows = rows.withColumn("part", F.floor(F.col("key") / F.lit(2.0**KEY_BITS) * ranges))
    parts = rows.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    targets = source_targets(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, share, most_epochs)
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("source", "part", F.coalesce(F.sum("part_size").over(earlier), F.lit(0)).alias("start")).alias("p")
    starts = starts.join(targets.alias("t"), F.expr("p.source <=> t.source")).select("p.*", "source_size", "target").alias("s")
    within = Window.partitionBy("r.source", "r.part").orderBy("r.key", F.col("r.id").asc_nulls_first(), "r.size", *(["r.row"] if row_col else [])).rowsBetween(Window.unboundedPreceding, -1)
    inner = rows.alias("r").withColumn("inside", F.coalesce(F.sum("r.size").over(within), F.lit(0))).alias("r")
    budget = F.floor(F.col("target"))
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size") - F.col("start") - F.col("inside")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    rows = inner.join(starts, F.expr("r.source <=> s.source AND r.part = s.part"))
    own = [F.col("r.row").alias(row_col)] if row_col else []
    return rows.select(F.col("r.id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"), *own)


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str = "n_chars", placed: bool = False, **how) -> DataFrame:
    """The mix itself, with the columns of docs: each row as often as it is taken whole, and once more with its first words where a budget
    ends inside it. chars_col, if docs has it, then counts what is left. Documents without words are in no mix. Ids may be null or stand in
    several rows; each row is planned and taken by itself. `placed`: see with_rows().
    """
    known = with_rows(docs, "__row", placed)
    plan = mix(known, id_col, text_col, source_col, row_col="__row", **how).filter("taken > 0")
    plan = plan.select("__row", F.floor(F.col("taken") / F.col("size")).cast("int").alias("__whole"), (F.col("taken") % F.col("size")).cast("int").alias("__part"))
    part = F.when(F.col("__part") > 0, F.array(F.col("__part"))).otherwise(F.array().cast("array<int>"))
    rows = known.join(plan, "__row").withColumn("__words", F.explode(F.concat(F.array_repeat(F.lit(0), F.col("__whole")), part)))
    head = F.concat_ws("", F.slice(F.regexp_extract_all(F.col(text_col), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), 1, F.col("__words")))
    cut = {text_col: F.when(F.col("__words") > 0, head).otherwise(F.col(text_col))}
    if chars_col in docs.columns:
        cut[chars_col] = F.when(F.col("__words") > 0, F.length(head).cast(docs.schema[chars_col].dataType)).otherwise(F.col(chars_col))
    return rows.withColumns(cut).select(*docs.columns)


def oracle_sql(seed: int = 42, weights=WEIGHTS, share: float = SHARE, most_epochs: int = MOST_EPOCHS) -> str:
    """DuckDB SQL for mix() over documents."""
    return f"""
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '{WORD}')) END AS size,
  ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, {KEY_BITS // 4}))::BIGINT AS key FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
weighed AS (SELECT source, source_size, ([{", ".join(map(str, weights))}])[(k % {len(weights)} + 1)::INT] AS weight, source_size * {most_epochs} AS cap FROM sources),
levels AS (SELECT *, ({share}::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
chosen AS (SELECT level FROM levels WHERE weight * level <= cap ORDER BY cap / weight, level LIMIT 1),
targets AS (SELECT source, source_size, coalesce(least(cap::DOUBLE, weight * (SELECT level FROM chosen)), cap::DOUBLE) AS target FROM levels),
placed AS (SELECT d.*, source_size, target, floor(target)::BIGINT AS budget, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
epochs AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM placed)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken FROM epochs"""
