"""Exact deduplication by content-defined chunk recipes.

Each text is cut where its content says so (at the first line or sentence end after CHUNK_MIN characters), so equal texts
have equal cuts. A chunk gets a 128-bit identifier; one distributed pass over the distinct chunks verifies that no two
different chunks share one, and takes other hash seeds if they do. From then on a text is its recipe, the ordered list of
identifiers, and texts are compared by recipe: the long texts themselves are never moved, and of the chunks one copy
of each at most leaves a task.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import ascii_lower, materialise, with_rows

CHUNK_MIN, CHUNK_MAX = 256, 4096
#: A hot group of copies is counted and joined in so many parts.
SALTS = 64


def chunks(text: Column, least: int = CHUNK_MIN, most: int = CHUNK_MAX) -> Column:
    """Content-defined chunks of a text, in order; their concatenation is the text."""
    cut = rf"(?s).{{{least},{most - 1}}}?(?:[.\n]|\z)|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(cut), F.lit(0))


def chunk_id(chunk: Column, seed: int) -> Column:
    """Two independent 64-bit hashes."""
    return F.array(F.xxhash64(F.lit(2 * seed), chunk), F.xxhash64(F.lit(2 * seed + 1), chunk))


def verified_seed(texts: DataFrame, make_id=chunk_id, tries: int = 8) -> int:
    """The first seed under which all distinct chunks of `text` have distinct identifiers."""
    found = texts.select(F.explode(chunks(F.col("text"))).alias("chunk")).distinct()
    for seed in range(tries):
        shared = found.groupBy(make_id(F.col("chunk"), seed).alias("id")).count().filter("count > 1")
        if shared.isEmpty():
            return seed
    raise ValueError(f"chunks share identifiers under each of {tries} seeds")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", make_id=chunk_id) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The largest id of a group stays. Other
    columns are not read, so their names can't clash. Rows repeated with one id each count in group_size and share
    the verdict of that id. A null id never stays unless its group has no other id. An empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).alias("id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    seed = verified_seed(texts, make_id)
    recipe = F.flatten(F.transform(chunks(F.col("text")), lambda c: make_id(c, seed)))
    rows = materialise(texts.select("id", recipe.alias("recipe"), F.sha2("text", 256).alias("text_sha256"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")))
    parts = rows.groupBy("recipe", "salt").agg(F.max("id").alias("most"), F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy("recipe")
    parts = parts.select("recipe", "salt", F.max("most").over(group).alias("keep_id"), F.sum("n").over(group).alias("group_size"))
    return rows.join(parts, ["recipe", "salt"]).select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeats: bool = True, placed: bool = False) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Rows are judged one by one, so a null id or an id of two texts costs no other row. Rows that repeat the id that stays for their text
    stay with it, as deduplicate() judges them; without `repeats` one of them stays, a single row of each text. `placed`: see with_rows().
    """
    rows = with_rows(docs, "__row", placed)
    key = F.struct(F.col(id_col).alias("id"), F.col("__row").alias("row")).alias("__key")
    found = deduplicate(rows.select(key, F.col(text_col).alias("text")), "__key")
    stay = found.filter(F.col("__key.id").eqNullSafe(F.col("keep_id.id")) if repeats else F.col("kept"))
    return rows.join(stay.select(F.col("__key.row").alias("__row")), "__row", "left_semi").select(*docs.columns)
