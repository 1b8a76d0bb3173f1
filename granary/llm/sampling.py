"""The bounded sample of labelled rows that a classifier is fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a classifier is fitted on, at most about this many; the rows are chosen by a hash of their id.
FIT_ROWS = 20_000


def held_out(id_: Column, modulus: int, remainder: int) -> Column:
    """Rows that no label is learnt from. A null id counts as held out."""
    return F.coalesce(F.crc32(id_.cast("string")) % modulus == remainder, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, held: Column, limit: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """text, label of about `limit` labelled documents that are not held out (all, if there are fewer).

    Null labels are left out; of several labels of a document the largest counts. The sample's ids are broadcast: 16 bytes
    for each of `limit` rows.
    """
    known = labels.filter(F.col(label_col).isNotNull() & ~held).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("label"))
    share = min(1.0, limit / max(1, known.count()))
    chosen = known.filter(F.pmod(F.xxhash64(F.lit(7), F.col("__id")), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.join(F.broadcast(chosen), "__id").select("text", "label")
