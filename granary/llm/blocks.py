"""Blocks of documents, and helpers for the hashes that several of them share.

Documents are dealt by id into blocks of a few MB of text, so that numpy works on whole blocks. A block gives each of its distinct hashes
once, with the number of its documents that hold it, as plain rows; Spark counts them over all blocks. So the rows grow in
step with the input, and a hash that is everywhere has a row for each block and not for each document.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 4 << 20


def n_blocks(total_bytes: int) -> int:
    """A power of two, so that leading bits tell the bucket."""
    return 1 << max(2, (max(0, total_bytes - 1) // BLOCK_BYTES).bit_length())


def block_of(id_: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(blocks)).cast("int")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bucket_shift(buckets: int) -> np.uint64:
    return np.uint64(64 - (buckets.bit_length() - 1))


#: Tasks that the rows of a hot key are spread over; a mask of 64 bits tells which of them hold the key.
SALTS = 64


def group_min(df: DataFrame, keys: list[str], value: Column, out: str) -> DataFrame:
    """df with the least value of each key as column `out`; a hot key is spread over SALTS tasks."""
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(value), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy(*keys).agg(F.min(value).alias(out), F.bit_or(F.expr("shiftleft(1L, __salt)")).alias("__salts"))
    held = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda k: F.getbit("__salts", k) == 1)
    parts = parts.select(*keys, out, F.explode(held).alias("__salt"))
    return salted.join(parts, [*keys, "__salt"]).drop("__salt")
