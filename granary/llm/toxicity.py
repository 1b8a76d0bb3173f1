"""Toxicity: a factorization machine over hashed terms.

Each term of a text is hashed into one of BINS bins. Besides a weight, every bin has a small vector, and the
product of two bins' vectors is the weight of their meeting in one text: an insult beside the mention of a group can
weigh more than the two apart, which a sum of weights can't express.

All bins of the fitted rows are candidates, but most are words of single authors and places. A bin stays at zero as long as neither its weight nor
its vector would gain more from the rows than chance gives (SINGLE and PAIR standard deviations of the gradient at zero). The bins that would
are freed and fitted, and the gradients of all others are taken anew, now with the freed bins' vectors as partners, until none is left.
So a term without an effect of its own enters as soon as its meetings with another have one; there is no bound on how many enter.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from granary.functions.batches import bounded_batches
from granary.llm.sampling import FIT_ROWS, held_out, labelled_sample

BINS = 1 << 20
TERM = re.compile(r"\w+")
#: Gradients at zero that free a bin, in standard deviations: of its weight, and of its vector (of several numbers).
SINGLE, PAIR = 4.5, 6.5


def term_bins(text: str) -> np.ndarray:
    """The distinct bins of a whole text's terms, lower-cased."""
    terms = set(TERM.findall(text.lower()))
    return np.unique(np.fromiter((zlib.crc32(x.encode("utf-8", "replace")) for x in terms), np.uint32, len(terms)) % BINS).astype(np.int32)


@dataclass
class Machine:
    bins: np.ndarray  # those that aren't zero, ascending
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        if not len(self.bins) or not docs:
            return np.full(len(docs), 1 / (1 + np.exp(-self.bias)))
        at = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        flat = np.concatenate(docs)
        place = np.searchsorted(self.bins, flat).clip(0, len(self.bins) - 1)
        hit = self.bins[place] == flat
        return forward(at[hit], place[hit], len(docs), self.bias, self.weight, self.factor)[0]


def forward(at: np.ndarray, place: np.ndarray, n: int, bias: float, weight: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of n documents and the sums of their vectors. at, place: document and bin of each occurrence."""
    sums = np.stack([np.bincount(at, v[place], n) for v in factor.T], 1)
    z = bias + np.bincount(at, weight[place], n) + 0.5 * ((sums**2).sum(1) - np.bincount(at, (factor**2).sum(1)[place], n))
    return 1 / (1 + np.exp(-z.clip(-50, 50))), sums


def fit(docs: list[np.ndarray], y: np.ndarray, k: int = 6, steps: int = 120, rate: float = 0.05, l2: float = 2e-4, seed: int = 5) -> Machine:
    """Without rows, or with one class only, a constant with smoothing."""
    n, bias = len(docs), float(np.log((y.sum() + 1) / ((1 - y).sum() + 1)))
    if not n or y.min() == y.max() or not sum(map(len, docs)):
        return Machine(np.empty(0, np.int32), bias, np.empty(0), np.empty((0, k)))
    rng = np.random.default_rng(seed)
    bins, flat = np.unique(np.concatenate(docs), return_inverse=True)
    owner, size = np.repeat(np.arange(n), [len(d) for d in docs]), len(bins)
    free, weight, factor = np.zeros(size, bool), np.zeros(size), np.zeros((size, k))
    while True:
        held = free[flat]
        p, sums = forward(owner[held], flat[held], n, bias, weight, factor)
        miss, spread = y - p, p * (1 - p)
        single = np.abs(np.bincount(flat, miss[owner], size)) / np.sqrt(np.bincount(flat, spread[owner], size) + 1e-9)
        toward = sum(np.bincount(flat, (miss * s)[owner], size) ** 2 for s in sums.T)
        pair = np.sqrt(toward / (np.bincount(flat, (spread * (sums**2).sum(1))[owner], size) + 1e-9))
        new = ~free & ((single > SINGLE) | (pair > PAIR))
        if not new.any():
            return Machine(bins[free], bias, weight[free], factor[free])
        free |= new
        factor[new] = rng.normal(0, 0.05, (int(new.sum()), k))
        number, held = np.cumsum(free) - 1, free[flat]
        bias, weight[free], factor[free] = _descend(owner[held], number[flat[held]], y, (bias, weight[free], factor[free]), steps, rate, l2)


def _descend(at: np.ndarray, place: np.ndarray, y: np.ndarray, start: tuple, steps: int, rate: float, l2: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Adam on the logistic loss of all rows."""
    params = [np.atleast_1d(np.asarray(x, float)) for x in start]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        bias, weight, factor = params
        p, sums = forward(at, place, len(y), bias[0], weight, factor)
        g = (p - y) / len(y)
        own = np.bincount(place, g[at], len(weight))
        paired = np.stack([np.bincount(place, (g * s)[at], len(weight)) for s in sums.T], 1)
        grads = [g.sum(keepdims=True), own + l2 * weight, paired - own[:, None] * factor + l2 * factor]
        for i, d in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * d
            v[i] = 0.99 * v[i] + 0.01 * d**2
            params[i] = params[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    return float(params[0][0]), params[1], params[2]


@pandas_udf(T.BinaryType())
def bins_of(texts: pd.Series) -> pd.Series:
    return pd.Series([term_bins(x or "").tobytes() for x in texts])


def train(docs: DataFrame, labels: DataFrame, held: Column, label_col: str = "toxic", limit: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Machine:
    """Fits on at most about `limit` labelled documents; only their term bins reach the driver."""
    bounded_batches(docs.sparkSession)
    rows = labelled_sample(docs, labels, label_col, held, limit, id_col, text_col).select(bins_of("text").alias("x"), "label").toPandas()
    return fit([np.frombuffer(x, np.int32) for x in rows["x"]], rows["label"].to_numpy(dtype=float))


def scorer(machine: Machine):
    """Column -> Column: the probability of label 1 of each text."""

    @pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(machine.score([term_bins(x or "") for x in texts]), dtype="float64")

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = FIT_ROWS, modulus: int = 4, remainder: int = 2, least: float = 0.3) -> DataFrame:
    """One row per row of docs: id, held_out, score, predicted.

    A null text is scored as an empty one. Labels are read only of rows that are not held out; lang, source and ids are no inputs
    of a score. Rows repeated get equal scores. Without usable labels each score is one half. Whole texts are read, however long. A score of
    exactly `least` is predicted as 1. An empty table gives an empty result. Other columns are not read, so their names can't clash.
    """
    machine = train(docs, labels, held_out(F.col(id_col), modulus, remainder), limit=limit, id_col=id_col, text_col=text_col)
    scored = docs.select(F.col(id_col), held_out(F.col(id_col), modulus, remainder).alias("held_out"), scorer(machine)(F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= least).cast("int"))
