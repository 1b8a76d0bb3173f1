"""Quality classifier: histogram gradient-boosted trees over document statistics.

Training bins each statistic at quantiles and grows the trees level by level from histograms of gradients. The finished
trees are flattened into five arrays, so that scoring walks all trees of a batch of documents at once in numpy.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from granary.functions.batches import bounded_batches
from granary.llm.sampling import FIT_ROWS, held_out, labelled_sample

N_STATS = 21
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def document_stats(text: str) -> np.ndarray:
    """Statistics of a whole text; all zero for an empty one."""
    out = np.zeros(N_STATS)
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n, size = len(words), len(raw)
    if not n:
        out[0] = size
        return out
    of = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in text.split("\n") if x]
    distinct = len(set(words))
    share = of[of > 0] / size
    marks = of[33:48].sum() + of[58:65].sum() + of[91:97].sum() + of[123:127].sum()
    out[:] = (
        size, n, lengths.mean(), lengths.std(), lengths.max(), distinct / n, distinct / np.sqrt(n), len(lines), n / max(1, len(lines)), len(set(lines)) / max(1, len(lines)),
        of[_LETTERS].sum() / size, of[48:58].sum() / size, of[65:91].sum() / size, of[128:].sum() / size, marks / n, of[list(b"#*$%&")].sum() / n, of[list(b"|<>")].sum() / n, of[list(b".!?")].sum() / n,
        (of[32] + of[9:14].sum()) / size, -(share * np.log2(share)).sum(), (lengths <= 3).mean(),
    )
    return out


@dataclass
class Trees:
    """All trees end to end. Leaves point to themselves. A row goes left where its statistic is at most the threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        at = np.repeat(self.roots[None, :], len(x), 0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x).clip(-50, 50)))


def fit(x: np.ndarray, y: np.ndarray, n_trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 2.0, least: float = 5.0) -> Trees:
    """Gradient boosting of the logistic loss. Without rows, or with one class only, a constant with smoothing."""
    base = float(np.log((y.sum() + 1) / ((1 - y).sum() + 1)))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    if not len(y) or y.min() == y.max():
        n_trees = 0
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins)[1:-1])) for f in range(x.shape[1])] if n_trees else []
    codes = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1) if n_trees else None
    raw = np.full(len(y), base)
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        root = len(feature)
        roots.append(root)
        node = np.full(len(y), root)
        level = [root]
        feature.append(0), threshold.append(np.inf), left.append(root), right.append(root), value.append(0.0)
        for _ in range(depth):
            width = len(level)
            slot = np.full(len(feature), -1)
            slot[level] = np.arange(width)
            live = np.flatnonzero(slot[node] >= 0)
            if not len(live):
                break
            cell = (slot[node[live]][:, None] * x.shape[1] + np.arange(x.shape[1])) * bins + codes[live]
            shape, total = (width, x.shape[1], bins), width * x.shape[1] * bins
            g, h = (np.bincount(cell.ravel(), np.repeat(a[live], x.shape[1]), total).reshape(shape) for a in (grad, hess))
            gl, hl = g.cumsum(2)[:, :, :-1], h.cumsum(2)[:, :, :-1]
            gt, ht = g.sum(2)[:, :1, None], h.sum(2)[:, :1, None]
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(hl < least * 0.1) | (ht - hl < least * 0.1)] = -1
            following = []
            for k, at in enumerate(level):
                f, b = np.unravel_index(gain[k].argmax(), gain[k].shape)
                if gain[k, f, b] <= 1e-9 or b >= len(edges[f]):
                    continue
                mine = np.flatnonzero(node == at)
                goes = codes[mine, f] <= b
                for side in (goes, ~goes):
                    new = len(feature)
                    rows = mine[side]
                    feature.append(0), threshold.append(np.inf), left.append(new), right.append(new)
                    value.append(float(-rate * grad[rows].sum() / (hess[rows].sum() + l2)))
                    node[rows] = new
                    following.append(new)
                feature[at], threshold[at], left[at], right[at], value[at] = f, edges[f][b], following[-2], following[-1], 0.0
            level = following
        raw = raw + np.array(value)[node]
    if not roots:
        feature, threshold, left, right, value, roots = [0], [np.inf], [0], [0], [0.0], [0]
    return Trees(*map(np.array, (feature, threshold, left, right, value, roots)), depth, base)


@pandas_udf(T.ArrayType(T.DoubleType()))
def stats_array(texts: pd.Series) -> pd.Series:
    return pd.Series([document_stats(x or "") for x in texts])


def train(docs: DataFrame, labels: DataFrame, held: Column, label_col: str = "quality", limit: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Trees:
    """Fits on at most about `limit` labelled documents; only their statistics reach the driver."""
    bounded_batches(docs.sparkSession)
    rows = labelled_sample(docs, labels, label_col, held, limit, id_col, text_col).select(stats_array("text").alias("x"), "label").toPandas()
    x = np.stack(rows["x"].to_list()) if len(rows) else np.zeros((0, N_STATS))
    return fit(x, rows["label"].to_numpy(dtype=float))


def scorer(trees: Trees):
    """Column -> Column: the probability of label 1 of each text."""

    @pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(trees.score(np.stack([document_stats(x or "") for x in texts])) if len(texts) else [], dtype="float64")

    return score


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = FIT_ROWS, modulus: int = 3, remainder: int = 1, least: float = 0.5) -> DataFrame:
    """One row per row of docs: id, held_out, score, predicted.

    A null text is scored as an empty one. Labels are read only of rows that are not held out; lang, source and ids are no inputs
    of a score. Rows repeated get equal scores. Without usable labels each score is one half. Whole texts are read, however long. A score of
    exactly `least` is predicted as 1. An empty table gives an empty result. Other columns are not read, so their names can't clash.
    """
    trees = train(docs, labels, held_out(F.col(id_col), modulus, remainder), limit=limit, id_col=id_col, text_col=text_col)
    scored = docs.select(F.col(id_col), held_out(F.col(id_col), modulus, remainder).alias("held_out"), scorer(trees)(F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= least).cast("int"))
