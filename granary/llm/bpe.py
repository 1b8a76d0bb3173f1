"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A task takes a block of documents, cuts them into pieces by the tokenizer's pattern and keeps each distinct piece of the
block once, all of them end to end in one array of symbols with links to the neighbours. An inverted index leads from the
token that a pair would become to the positions of that pair. Merges are then replayed over the whole block in rank order:
the lowest rank that has positions is applied to all of them in one array operation, and only the touched neighbours
are looked up anew and enter the index. Every piece thus sees its own merges in the order that encoding it alone would take.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from granary.functions.batches import bounded_batches

#: Distinct pieces that a worker remembers with their tokens; beyond that it starts anew, which changes no result.
REMEMBERED = 200_000
#: Positions whose pairs are looked up at a time when a block enters the index.
LOOKED_UP = 1 << 18


class Vocabulary:
    """Ranks of byte strings, and the pairs of tokens that form a token."""

    def __init__(self, lines: str):
        self.rank = {base64.b64decode(a): int(b) for a, b in map(str.split, lines.splitlines()) if a}
        size = max(self.rank.values()) + 1
        self.bytes_of = [b""] * size
        for raw, r in self.rank.items():
            self.bytes_of[r] = raw
        self.byte_token = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        self.shift = 20
        pairs = [((self.rank[t[:k]] << self.shift) | self.rank[t[k:]], r) for t, r in self.rank.items() for k in range(1, len(t)) if t[:k] in self.rank and t[k:] in self.rank]
        table = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        end = [np.iinfo(np.int64).max]  # so that a search never runs off the table
        self.pair, self.becomes = np.append(table[:, 0], end), np.append(table[:, 1], -1)
        #: Tokens that can at once form a token of lower rank with a neighbour; their merges go one by one in a piece.
        self.hasty = np.zeros(size, bool)
        left, right = table[:, 0] >> self.shift, table[:, 0] & ((1 << self.shift) - 1)
        self.hasty[left[table[:, 1] < left]] = True
        self.hasty[right[table[:, 1] < right]] = True

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that each pair becomes, or -1. Negative symbols are ends."""
        code = np.where((a < 0) | (b < 0), -1, (a.astype(np.int64) << self.shift) | b)
        at = np.searchsorted(self.pair, code)
        return np.where(self.pair[at] == code, self.becomes[at], -1)


def replay(words: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all words end to end, and where each word's begin; the last mark is the end."""
    if not words:
        return np.empty(0, np.int32), np.zeros(1, np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])  # one end mark after each word
    symbol = np.full(starts[-1], -1, np.int32)
    word = np.repeat(np.arange(len(words), dtype=np.int32), lengths + 1)
    inside = np.ones(len(symbol), bool)
    inside[starts[1:] - 1] = False
    symbol[inside] = vocab.byte_token[np.frombuffer(b"".join(words), np.uint8)]
    after, before = np.arange(1, len(symbol) + 1, dtype=np.int32), np.arange(-1, len(symbol) - 1, dtype=np.int32)
    after[-1] = len(symbol) - 1
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def enter(at: np.ndarray, becomes: np.ndarray) -> None:
        found = becomes >= 0
        at, becomes = at[found], becomes[found]
        if not len(at):
            return
        order = np.argsort(becomes, kind="stable")
        at, becomes = at[order], becomes[order]
        cuts = np.flatnonzero(becomes[1:] != becomes[:-1]) + 1
        ends = [0, *cuts.tolist(), len(at)]
        for rank, a, b in zip(becomes[ends[:-1]].tolist(), ends, ends[1:]):
            if rank not in index:
                index[rank] = []
                heappush(heap, rank)
            index[rank].append(at[a:b])

    for a in range(0, len(symbol) - 1, LOOKED_UP):
        b = min(a + LOOKED_UP, len(symbol) - 1)
        enter(np.arange(a, b, dtype=np.int32), vocab.lookup(symbol[a:b], symbol[a + 1 : b + 1]))
    while heap:
        rank = heappop(heap)
        parts = index.pop(rank)
        at = np.unique(np.concatenate(parts)) if len(parts) > 1 else np.sort(parts[0])
        at = at[vocab.lookup(symbol[at], symbol[after[at]]) == rank]  # a neighbour may have changed since
        if not len(at):
            continue
        if vocab.hasty[rank]:
            first = np.concatenate([[True], word[at[1:]] != word[at[:-1]]])
            if not first.all():
                enter(at[~first], np.full((~first).sum(), rank))
            at = at[first]
        else:  # of a chain of overlapping pairs every other one, from the left
            chained = np.concatenate([[False], after[at[:-1]] == at[1:]])
            head = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
            at = at[(np.arange(len(at)) - head) % 2 == 0]
        gone = after[at]
        symbol[at] = rank
        symbol[gone] = -2
        following = after[gone]
        after[at], before[following] = following, at
        enter(at, vocab.lookup(symbol[at], symbol[following]))
        left = before[at]
        live = left >= 0
        enter(left[live], vocab.lookup(symbol[left[live]], symbol[at[live]]))
    kept = symbol >= 0
    return symbol[kept], np.searchsorted(word[kept], np.arange(len(words) + 1))


class Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


class Encoder:
    """Encodes blocks of texts; remembers the pieces of earlier blocks of a task, for digests with their ids as text and decoded."""

    def __init__(self, lines: str, pattern: str, digests: bool = False):
        self.vocab, self.pattern, self.digests = Vocabulary(lines), regex.compile(pattern), digests
        self.forget()

    def forget(self) -> None:
        self.known = Numbers()
        self.tokens, self.cuts = np.empty(0, np.int32), np.zeros(1, np.int64)  # the tokens of piece k lie from cut k to the next
        self.shown: list[str] = []  # a piece's ids as text
        self.raw: list[bytes] = []  # and decoded

    def pieces(self, texts: list[str]) -> list[array]:
        """The numbers of each text's pieces, by which cuts, shown and raw are read. Only one text's pieces exist as strings at a time."""
        if len(self.known) > REMEMBERED:
            self.forget()
        before, at = len(self.known), self.known.__getitem__
        numbers = [array("i", map(at, self.pattern.findall(t))) for t in texts]
        new = list(islice(self.known, before, None))
        tokens, cuts = replay([p.encode("utf-8", "replace") for p in new], self.vocab)
        self.tokens, self.cuts = np.concatenate([self.tokens, tokens]), np.concatenate([self.cuts, self.cuts[-1] + cuts[1:]])
        if self.digests:
            ids = [tokens[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist())]
            self.shown += [",".join(map(str, x.tolist())) for x in ids]
            self.raw += [self.decode(x) for x in ids]
        return numbers

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [self.ids(np.frombuffer(p, np.int32)) for p in self.pieces(texts)]

    def ids(self, pieces: np.ndarray) -> np.ndarray:
        """The tokens of these pieces, one after the other."""
        starts, lengths = self.cuts[pieces], self.cuts[pieces + 1] - self.cuts[pieces]
        ends = np.cumsum(lengths)
        return self.tokens[np.arange(lengths.sum()) + np.repeat(starts - ends + lengths, lengths)]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join([self.vocab.bytes_of[i] for i in ids.tolist()])


@lru_cache(maxsize=2)
def encoder(lines: str, pattern: str, digests: bool) -> Encoder:
    """One for each Python worker."""
    return Encoder(lines, pattern, digests)


def _rank_lines(path: str) -> str:
    with open(path) as f:
        return f.read()


DIGEST = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def _with_encoder(df: DataFrame, path: str, pattern: str, digests: bool = False) -> Callable[[], Encoder]:
    bounded_batches(df.sparkSession)
    lines = df.sparkSession.sparkContext.broadcast(_rank_lines(path))  # the rank file: fixed size, under 1 MB
    return lambda: encoder(lines.value, pattern, digests)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, ids (array of int). A null text is encoded as an empty one: no ids."""
    get = _with_encoder(docs, path, pattern)

    @pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(get().encode([t or "" for t in texts]), dtype=object)
        get().forget()

    return docs.select(F.col(id_col), ids(F.col(text_col)).alias("ids"))


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row: id, raw (the bytes). Null ids give empty bytes."""
    get = _with_encoder(encoded, path, pattern)

    @pandas_udf(T.BinaryType())
    def raw(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for arrays in batches:
            yield pd.Series([get().decode(np.asarray(a)) if a is not None else b"" for a in arrays], dtype=object)

    return encoded.select(F.col(id_col), raw(F.col(ids_col)).alias("raw"))


def encode_digest(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256.

    Ids are decoded back in the same pass, so that neither ids nor bytes leave the task. A null text counts as empty.
    Rows repeated are encoded alike; other columns are not read; an empty table gives an empty result.
    """
    get = _with_encoder(docs, path, pattern, digests=True)

    @pandas_udf(DIGEST)
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            enc, out = get(), []
            for p in enc.pieces([t or "" for t in texts]):
                ids = ",".join(map(enc.shown.__getitem__, p))
                raw = b"".join(map(enc.raw.__getitem__, p))
                out.append((ids.count(",") + bool(ids), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(raw).hexdigest()))
            yield pd.DataFrame(out, columns=DIGEST.names)
        get().forget()

    return docs.select(F.col(id_col), digest(F.col(text_col)).alias("__d")).select(id_col, "__d.*")


CHECKED = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("exact", T.BooleanType())])


def encode_checked(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_tokens, ids, exact (whether the ids decode to the text). A null text counts as empty."""
    get = _with_encoder(docs, path, pattern)

    @pandas_udf(CHECKED)
    def checked(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            texts, enc = [t or "" for t in texts], get()
            ids = enc.encode(texts)
            yield pd.DataFrame({"n_tokens": [len(x) for x in ids], "ids": ids, "exact": [enc.decode(x) == t.encode("utf-8", "replace") for x, t in zip(ids, texts)]}, columns=CHECKED.names)
        get().forget()

    return docs.select(F.col(id_col), checked(F.col(text_col)).alias("__d")).select(id_col, "__d.*")
