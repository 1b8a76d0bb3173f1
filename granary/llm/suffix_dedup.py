"""Suffix-array deduplication by a run-length index: removes what a document repeats of documents with smaller ids.

Only text that several documents can share needs an index. Every string of SPAN bytes has a minimizer, the least hash of its
ANCHOR-byte strings, which depends on the string alone: a repeated string has the same minimizer wherever it stands. Each text is
parsed at these into phrases, runs of neighbouring strings with one minimizer, and the phrases whose minimizer several documents
hold go to the bucket of the minimizer, each distinct one of a block once. That is the dictionary of a content-defined parse, as
run-compressed transforms of repetitive corpora are built from. Which minimizers are shared is counted by Spark, a row for each
minimizer of a block. Where more than HOT documents hold one, its phrases go string by string to the buckets of the strings'
own hashes instead: equal strings still meet, and no bucket grows with a passage that is everywhere.

A bucket builds one run-length index (granary.llm.run_index) of its phrases, whose neighbourhoods of SPAN bytes know the least document, and
streams the phrases through it: a matching statistic of SPAN whose least document is smaller than the phrase's marks a string that starts
in a smaller document. Of a minimizer the phrases of its last document needn't be indexed nor those of its first streamed.
The verdicts return to the blocks, which cut the marked bytes. Texts that are equal as a whole are parsed once, for their smallest id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm import blocks as B
from granary.llm.common import materialise
from granary.llm.run_index import RunIndex

SPAN, ANCHOR = 50, 24
#: Documents with one minimizer, beyond which its strings are dealt by their own hashes.
HOT = 4_096
#: Strings in a phrase, at most; the verdict on a phrase is one bit for each.
PHRASE = 64
PIECE_BYTES = 256 << 10
_up, _down = np.empty(0, np.uint64), np.empty(0, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _up, _down
    if len(_up) < n:
        size = 1 << max(16, n.bit_length())
        base = 0xD6E8FEB86659FD93
        for name, value in (("_up", base), ("_down", pow(base, -1, 1 << 64))):
            factors = np.full(size, value, np.uint64)
            factors[0] = 1
            globals()[name] = np.multiply.accumulate(factors)
    return _up[:n], _down[:n]


class Phrases:
    """The phrases of some pieces of text: owner (number of the piece), start and strings (how many), minimizer, key (a hash of the bytes)."""

    def __init__(self, pieces: list[bytes]):
        self.raw = b"".join(pieces)
        flat = np.frombuffer(self.raw, np.uint8)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.begin = np.cumsum(sizes) - sizes
        n = len(flat) - SPAN + 1
        strings = (sizes - SPAN + 1).clip(0)
        if n <= 0 or not strings.any():
            self.owner = self.start = self.strings = np.empty(0, np.int64)
            self.minimizer = self.key = np.empty(0, np.uint64)
            self.single = np.empty(0, bool)
            return
        hashes = _anchor_hashes(flat)
        least, width = hashes, 1
        while width * 2 <= SPAN - ANCHOR + 1:
            least, width = np.minimum(least[:-width], least[width:]), width * 2
        rest = SPAN - ANCHOR + 1 - width
        least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
        # a phrase begins with a new minimizer or a new piece, and ends where the strings of its piece end
        bound = np.empty(n + 1, bool)
        bound[0] = bound[n] = True
        np.not_equal(least[1:], least[:-1], out=bound[1:n])
        some = strings > 0
        bound[self.begin[some]] = bound[(self.begin + strings)[some]] = True
        start = np.flatnonzero(bound)
        length = np.diff(start)
        start = start[:-1]
        owner = np.searchsorted(self.begin, start, side="right") - 1
        real = start - self.begin[owner] < strings[owner]
        start, length, owner = start[real], length[real], owner[real]
        parts = -(-length // PHRASE)
        part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        self.owner, self.start = np.repeat(owner, parts), np.repeat(start, parts) + part * PHRASE
        self.strings = np.minimum(np.repeat(length, parts) - part * PHRASE, PHRASE)
        self.minimizer = B.mix64(least[self.start])  # minima are small numbers; mixed again they spread over all buckets
        up, self._down = _powers(len(hashes))
        self._total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * up, out=self._total[1:])
        self.key = self._hash(self.start, self.strings)
        self.single = np.zeros(len(self.key), bool)

    def _hash(self, start: np.ndarray, strings: np.ndarray) -> np.ndarray:
        end = start + strings + SPAN - ANCHOR
        return B.mix64((self._total[end] - self._total[start]) * self._down[start] + strings.astype(np.uint64))

    def cut_up(self, hot: np.ndarray) -> None:
        """Makes each string of the phrases with a hot minimizer (ascending codes) a phrase of its own, under its own hash."""
        which = _among(_code(self.minimizer), hot)
        if not which.any():
            return
        strings, cold = self.strings[which], ~which
        inside = np.arange(strings.sum()) - np.repeat(np.cumsum(strings) - strings, strings)
        start, one = np.repeat(self.start[which], strings) + inside, np.ones(len(inside), np.int64)
        key = self._hash(start, one)
        for name, more in (("owner", np.repeat(self.owner[which], strings)), ("start", start), ("strings", one), ("minimizer", key), ("key", key)):
            setattr(self, name, np.concatenate([getattr(self, name)[cold], more]))
        self.single = np.arange(len(self.key)) >= cold.sum()

    def bytes_of(self, which: np.ndarray) -> list[bytes]:
        starts = self.start[which].tolist()
        ends = (self.start[which] + self.strings[which] + SPAN - 1).tolist()
        return [self.raw[a:b] for a, b in zip(starts, ends)]


def _code(minimizer: np.ndarray) -> np.ndarray:
    """The leading 48 bits, which travel; a rare false match only sends a phrase for nothing."""
    return minimizer >> np.uint64(16)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values stand in known (ascending)."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.searchsorted(known, values).clip(0, len(known) - 1)] == values


def _anchor_hashes(flat: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ANCHOR (24) bytes."""
    word = flat.astype(np.uint64)
    for width in (1, 2, 4):
        word = word[:-width] | (word[width:] << np.uint64(8 * width))
    return B.mix64(word[:-16] * np.uint64(0xC2B2AE3D27D4EB4F) + B.mix64(word[8:-8] * np.uint64(0x9E3779B97F4A7C15) + word[16:]))


def _pieces(texts: list[bytes]):
    """Batches of (pieces, number of the text, offset in it); pieces of a text overlap so that each string lies in one."""
    step = PIECE_BYTES - SPAN + 1
    batch, size = [], 0
    for k, raw in enumerate(texts):
        for at in range(0, max(1, len(raw) - SPAN + 1), step):
            batch.append((raw[at : at + PIECE_BYTES], k, at))
            size += len(batch[-1][0])
            if size >= PIECE_BYTES:
                yield batch
                batch, size = [], 0
    if batch:
        yield batch


def _parsed(texts: list[bytes], hot: np.ndarray):
    """Phrases of each batch of pieces, with the document number and the place in it of each phrase."""
    for batch in _pieces(texts):
        phrases = Phrases([p for p, _, _ in batch])
        phrases.cut_up(hot)
        doc, offset = np.array([k for _, k, _ in batch]), np.array([o for _, _, o in batch])
        yield phrases, doc[phrases.owner], phrases.start - phrases.begin[phrases.owner] + offset[phrases.owner]


def repeated(room: np.ndarray, doc: np.ndarray, phrases: list[bytes]) -> np.ndarray:
    """For distinct phrases (a number of the minimizer, smallest document, bytes): bit s of the answer tells that string s starts in a smaller document too."""
    bits = np.zeros(len(phrases), np.uint64)
    _, room = np.unique(room, return_inverse=True)
    first, last = np.full(room.max(initial=0) + 1, np.iinfo(np.int64).max), np.full(room.max(initial=0) + 1, np.iinfo(np.int64).min)
    np.minimum.at(first, room, doc)
    np.maximum.at(last, room, doc)
    index, query = np.flatnonzero(doc < last[room]), np.flatnonzero(doc > first[room])
    if not len(index):
        return bits
    side = lambda which: (np.frombuffer(b"".join([phrases[k] for k in which.tolist()]), np.uint8), np.array([len(phrases[k]) for k in which.tolist()]))
    _, least = RunIndex(*side(index), doc[index], SPAN).stream(*(found := side(query)))
    begin = np.cumsum(found[1]) - found[1]
    owner = np.repeat(np.arange(len(query)), found[1])
    hit = np.flatnonzero(least < doc[query][owner])
    np.bitwise_or.at(bits, query[owner[hit]], np.uint64(1) << (hit - begin[owner[hit]]).astype(np.uint64))
    return bits


#: What a block is told besides its texts: documents to parse (value: id), hot minimizers, shared minimizers, verdicts on phrases (value: key).
DOCUMENT, HOT_ONE, SHARED, VERDICT = range(4)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, hot_docs: int = HOT) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256 (with_text: and kept, the remaining bytes).

    Texts are UTF-8 bytes; null counts as empty. Each byte goes that a SPAN-byte string covers which also starts in a document with a
    smaller id; all strings are judged on the input. Rows repeated with one id are one document and get equal results.
    Rows with a null id take part in nothing and lose nothing. Ids must be integers. Texts of any length are read in overlapping
    pieces. Other columns are not read, so their names can't clash. An empty table gives an empty result. hot_docs changes no result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = materialise(rows.select("id", F.octet_length("text").alias("bytes"), F.sha2("text", 256).alias("sha")))
    blocks = B.n_blocks(keyed.agg(F.sum("bytes")).first()[0] or 0)
    reps = keyed.filter(f"id IS NOT NULL AND bytes >= {SPAN}").groupBy("sha").agg(F.min("id").alias("id"))
    text = rows.filter("id IS NOT NULL").withColumn("block", B.block_of(F.col("id"), blocks)).groupBy("block")
    zero = F.lit(0).cast("long")
    told = lambda df, kind, value, low=zero, bits=zero: df.select("block", F.lit(kind).alias("kind"), F.col(value).alias("value"), low.alias("low"), bits.alias("bits"))
    parsed = told(reps.withColumn("block", B.block_of(F.col("id"), blocks)), DOCUMENT, "id")

    def of_kind(frame, kind, column="value"):
        return frame[column].to_numpy()[frame["kind"].to_numpy() == kind]

    def chosen(left, right):
        left = left[left["id"].isin(of_kind(right, DOCUMENT))].drop_duplicates("id")
        return left["id"].to_numpy(dtype=np.int64), [t.encode("utf-8", "replace") for t in left["text"]]

    def unsigned(frame, kind, column="value"):
        return of_kind(frame, kind, column).astype(np.int64).view(np.uint64)

    none = np.empty(0, np.uint64)

    def anchors(key, left, right):
        found = [none]
        for p, doc, _ in _parsed(chosen(left, right)[1], none):
            order = np.lexsort((doc, p.minimizer))
            hashes, owner = _code(p.minimizer)[order], doc[order]
            new = np.ones(len(hashes), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
            found.append(hashes[new])  # once for each document of these pieces
        hashes, counts = np.unique(np.concatenate(found), return_counts=True)
        return pd.DataFrame({"hash": hashes.view(np.int64), "block": np.full(len(hashes), int(key[0]), np.int32), "docs": counts.astype(np.int32)})

    def parse(key, left, right):
        hot = np.sort(unsigned(right, HOT_ONE))
        known = np.sort(unsigned(right, SHARED))
        ids, texts = chosen(left, right)
        parts, raws = [], []
        for p, doc, _ in _parsed(texts, hot) if len(known) or len(hot) else ():
            some = np.flatnonzero(p.single | _among(_code(p.minimizer), known))
            keys, first, place = np.unique(p.key[some], return_index=True, return_inverse=True)
            least, most = np.full(len(keys), np.iinfo(np.int64).max), np.full(len(keys), np.iinfo(np.int64).min)
            np.minimum.at(least, place, ids[doc[some]])
            np.maximum.at(most, place, ids[doc[some]])
            parts.append((p.minimizer[some[first]], keys, least, most))
            raws += p.bytes_of(some[first])
        minimizer, keys, least, most = (np.concatenate(x) for x in zip(*parts)) if parts else (none, none, none, none)
        uniq, first, place = np.unique(keys, return_index=True, return_inverse=True)
        low, high = least[first].copy(), most[first].copy()
        np.minimum.at(low, place, least)
        np.maximum.at(high, place, most)
        bucket = (minimizer[first] >> shift).astype(np.int32)
        return pd.DataFrame({"bucket": bucket, "block": np.full(len(uniq), int(key[0]), np.int32), "room": (minimizer[first] >> np.uint64(8)).astype(np.uint32).view(np.int32), "key": uniq.view(np.int64), "low": low.view(np.int64), "again": high > low, "raw": [raws[k] for k in first.tolist()]})

    def judge(pdf):
        keys, first, place = np.unique(pdf["key"].to_numpy(), return_index=True, return_inverse=True)
        low = np.full(len(keys), np.iinfo(np.int64).max)
        np.minimum.at(low, place, pdf["low"].to_numpy())
        bits = repeated(pdf["room"].to_numpy()[first], low, pdf["raw"].iloc[first].to_list())
        tell = (bits[place] > 0) | pdf["again"].to_numpy() | (pdf["low"].to_numpy() > low[place])
        return pd.DataFrame({"block": pdf["block"].to_numpy()[tell], "key": keys[place][tell], "low": low[place][tell], "bits": bits[place][tell].view(np.int64)})

    def cut(key, left, right):
        keys = unsigned(right, VERDICT)
        order = np.argsort(keys)
        keys, low, bits = keys[order], of_kind(right, VERDICT, "low")[order], unsigned(right, VERDICT, "bits")[order]
        ids, texts = chosen(left, right)
        begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
        gone = np.zeros(begin[-1] + 1, np.int32)
        for p, doc, place in _parsed(texts, np.sort(unsigned(right, HOT_ONE))) if len(keys) else ():
            at = np.searchsorted(keys, p.key).clip(0, len(keys) - 1)
            some = np.flatnonzero(keys[at] == p.key)
            at, doc, start, strings = at[some], doc[some], begin[doc[some]] + place[some], p.strings[some]
            whole = low[at] < ids[doc]
            np.add.at(gone, start[whole], 1)
            np.add.at(gone, (start + strings + SPAN - 1)[whole], -1)
            start, mask = start[~whole], bits[at[~whole]].astype("<u8")
            phrase, string = np.nonzero(np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            np.add.at(gone, start[phrase] + string, 1)
            np.add.at(gone, start[phrase] + string + SPAN, -1)
        removed = np.cumsum(gone) > 0
        of = {i: (t, removed[a : a + len(t)]) for i, t, a in zip(ids.tolist(), texts, begin.tolist())}
        out = []
        for i, t in zip(left["id"].tolist(), left["text"]):
            if i in of:
                raw, marks = of[i]
                kept = np.frombuffer(raw, np.uint8)[~marks].tobytes() if marks.any() else raw
                spans = int(marks[:1].sum() + (marks[1:] & ~marks[:-1]).sum())
            else:  # a copy of a smaller document, or too short to repeat anything
                raw = t.encode("utf-8", "replace")
                kept = b"" if len(raw) >= SPAN else raw
                spans = int(len(raw) >= SPAN)
            out.append((i, len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        return pd.DataFrame(out, columns=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    shift = B.bucket_shift(blocks)
    minimizers = text.cogroup(parsed.groupBy("block")).applyInPandas(anchors, "hash long, block int, docs int")
    counted = minimizers.withColumn("n", F.sum("docs").over(Window.partitionBy("hash"))).filter("n > 1")
    answers = materialise(counted.select("block", F.when(F.col("n") > hot_docs, HOT_ONE).otherwise(SHARED).alias("kind"), F.col("hash").alias("value"), zero.alias("low"), zero.alias("bits")))
    phrases = text.cogroup(parsed.unionByName(answers).groupBy("block")).applyInPandas(parse, "bucket int, block int, room int, key long, low long, again boolean, raw binary")
    verdicts = told(phrases.groupBy("bucket").applyInPandas(judge, "block int, key long, low long, bits long"), VERDICT, "key", F.col("low"), F.col("bits"))
    beside = parsed.unionByName(answers.filter(F.col("kind") == HOT_ONE)).unionByName(verdicts)
    out = text.cogroup(beside.groupBy("block")).applyInPandas(cut, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    nameless = rows.filter("id IS NULL").select("id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), F.encode("text", "UTF-8").alias("kept"))
    out = out.unionByName(nameless).withColumnRenamed("id", id_col)
    return out if with_text else out.drop("kept")
