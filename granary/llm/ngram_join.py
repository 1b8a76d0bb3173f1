"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents are sets of five-word shingles, and two link at a Jaccard similarity of 0.75. Sets that are equal collapse to one
representative first. Of a set of n, a partner must share o = ceil(0.75 n), so under any order of the shingles the first n - o + l of both
hold l shared ones. A first pass uses the order of the hashes and drops each document whose prefix doesn't hold enough
shingles that other prefixes hold too: it can have no partner. Those left are ordered from rare to frequent by exact document
frequencies over all of them, and each chooses l by the candidates that its prefix is expected to bring, a longer prefix asking for
more shared shingles before a pair is verified.

Spark counts the shingles, a row for each distinct one of a block of documents, so rows grow in step with the input and a shingle that is
everywhere has a row for each block.

No pairs are emitted within a group. Members of a prefix group are first verified with its hub, the least of them; most groups are
one component by then, and pairs in one component need no further link. Where a group holds several components, the members
outside the largest are compared with all others under the multi-match condition, in blocks inside tasks, from which only links come out.
So the components are exact, and no group is too large.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from granary.llm import blocks as B
from granary.llm.common import materialise, with_rows
from granary.llm.components import components

WORDS, PERCENT = 5, 75
#: Most shared prefix shingles that a document may ask for, and the cost of a verification against an index entry.
MOST_MATCHES, VERIFY_COST = 8, 20.0
#: One in so many shingles lengthens the prefix of the first pass, and must be shared.
FIRST_PASS = 10
#: Members of a hub that are verified in one task.
HUB_MEMBERS = 2_000
CHUNK_BYTES = 512 << 10
#: Sets in a block of a comparison, and shingles in a slice of its matrices.
BLOCK_SETS, COLUMNS = 512, 4096
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEPS = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(16, n.bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            factors = np.full(size, base)
            factors[0] = 1
            _powers[name] = np.multiply.accumulate(factors)
    return _powers["up"][:n], _powers["down"][:n]


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """The ascending distinct 64-bit shingle hashes of each whole text. A text of fewer words has one, without words none."""
    out: list[np.ndarray] = []
    chunk: list[bytes] = []
    size = 0
    for text in texts:
        raw = text.encode("utf-8", "replace")
        if chunk and size + len(raw) > CHUNK_BYTES:
            out += _sets(chunk, words)
            chunk, size = [], 0
        chunk.append(raw)
        size += len(raw) + 1
    return out + _sets(chunk, words) if chunk else out


def _sets(raws: list[bytes], words: int) -> list[np.ndarray]:
    raw = np.frombuffer((b" ".join(raws) + b" ").translate(_LOWER), np.uint8)
    space = _SPACE[raw]
    before = np.concatenate([[True], space[:-1]])
    begin, end = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    up, down = _power(len(raw))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)])
    word = B.mix64((total[end] - total[begin]) * down[begin])
    ends = np.cumsum([len(r) + 1 for r in raws])
    cut = np.concatenate([[0], np.searchsorted(begin, ends)]).tolist()
    n = max(0, len(word) - words + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(words):
        rolled += word[k : k + n] * _STEPS[k]
    rolled = B.mix64(rolled)
    out = []
    for a, b in zip(cut, cut[1:]):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            out.append(B.mix64((word[a:b] * _STEPS[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


SKETCH = T.StructType([T.StructField(n, T.LongType()) for n in ("n", "k1", "k2")])


@pandas_udf(SKETCH)
def set_key(texts: pd.Series) -> pd.DataFrame:
    """Size and a 128-bit key of each shingle set."""
    sets = shingle_sets([x or "" for x in texts])
    keys = [(len(s), int(s.sum(dtype=np.uint64).view(np.int64)), int(B.mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64))) for s in sets]
    return pd.DataFrame(keys, columns=SKETCH.names, dtype="int64")


def choose_prefix(frequency: np.ndarray, n: int) -> tuple[int, int]:
    """How many of the shared shingles (frequencies ascending) the prefix holds, and how many a partner must share (l).

    n counts all shingles; the unshared ones come first. The prefix is lengthened as long as the expected cost falls:
    an index entry per posting, and a verification for each partner that l entries can bring.
    """
    unshared, need = n - len(frequency), -(-PERCENT * n // 100)
    postings = np.concatenate([[0], np.cumsum(frequency)])
    matches = np.arange(1, min(MOST_MATCHES, need) + 1)
    held = (n - need + matches - unshared).clip(0, len(frequency))
    cost = postings[held] * (1 + VERIFY_COST / matches)
    best = int(cost.argmin())
    return int(held[best]), int(matches[best])


def first_prefix(n: int) -> tuple[int, int]:
    """How many of the hash-least shingles of n the first pass reads, and how many of these must stand in other prefixes too.

    A partner has ceil(0.75 n) shingles at least, and lengthens its own prefix in proportion to its size.
    """
    need = -(-PERCENT * n // 100)
    return min(n, n - need - (-n // FIRST_PASS)), -(-need // FIRST_PASS)


#: What a block is told besides its texts: documents to read (value: id) and shared shingles (value: leading bits of the hash).
DOCUMENT, SHINGLE = 0, 1


def _code(hashes: np.ndarray) -> np.ndarray:
    """The leading 48 bits, which travel; a rare false match only adds a candidate."""
    return (hashes >> np.uint64(16)).view(np.int64)


def _index(docs: DataFrame, keys: DataFrame, blocks: int) -> DataFrame:
    """id, n, matches, prefix, shared of each representative whose prefix holds a shared shingle."""
    text = docs.filter("id IS NOT NULL").withColumn("block", B.block_of(F.col("id"), blocks)).groupBy("block")
    told = lambda df, kind, value, often=F.lit(0).cast("long"): df.select("block", F.lit(kind).alias("kind"), F.col(value).alias("value"), often.alias("often"))

    def sets_of(left, right):
        """Ids and sets of the documents to read, and the shared shingles with their frequencies."""
        kind, value, often = (right[c].to_numpy() for c in ("kind", "value", "often"))
        left = left[left["id"].isin(value[kind == DOCUMENT])].drop_duplicates("id")
        codes, often = value[kind == SHINGLE], often[kind == SHINGLE]
        order = np.argsort(codes)
        return left["id"].tolist(), shingle_sets(left["text"].to_list()), codes[order], often[order]

    def look_up(s, codes, often):
        """Frequencies of the shingles, 0 for those that nobody shares."""
        if not len(codes):
            return np.zeros(len(s), np.int64)
        at = np.searchsorted(codes, _code(s)).clip(0, len(codes) - 1)
        return np.where(codes[at] == _code(s), often[at], 0)

    def send(prefixes):
        def rows(key, left, right):
            _, sets, *_ = sets_of(left, right)
            sets = [s[: first_prefix(len(s))[0]] for s in sets] if prefixes else sets
            found, counts = np.unique(_code(np.concatenate([np.empty(0, np.uint64), *sets])), return_counts=True)
            return pd.DataFrame({"hash": found, "block": np.full(len(found), int(key[0]), np.int32), "docs": counts.astype(np.int32)})

        return rows

    def survivors(key, left, right):
        ids, sets, codes, often = sets_of(left, right)
        stay = [(i, int(key[0])) for i, s in zip(ids, sets) if np.count_nonzero(look_up(s[: first_prefix(len(s))[0]], codes, often)) >= first_prefix(len(s))[1]]
        return pd.DataFrame(stay, columns=["id", "block"])

    def choose(key, left, right):
        ids, sets, codes, often = sets_of(left, right)
        out = []
        for id_, s in zip(ids, sets):
            times = look_up(s, codes, often)
            shared, times = s[times > 0], times[times > 0]
            order = np.lexsort((shared, times))
            shared, times = shared[order].view(np.int64), times[order]
            held, matches = choose_prefix(times, len(s))
            if held:
                out.append((id_, len(s), matches, shared[:held], shared))
        return pd.DataFrame(out, columns=["id", "n", "matches", "prefix", "shared"])

    def answered(documents, prefixes):
        """The documents, and what they share, beside each other by block."""
        rows = text.cogroup(documents.groupBy("block")).applyInPandas(send(prefixes), "hash long, block int, docs int")
        counted = rows.withColumn("often", F.sum("docs").over(Window.partitionBy("hash"))).filter("often > 1")
        return text.cogroup(documents.unionByName(told(counted, SHINGLE, "hash", F.col("often"))).groupBy("block"))

    reps = told(keys.withColumn("block", B.block_of(F.col("id"), blocks)), DOCUMENT, "id")
    left = told(materialise(answered(reps, True).applyInPandas(survivors, "id long, block int")), DOCUMENT, "id")
    return answered(left, False).applyInPandas(choose, "id long, n long, matches int, prefix array<long>, shared array<long>")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs a, b whose sets are similar enough; pairs that share too few prefix shingles aren't compared as wholes.

    The set of an a with many pairs is copied to one task for each HUB_MEMBERS of them.
    """
    side = lambda x: sets.select(F.col("id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "matches", "prefix", "shared")))
    pairs = materialise(pairs)
    hubs = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(HUB_MEMBERS)).cast("int").alias("parts"))
    salted = pairs.join(hubs, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).drop("parts")
    ones = side("a").join(hubs, "a").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    both = salted.join(side("b"), "b").join(ones, ["a", "part"])
    met = F.size(F.array_intersect("shared_a", "shared_b"))
    asked = F.size(F.array_intersect("prefix_a", "prefix_b")) >= F.least("matches_a", "matches_b")
    return both.filter(asked).filter(100 * met >= PERCENT * (F.col("n_a") + F.col("n_b") - met)).select("a", "b")


def _near(small: str, large: str):
    """Sizes that a pair of the asked similarity can have."""
    return (100 * F.col(small) >= PERCENT * F.col(large)) & (100 * F.col(large) >= PERCENT * F.col(small))


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left set with each right set, as products of incidence matrices."""
    out = np.zeros((len(left), len(right)), np.float32)
    lefts, rights = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
    common = np.intersect1d(lefts, rights)
    places = []
    for sets, flat in ((left, lefts), (right, rights)):
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.searchsorted(common, flat).clip(0, max(0, len(common) - 1))
        hit = common[at] == flat if len(common) else np.zeros(len(flat), bool)
        places.append((owner[hit], at[hit]))
    for begin in range(0, len(common), COLUMNS):
        sides = []
        for sets, (owner, at) in zip((left, right), places):
            some = (at >= begin) & (at < begin + COLUMNS)
            x = np.zeros((len(sets), min(COLUMNS, len(common) - begin)), np.float32)
            x[owner[some], at[some] - begin] = 1
            sides.append(x)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between the minor members of a hub's group and all of it (one block of each), one for each component that a member links to."""
    minor, other = pdf[pdf["minor"]], pdf[~pdf["minor"]]
    if not len(minor) or not len(other):
        return pd.DataFrame([], columns=["a", "b"])
    column = lambda f, c: f[c].to_numpy()
    na, nb = column(minor, "n")[:, None], column(other, "n")[None, :]
    ca, cb = column(minor, "component")[:, None], column(other, "component")[None, :]
    asked = np.minimum(column(minor, "matches")[:, None], column(other, "matches")[None, :])
    ok = (ca != cb) & (100 * na >= PERCENT * nb) & (100 * nb >= PERCENT * na)
    ok &= _overlaps(list(minor["prefix"]), list(other["prefix"])) >= asked
    rows, columns = np.flatnonzero(ok.any(1)), np.flatnonzero(ok.any(0))
    met = _overlaps([minor["shared"].iloc[k] for k in rows], [other["shared"].iloc[k] for k in columns])
    linked = ok[np.ix_(rows, columns)] & (100 * met >= PERCENT * (na[rows] + nb[:, columns] - met))
    i, j = np.nonzero(linked)
    found = pd.DataFrame({"a": column(minor, "id")[rows[i]], "b": column(other, "id")[columns[j]], "c": cb[0, columns[j]]})
    return found.drop_duplicates(["a", "c"])[["a", "b"]]


def _linked(index: DataFrame) -> DataFrame:
    """id, component of the representatives that link.

    A group is a hub, the least member of a prefix shingle, with all members of the shingles that have this hub: a pair that shares a
    prefix shingle is in a group together. Members are verified with their hub first. Where a group then holds several
    components, its members outside the largest of them are compared with all others, block by block inside tasks.
    """
    entries = index.select("id", "n", F.explode("prefix").alias("token"))
    hubs = B.group_min(entries, ["token"], F.struct("id", "n"), "hub")
    groups = materialise(hubs.select(F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n"), "id", "n").distinct())
    links = materialise(_verified(groups.filter((F.col("hub") != F.col("id")) & _near("n", "hub_n")).select(F.col("hub").alias("a"), F.col("id").alias("b")), index))
    found = components(links)
    labelled = materialise(groups.select("hub", "id").join(found, "id", "left").withColumn("component", F.coalesce("component", "id")))
    sizes = labelled.groupBy("hub", "component").count().groupBy("hub").agg(F.max_by("component", F.struct("count", "component")).alias("major"), F.max("count").alias("most"), F.sum("count").alias("all"))
    sizes = materialise(sizes.filter("most < all"))
    if sizes.isEmpty():
        return found
    count = lambda n: F.ceil(n / F.lit(BLOCK_SETS)).cast("int")
    mixed = labelled.join(sizes, "hub").withColumns({"minors": count(F.col("all") - F.col("most")), "alls": count(F.col("all"))})
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    minor = mixed.filter(F.col("component") != F.col("major")).select("hub", own("minors").alias("x"), every("alls").alias("y"), "id", "component", F.lit(True).alias("minor"))
    other = mixed.select("hub", every("minors").alias("x"), own("alls").alias("y"), "id", "component", F.lit(False).alias("minor"))
    members = minor.unionByName(other).join(index, "id")
    more = materialise(members.groupBy("hub", "x", "y").applyInPandas(_compare, "a long, b long"))
    # found links the same ids as links do, and its stars take fewer rounds
    return found if more.isEmpty() else components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (the least id reachable by links, itself included).

    A null text has no shingle, like an empty one, and links with nothing. Texts of one to four words are one shingle each. Rows
    repeated, or with equal sets, form one component. Ids must be integers; a null id gets a null component unless a copy has
    an id. Other columns are not read. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = materialise(rows.select("id", F.octet_length("text").alias("bytes"), set_key("text").alias("k")).select("id", "bytes", "k.*"))
    blocks = B.n_blocks(keyed.agg(F.sum("bytes")).first()[0] or 0)
    some = keyed.filter("n > 0")
    classes = materialise(some.groupBy("k1", "k2", "n").agg(F.min("id").alias("id"), F.collect_set(F.pmod(F.xxhash64("id"), F.lit(64))).alias("salts")))
    index = materialise(_index(rows, classes.filter("id IS NOT NULL").select("id"), blocks))
    found = _linked(index)
    named = classes.join(found, "id", "left").withColumn("component_id", F.coalesce("component", "id"))
    named = named.select("k1", "k2", "n", F.explode("salts").alias("salt"), "component_id")
    salted = some.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    out = salted.join(named, ["k1", "k2", "n", "salt"]).select("id", "n", "component_id")
    out = out.unionByName(keyed.filter("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", placed: bool = False) -> DataFrame:
    """The rows of docs that stay, one row of each component, with all their columns.

    It is the row of the smallest id; a null id stays only where its component has no other. Rows are compared and judged one by one, so
    null ids and ids of several rows link nothing and cost no other row. Ids must be integers. `placed`: see with_rows().
    """
    rows = with_rows(docs, "__row", placed)
    found = near_duplicates(rows, "__row", text_col)
    named = found.join(rows.select("__row", F.col(id_col).alias("__id")), "__row")
    first = F.min(F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__row").alias("row")))
    stay = named.groupBy("component_id").agg(first.alias("first")).select(F.col("first.row").alias("__row"))
    return rows.join(stay, "__row", "left_semi").select(*docs.columns)
