import base64
import hashlib
import random
import re

import duckdb
import public_tokenizers as P
import pytest
import tiktoken

from granary.llm import bpe, chat, licences
from granary.llm.queries import RANKS

PATH = P.path(RANKS)


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rnd = random.Random(1)
    pick = lambda a, n: "".join(rnd.choice(a) for _ in range(n))
    return (
        ["", None, "a" * 1000, " " * 77 + "x", "\n\n\n  \t", "日本語テキスト🙂🙂", "aaabaaab" * 50, "'s't've", "-" * 333, "<|endoftext|>", "\x00​"]
        + [pick("ab cé🙂\n'-1", rnd.randint(0, 200)) for _ in range(300)]
        + [pick("theainro ", 400) for _ in range(100)]
        + [pick("aab-=", 100) for _ in range(100)]
    )


def test_tokens_against_the_library(spark, reference):
    texts = odd_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    digests = {r.doc_id: r for r in bpe.encode_digest(df, PATH, P.PATTERN).collect()}
    ids = {r.doc_id: r.ids for r in bpe.encode(df, PATH, P.PATTERN).collect()}
    for i, t in enumerate(texts):
        want = reference.encode_ordinary(t or "")
        assert ids[i] == want
        assert digests[i][1:] == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_decode_and_check(spark):
    df = spark.createDataFrame(list(enumerate(odd_texts()[:40])), "doc_id int, text string")
    raw = {r.doc_id: bytes(r.raw) for r in bpe.decode(bpe.encode(df, PATH, P.PATTERN), PATH, P.PATTERN).collect()}
    assert raw == {r.doc_id: (r.text or "").encode() for r in df.collect()}
    assert all(r.exact for r in bpe.encode_checked(df, PATH, P.PATTERN).collect())
    assert bpe.encode_digest(df.limit(0), PATH, P.PATTERN).collect() == []


def test_forgetting_pieces_changes_nothing(reference, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    with open(PATH) as f:
        enc = bpe.Encoder(f.read(), P.PATTERN)
    for t in odd_texts()[2:60]:
        assert enc.encode([t])[0].tolist() == reference.encode_ordinary(t)


CHAT = "conv_id long, turn long, role string, text string"


def talk(spark, rows, **how):
    return chat.format_windows(spark.createDataFrame(rows, CHAT), **how)


def expected(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_reads_back(spark):
    rnd = random.Random(5)
    strings = ["</s>[INST] ok [/INST]", "<|turn|>", "<|end|>\\", "\\\\<\\|", "$1 \\n", "", None, "ü🙂 x", "<|again|>a<|text|>", "word " * 60]
    rows = [(c, t, rnd.choice(["user", "assistant", "system", None, "<|text|>"]) if t else rnd.choice(["system", "user"]), rnd.choice(strings)) for c in range(40) for t in range(rnd.choice([1, 2, 30]))]
    rows += [(None, 1, "user", "a"), (None, None, "assistant", "b"), (50, 1, "user", "tie"), (50, 1, "user", "tie"), (50, 1, "assistant", "tie")]
    got = {r.conv_id: tuple(r)[1:5] for r in chat.read_back(talk(spark, rows, own=40, history=20)).collect()}
    assert got == expected(rows)


def test_windows_repeat_system_and_history(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, k, "assistant" if k % 2 == 0 else "user", f"turn{k} " * 9) for k in range(1, 9)]
    windows = sorted(talk(spark, rows, own=40, history=10).collect(), key=lambda r: r.window)
    assert len(windows) == 2 and all("be kind" in w.formatted for w in windows)
    second = windows[1].formatted
    assert second.startswith("<|again|>system<|text|>be kind<|end|><|again|>assistant<|text|>turn4")
    masked = ["".join(w.formatted[s.start - 1 : s.start - 1 + s.length] for s in w.loss) for w in windows]
    assert masked == ["".join(f"turn{k} " * 9 for k in ks) for ks in ((2, 4), (6, 8))]


def test_windows_keep_their_budget(spark):
    rnd = random.Random(5)
    lengths = [0, 3, 30, 39, 40, 41, 200]
    rows = [(c, t, "system" if t == 0 and c % 2 else rnd.choice(["user", "assistant"]), " ".join("w" * rnd.choice(lengths))) for c in range(12) for t in range(60)]
    rows += [(c, 70, "assistant", "same turn") for c in range(6)] * 2 + [(3, None, "user", "no turn number"), (None, 1, "user", "a"), (None, 2, "assistant", "b")]
    how = dict(own=60, history=25, turn_most=40, system_most=30)
    windows = talk(spark, rows, **how, range_turns=7).collect()
    assert sorted(map(tuple, windows), key=repr) == sorted(map(tuple, talk(spark, rows, **how, range_turns=1000).collect()), key=repr)
    said = chat.read_back(talk(spark, rows, **how, range_turns=7)).collect()
    assert {r.conv_id: tuple(r)[1:5] for r in said} == expected(rows)
    for w in windows:
        turns = re.findall(r"(?s)<\|(turn|again)\|>(.*?)<\|text\|>(.*?)<\|end\|>", w.formatted)
        size = lambda t: len(t[2].split()) + 1
        assert w.tokens == sum(map(size, turns)) and w.over == (w.tokens > 155)
        own = [t for t in turns if t[0] == "turn" and t[1] != "system"]
        long = [t for t in own if size(t) > 40]
        assert not long or len(own) == 1  # an overlong turn has a window of its own
        if w.over:
            assert long or any(t[1] == "system" and size(t) > 30 for t in turns)
    assert any(w.over for w in windows)


def test_chat_edges(spark):
    assert chat.read_back(talk(spark, [])).collect() == []
    df = spark.createDataFrame([(1, 0, "user", "x", "clash")], CHAT + ", window string")
    assert [tuple(r)[:2] for r in chat.read_back(chat.format_windows(df)).collect()] == [(1, 1)]
    long = [(7, k, "assistant", "w " * 2000) for k in range(3)]
    assert {r.conv_id: tuple(r)[1:5] for r in chat.read_back(talk(spark, long)).collect()} == expected(long)


def test_licences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy. Something else!\nThe above copyright notice and this permission notice shall be included in all copies.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND."
    texts = {
        1: "Prose. Licensed under the Apache License, Version 2.0.",
        2: mit,
        3: "\n".join(reversed(mit.split("\n"))),
        4: "licensed UNDER  cc by-nc 4.0!\nReleased under the MIT License.",
        5: "We discuss what is Licensed under the Apache License, Version 2.0 and more.",
        6: None,
        7: "",
        8: "This work is licensed under the GNU General Public License, version 3.\n" * 2,
        9: "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\nhttp://x\ndistributed under the License is distributed on an \"AS IS\" BASIS",
    }
    df = spark.createDataFrame([(k, v, "c") for k, v in texts.items()], "doc_id int, text string, sequence string")
    rows = {r.doc_id: r for r in licences.scan(df).collect()}
    assert {k: r.licences for k, r in rows.items()} == {1: "Apache-2.0", 2: "MIT-text", 3: "", 4: "CC-BY-NC-4.0,MIT", 5: "", 6: "", 7: "", 8: "GPL-3.0", 9: "Apache-2.0-notice"}
    assert rows[8].n_sentences == 2 and rows[3].n_sentences == 3
    con = duckdb.connect()
    documents = df.select("doc_id", "text").toPandas()  # noqa: F841
    for k, n, q, names in con.sql(licences.oracle_sql()).fetchall():
        assert (rows[k].n_sentences, rows[k].sequence, rows[k].licences) == (n, q, names)
    assert licences.scan(df.limit(0)).collect() == []
