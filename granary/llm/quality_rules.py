"""Quality rules by weak supervision.

Every rule votes good, bad or abstains on a document. Expectation-maximisation over all documents' votes estimates how
often each rule is right on good and on bad documents, and a document stays if the posterior probability of
good is at least one half. So no rule decides alone unless its votes have proved right: a rule that fires where all others see
nothing wrong rejects little, and several doubts outweigh the rules that are passed. Junk of one kind shows to several rules of unequal strength
(symbols by characters, by words and by what is left of letters). These see overlapping things, which EM takes for agreement of independent
witnesses, so posteriors are nearer to 0 and 1 than they should be; on which side of one half they lie is what counts.
The documents meet EM only as counts of vote patterns, at most 3^len(RULES) rows however large the corpus.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from granary.functions.batches import bounded_batches
from granary.llm.common import materialise

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_symbol_words", "n_bare_words", "n_letters")
GOOD, BAD, ABSTAIN = 1, 0, 2
#: What EM believes of a rule before it sees votes, as so many votes of which so large a share is good: it only tells the classes apart.
PRIOR_VOTES, PRIOR_GOOD = 20.0, {GOOD: 0.9, BAD: 0.5}
#: Bytes of a word with a symbol become "#", and of a word with neither letter nor digit only "." remain.
_SYMBOL = bytes(35 if chr(c) in SYMBOLS else c for c in range(256))
_BARE = bytes(c if chr(c) in SPACES else 97 if c > 127 or chr(c).isalnum() else 46 for c in range(256))


def text_stats(text: str) -> tuple[int, ...]:
    """The numbers of STATS for a whole text."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()  # bytes split at exactly the six ASCII white-space characters
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    windows = list(zip(words, words[1:], words[2:]))
    found = Counter(windows)
    repeated = 0
    if len(found) < len(windows):
        hit = np.zeros(len(words), bool)
        at = np.flatnonzero(np.fromiter((found[x] > 1 for x in windows), bool, len(windows)))
        for k in range(3):
            hit[at + k] = True
        repeated = int(hit.sum())
    word_chars = len(text) - sum(text.count(c) for c in SPACES)
    n_symbols = sum(text.count(c) for c in SYMBOLS)
    with_symbol = sum(b"#" in w for w in raw.translate(_SYMBOL).split()) if n_symbols else 0
    bare = sum(b"a" not in w for w in raw.translate(_BARE).split())
    return len(words), word_chars, n_symbols, len(lines) - len(set(lines)), repeated, len(lines), len(set(words)), with_symbol, bare, sum(map(str.isalpha, text))


@pandas_udf(T.StructType([T.StructField(x, T.LongType()) for x in STATS]))
def stats_of(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_stats(x or "") for x in texts], columns=list(STATS), dtype="int64")


def rules(s) -> dict[str, Column]:
    """Rule -> vote. s(name) gives the column of a statistic."""
    words, some = s("n_words"), s("n_words") > 0

    def vote(value: Column, good: Column, bad: Column) -> Column:
        return F.when(~some, BAD).when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)

    symbols, repeats, length = s("n_symbols") / F.greatest(words, F.lit(1)), s("n_repeat_words") / F.greatest(words, F.lit(1)), s("word_chars") / F.greatest(words, F.lit(1))
    symbol_words, bare, letters = s("n_symbol_words") / F.greatest(words, F.lit(1)), s("n_bare_words") / F.greatest(words, F.lit(1)), s("n_letters") / F.greatest(s("word_chars"), F.lit(1))
    copies, variety = s("n_dup_lines") / F.greatest(s("n_lines"), F.lit(1)), s("n_distinct") / F.sqrt(F.greatest(words, F.lit(1)).cast("double"))
    return {
        "symbols": vote(symbols, symbols < 0.05, symbols > 0.3),
        "symbol_words": vote(symbol_words, symbol_words < 0.05, symbol_words > 0.25),
        "bare_words": vote(bare, bare < 0.02, bare > 0.15),
        "letters": vote(letters, letters > 0.9, letters < 0.8),
        "repeated_words": vote(repeats, repeats < 0.1, repeats > 0.4),
        "repeated_lines": vote(copies, copies < 0.1, (copies > 0.3) & (s("n_lines") > 3)),
        "word_length": vote(length, length.between(3, 9), (length < 2.5) | (length > 12)),
        "length": vote(words, words >= 80, words < 20),
        "variety": vote(variety, variety > 4, variety < 2),
    }


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500) -> tuple[float, np.ndarray]:
    """EM for two classes. patterns: (n, rules) of votes, counts: documents with each.

    Returns the share of good documents and p[rule, class], the probability of a good vote where the rule doesn't abstain.
    Starts from the share of good votes of each pattern. Weak Beta priors keep empty cells finite; a rule votes good at least as often on good
    documents as on bad ones, so the classes can't change places.
    """
    good_vote, voted = (patterns == GOOD).astype(float), (patterns != ABSTAIN).astype(float)
    q = (good_vote.sum(1) + 0.5) / (voted.sum(1) + 1)
    prior, p = 0.5, np.empty((patterns.shape[1], 2))
    for _ in range(rounds):
        was = q
        prior = ((counts * q).sum() + 1) / (counts.sum() + 2)
        for c, w in ((GOOD, counts * q), (BAD, counts * (1 - q))):
            p[:, c] = (w @ good_vote + PRIOR_VOTES * PRIOR_GOOD[c]) / (w @ voted + PRIOR_VOTES)
        p = p.clip(1e-6, 1 - 1e-6)
        p[:, BAD] = np.minimum(p[:, BAD], p[:, GOOD])
        q = posterior(patterns, prior, p)
        if np.abs(q - was).max(initial=0) < 1e-9:
            break
    return prior, p


def posterior(patterns: np.ndarray, prior: float, p: np.ndarray) -> np.ndarray:
    good_vote, voted = patterns == GOOD, patterns != ABSTAIN
    log = np.where(good_vote, np.log(p[:, GOOD] / p[:, BAD]), np.log((1 - p[:, GOOD]) / (1 - p[:, BAD]))) * voted
    odds = np.log(prior / (1 - prior)) + log.sum(1)
    return 1 / (1 + np.exp(-odds.clip(-500, 500)))


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, posterior, kept.

    A null text has no words; a text without words gets bad votes only. Ties: a posterior of exactly one half stays.
    Rows repeated are judged alike, each with its own row. Whole texts are read, however long. Other columns are not read, so their names can't clash. An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    rows = materialise(docs.select(F.col(id_col).alias("id"), stats_of(F.col(text_col)).alias("s")).select("id", "s.*"))
    votes = list(rules(F.col).values())
    rows = rows.withColumn("votes", F.concat(*(v.cast("string") for v in votes)))
    seen = rows.groupBy("votes").count().collect()  # 3^rules rows at most
    patterns = np.array([[int(c) for c in r["votes"]] for r in seen], dtype=int).reshape(len(seen), len(votes))
    counts = np.array([r["count"] for r in seen], dtype=float)
    prior, p = fit_votes(patterns, counts)
    verdicts = docs.sparkSession.createDataFrame([(r["votes"], float(x)) for r, x in zip(seen, posterior(patterns, prior, p))], "votes string, posterior double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = rows.join(F.broadcast(verdicts), "votes").withColumn("base_failed", failed)
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "posterior", (~F.col("base_failed") & (F.col("posterior") >= 0.5)).alias("kept"))
