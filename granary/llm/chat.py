"""Chat formatting in budgeted windows.

Prefix sums of turn tokens place each turn in a window: a window owns the turns whose first token falls into its OWN tokens,
so windows are aligned to turns. A turn of more than TURN_MOST tokens gets a window of its own. A leading system turn is repeated
before every later window, and so are the last turns before a window as far as they fit HISTORY tokens. Repeated
turns carry a marker of their own and are masked: each assistant text is under the loss mask exactly once.

So a window holds at most BUDGET tokens, unless its one own turn is longer than TURN_MOST or the system turn longer than SYSTEM_MOST; turns are never
cut, and such windows are flagged.

A window is a string of turns, `<|turn|>role<|text|>text<|end|>` (`<|again|>` for a repeated one). In roles and texts a backslash
is doubled and control strings get a backslash after their first character, so `\\(.)` -> `$1` reads them back.

Only DataFrame functions are used. The turns of a conversation are cut into ranges of turn numbers, whose sums are summed up first, so a long
conversation is spread over tasks; its windows meet again only to be digested.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import WORD, n_words

OWN, HISTORY, TURN_MOST, SYSTEM_MOST = 512, 128, 256, 256
#: A turn costs a token besides its words.
BUDGET = OWN + TURN_MOST + HISTORY + SYSTEM_MOST
RANGE_TURNS = 256
TURN, AGAIN, TEXT, END = "<|turn|>", "<|again|>", "<|text|>", "<|end|>"
#: All markers begin with the first of these; the others belong to common templates of other models.
CONTROLS = ("<|", "</s>", "<s>", "[INST]", "[/INST]")
_ESCAPES = (("\\", "\\\\"), *((c, c[0] + "\\" + c[1:]) for c in CONTROLS))


def escape(text: Column) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), _ESCAPES, text)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_windows(turns: DataFrame, own: int = OWN, history: int = HISTORY, turn_most: int = TURN_MOST, system_most: int = SYSTEM_MOST, range_turns: int = RANGE_TURNS) -> DataFrame:
    """conv_id, turn, role, text -> one row per window: conv_id, window, formatted, loss (array of start, length; from 1), tokens, over.

    `over` tells that tokens exceed own + history + turn_most + system_most, which only an overlong turn brings about.
    Null roles and texts count as empty. Turns stand by turn (nulls first), then role, then text, so that ties and repeated rows have
    a defined order; each row is a turn. Rows with a null conv_id are one conversation. Windows are numbered upwards, with gaps. Other
    columns are not read, so their names can't clash. An empty table gives an empty result. range_turns changes no result.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("words", n_words(F.col("text")) + 1).withColumn("range", F.coalesce(F.floor(F.col("turn") / F.lit(range_turns)), F.lit(-(1 << 62))))
    rows = _placed(rows, turn_most)
    rows = rows.withColumn("window", F.floor(F.col("start") / F.lit(own)) + F.col("split"))
    spans = rows.groupBy("conv_id", "window").agg(F.min("start").alias("start"))
    following = Window.partitionBy("conv_id").orderBy("window")
    spans = spans.select(F.col("conv_id").alias("c"), F.col("window").alias("w"), F.lead("window").over(following).alias("next"), F.lead("start").over(following).alias("next_start"))
    rows = rows.join(spans, F.expr("conv_id <=> c AND window = w"))
    repeated = ~F.col("system") & (F.col("next_start") - F.col("start") <= history)
    places = F.filter(F.array(F.struct("window", F.lit(False).alias("again")), F.when(repeated, F.struct(F.col("next").alias("window"), F.lit(True).alias("again")))), lambda p: p.isNotNull())
    rows = rows.select("conv_id", "pos", "system", "role", "words", F.concat(escape(F.col("role")), F.lit(TEXT)).alias("head"), escape(F.col("text")).alias("body"), F.explode(places).alias("at"))
    systems = rows.filter("system").select(F.col("conv_id").alias("c"), F.concat(F.lit(AGAIN), F.col("head"), F.col("body"), F.lit(END)).alias("lead"), F.col("words").alias("lead_words"))
    rows = rows.select("conv_id", F.col("at.window").alias("window"), "pos", "system", "words", F.concat(F.when(F.col("at.again"), AGAIN).otherwise(TURN), F.col("head")).alias("head"), "body", (~F.col("at.again") & (F.col("role") == "assistant")).alias("target"))
    size = F.length("head") + F.length("body") + len(END)
    begun = F.coalesce(F.sum(size).over(Window.partitionBy("conv_id", "window").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("first", begun + F.length("head") + 1)
    span = F.when(F.col("target"), F.struct(F.col("first").alias("start"), F.length("body").alias("length")))
    pieces = F.sort_array(F.collect_list(F.struct("pos", F.concat("head", "body", F.lit(END)).alias("piece"))))
    windows = rows.groupBy("conv_id", "window").agg(F.concat_ws("", F.transform(pieces, lambda p: p["piece"])).alias("text"), F.sort_array(F.collect_list(span)).alias("spans"), F.sum("words").alias("words"), F.max("system").alias("opens"))
    windows = windows.join(systems, F.expr("conv_id <=> c AND NOT opens"), "left").withColumns({"lead": F.coalesce("lead", F.lit("")), "tokens": F.col("words") + F.coalesce("lead_words", F.lit(0))})
    shifted = F.transform("spans", lambda s: F.struct((s["start"] + F.length("lead")).cast("long").alias("start"), s["length"].cast("long").alias("length")))
    over = F.col("tokens") > own + history + turn_most + system_most
    return windows.select("conv_id", "window", F.concat("lead", "text").alias("formatted"), shifted.alias("loss"), "tokens", over.alias("over"))


def _placed(rows: DataFrame, turn_most: int) -> DataFrame:
    """rows with pos, system, start (tokens before) and split (grows by one at each side of an overlong turn); system turns count no tokens.

    The ranges of a conversation are summed up first, one row each; then each range adds its own prefix sums.
    """
    order = F.struct("turn", "role", "text")
    parts = rows.groupBy("conv_id", "range").agg(
        F.count(F.lit(1)).alias("n"), F.sum("words").alias("sum_words"), F.count_if(F.col("words") > turn_most).alias("n_long"), F.min_by(F.struct("role", "words"), order).alias("head")
    )
    by_range = Window.partitionBy("conv_id").orderBy("range")
    parts = parts.withColumn("system", (F.row_number().over(by_range) == 1) & (F.col("head.role") == "system"))
    counted = {"n": F.col("n"), "words": F.col("sum_words") - F.when(F.col("system"), F.col("head.words")).otherwise(0), "long": F.col("n_long") - F.when(F.col("system") & (F.col("head.words") > turn_most), 1).otherwise(0)}
    earlier = by_range.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("conv_id").alias("c"), F.col("range").alias("r"), F.col("system").alias("opens"), *(F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"{k}_before") for k, v in counted.items()))
    within = Window.partitionBy("conv_id", "range").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("inside", F.row_number().over(within)).join(parts, F.expr("conv_id <=> c AND range = r"))
    rows = rows.withColumn("system", F.col("opens") & (F.col("inside") == 1))
    tokens = F.when(F.col("system"), F.lit(0)).otherwise(F.col("words"))
    before = Window.partitionBy("conv_id", "range").orderBy("inside").rowsBetween(Window.unboundedPreceding, -1)
    long = (tokens > turn_most).cast("int")
    running = lambda value, name: F.coalesce(F.sum(value).over(before), F.lit(0)) + F.col(name)
    return rows.withColumns({"pos": F.col("inside") + F.col("n_before"), "start": running(tokens, "words_before"), "split": 2 * running(long, "long_before") + long}).drop("c", "r", "opens", "n_before", "words_before", "long_before", "inside")


def read_back(windows: DataFrame) -> DataFrame:
    """One row per conversation, from the formatted windows alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    turn = r"(?s)<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>"
    read = windows.select(
        "conv_id",
        "window",
        F.length("formatted").alias("chars"),
        F.arrays_zip(F.regexp_extract_all("formatted", F.lit(turn), F.lit(1)).alias("role"), F.regexp_extract_all("formatted", F.lit(turn), F.lit(2)).alias("text")).alias("turns"),
        F.concat_ws("", F.transform("loss", lambda s: unescape(F.col("formatted").substr(s["start"].cast("int"), s["length"].cast("int"))))).alias("loss"),
    )
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(unescape(t["role"]), F.lit("\n"), unescape(t["text"]), F.lit("\n"))))
    parts = F.sort_array(F.collect_list(F.struct("window", said.alias("said"), "loss", F.size("turns").alias("n"), "chars")))
    all_ = read.groupBy("conv_id").agg(parts.alias("parts"))
    whole = lambda name: F.concat_ws("", F.transform("parts", lambda p: p[name]))
    total = lambda name: F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p[name])
    return all_.select("conv_id", total("n").alias("n_turns"), F.sha2(whole("said"), 256).alias("turns_sha256"), F.length(whole("loss")).cast("long").alias("loss_chars"), F.sha2(whole("loss"), 256).alias("loss_sha256"), total("chars").alias("formatted_chars"))


def oracle_sql(turns: str, own: int = OWN, history: int = HISTORY, turn_most: int = TURN_MOST) -> str:
    """DuckDB SQL for read_back(format_windows(...)) over the rows of `turns`, without formatting anything."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    escaped = lambda c: reduce(lambda x, e: f"replace({x}, {quote(e[0])}, {quote(e[1])})", _ESCAPES, c)
    return f"""
WITH given AS ({turns}),
turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM given),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM turns),
marked AS (SELECT *, pos = 1 AND role = 'system' AS sys, CASE WHEN pos = 1 AND role = 'system' THEN 0 ELSE len(regexp_extract_all(text, '{WORD}')) + 1 END AS tokens FROM placed),
starts AS (SELECT *, coalesce(sum(tokens) OVER before, 0)::BIGINT AS start, coalesce(sum((tokens > {turn_most})::INT) OVER before, 0)::BIGINT AS longs FROM marked
  WINDOW before AS (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
windowed AS (SELECT *, start // {own} + 2 * longs + (tokens > {turn_most})::INT AS w FROM starts),
following AS (SELECT *, min(start) OVER (PARTITION BY conv_id ORDER BY w RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_start FROM windowed),
sized AS (SELECT *, length({escaped("role")}) + length({escaped("text")}) + {len(TEXT + END)} AS chars, NOT sys AND next_start - start <= {history} AS again FROM following)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(chars + {len(TURN)}) + coalesce(sum(chars + {len(AGAIN)}) FILTER (again), 0) + (count(DISTINCT w) - 1) * coalesce(max(chars + {len(AGAIN)}) FILTER (sys), 0))::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id"""
