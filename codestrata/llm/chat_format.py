r"""Chat formatting: conversations to windows of text with a loss mask.

Prefix sums of turn tokens deal the turns of a conversation to windows within a token budget, cut only between turns.
The stream of tokens is cut at every multiple of the budget: turns that lie between two cuts share a window, and a turn
that a cut falls into is a window of its own, whole. So every window of two or more new turns holds at most the
budget of new tokens. A turn costs its words and one token for its marks; a system turn, which is repeated anyway,
costs one. A window begins with the last system turn before it and a limited history (both repeated, never trained
on); then come its new turns. The assistant turns among these are the targets: each assistant text is a target in
exactly one window.

Template, for each turn: "### ", role, ": ", text, "</turn>\n". Inside roles and texts "\" becomes "\\", "<" becomes
"\l" and "#" becomes "\h", so neither mark can occur there; in roles ":" becomes "\c" as well. Left to right the
escapes are read back without loss.

DataFrame functions only. Prefix sums have two levels, bins of turn numbers and the turns inside a bin, so that a
conversation of any length, or all rows without a conv_id, are spread. No conversation is gathered: what meets in one
row is a window, of as many turns as the budget has tokens at most.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from . import shared

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
#: Tokens of new turns in a window, and of the history that is repeated before them.
SPAN_TOKENS, HISTORY_TOKENS = 512, 128
#: Turn numbers of a bin of the prefix sums.
BIN_TURNS = 1024

_ESCAPES = [("<", "l"), ("#", "h"), (":", "c")]


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for plain, code in _ESCAPES[: 3 if role else 2]:
        out = F.replace(out, F.lit(plain), F.lit("\\" + code))
    return out


def unescape(text: Column) -> Column:
    """The inverse of escape: doubled backslashes are told apart first, from left to right."""

    def plain(piece: Column) -> Column:
        for char, code in _ESCAPES:
            piece = F.replace(piece, F.lit("\\" + code), F.lit(char))
        return piece

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), plain), "\\")


def _meet(rows: DataFrame, table: DataFrame, on: dict[str, str]) -> DataFrame:
    """rows joined with the rows of table whose columns on[k] equal their k, null with null; table's names get a dash before."""
    named = table.select(*[F.col(c).alias("_" + c) for c in table.columns])
    return rows.join(named, functools.reduce(Column.__and__, [rows[k].eqNullSafe(named["_" + c]) for k, c in on.items()]))


def place_turns(turns: DataFrame, span_tokens: int = SPAN_TOKENS) -> DataFrame:
    """(conv_id, place, tokens, start, span, role, text) by turn, written to the shared folder.

    place counts a conversation's turns from 1, start the tokens before it; the turns of a window share a span.
    """
    numeric = isinstance(turns.schema["turn"].dataType, NumericType)
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    tokens = F.when(F.col("role") == "system", 1).otherwise(F.size(shared.words(F.col("text"))) + 1)
    bin_ = F.floor(F.col("turn") / BIN_TURNS) if numeric else F.lit(0)
    # a key of both is equal where both are null, too, so that the join and the windows after it need one shuffle
    rows = rows.select("*", F.struct("conv_id", bin_.cast("long").alias("bin")).alias("key"), tokens.cast("long").alias("tokens"))
    # what the bins before hold, then the turns before inside the bin
    bins = Window.partitionBy("key.conv_id").orderBy("key.bin").rowsBetween(Window.unboundedPreceding, -1)
    own = rows.groupBy("key").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("turns"))
    sums = own.select(F.col("key").alias("_key"), *[F.coalesce(F.sum(c).over(bins), F.lit(0)).alias("_" + c) for c in ("tokens", "turns")])
    inside = Window.partitionBy("key").orderBy("turn", "role", "text")
    start = F.col("_tokens") + F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")
    placed = rows.join(sums, rows["key"] == sums["_key"]).select(
        "conv_id", (F.col("_turns") + F.row_number().over(inside)).alias("place"), "tokens", start.alias("start"), "role", "text"
    )
    block = lambda at: F.floor(at / span_tokens).cast("long")
    cut = block(F.col("start")) != block(F.col("start") + F.col("tokens") - 1)
    return shared.stash(placed.withColumn("span", 2 * block(F.col("start")) + cut.cast("long")), "turns")


def window_heads(placed: DataFrame, span_tokens: int, history_tokens: int) -> DataFrame:
    """(conv_id, span, window_id, rule, later): a row per window.

    rule: the place of the last system turn before the window; later: the next windows, (window_id, first), first being
    the tokens before the window, as many as a turn of this one can be history of. Only these numbers of a
    conversation's windows and system turns are sorted together.
    """
    heads = placed.groupBy("conv_id", "span").agg(F.min("place").alias("place"), F.min("start").alias("first"))
    rules = placed.where(F.col("role") == "system").select("conv_id", F.lit(None).cast("long").alias("span"), "place", F.lit(None).cast("long").alias("first"))
    order = Window.partitionBy("conv_id").orderBy("place", F.col("span").isNull())
    before = F.last(F.when(F.col("span").isNull(), F.col("place")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    ruled = heads.unionByName(rules).withColumn("rule", before).where("span is not null")
    numbered = ruled.withColumn("window_id", (F.row_number().over(order) - 1).cast("long"))
    near = 2 * (math.ceil(history_tokens / span_tokens) + 1)
    later = F.collect_list(F.struct("window_id", "first")).over(order.rowsBetween(1, near))
    return numbered.select("conv_id", "span", "window_id", "rule", later.alias("later"))


def format_windows(
    turns: DataFrame, span_tokens: int = SPAN_TOKENS, history_tokens: int = HISTORY_TOKENS
) -> DataFrame:
    """Rows (conv_id, window_id, n_repeated, formatted, loss_spans) of conversations (conv_id, turn, role, text).

    window_id counts a conversation's windows from 0. loss_spans: array of (start, length) in code points of formatted,
    the assistant texts to train on. n_repeated: how many turns at the window's start are repeated and not trained on.
    Null texts and roles count as empty, rows with a null conv_id are one conversation. Turns are ordered by turn, then
    role, then text, so ties and repeated rows have a defined order; null turns come first. A text of any length stays
    whole. Other columns are not looked at. An empty table gives no windows.
    """
    placed = place_turns(turns, span_tokens)
    heads = shared.stash(window_heads(placed, span_tokens, history_tokens), "windows")
    system = F.col("role") == "system"
    into = lambda w, part: F.struct(w.alias("window_id"), F.lit(part).alias("part"))
    repeats = F.transform(
        F.filter("_later", lambda n: ~system & (F.col("start") >= n["first"] - history_tokens)), lambda n: into(n["window_id"], 1)
    )
    own = _meet(placed, heads, {"conv_id": "conv_id", "span": "span"})
    own = own.withColumn("to", F.explode(F.concat(F.array(into(F.col("_window_id"), 2)), repeats)))
    ruling = _meet(placed.where(system), heads.where("rule is not null"), {"conv_id": "conv_id", "place": "rule"})
    ruling = ruling.withColumn("to", into(F.col("_window_id"), 0))
    turn = F.struct(
        "to.part",
        "place",
        F.concat(F.lit(OPEN), escape(F.col("role"), role=True), F.lit(MIDDLE)).alias("head"),
        escape(F.col("text")).alias("body"),
        (F.col("role") == "assistant").alias("assistant"),
    )
    columns = ("conv_id", F.col("to.window_id").alias("window_id"), turn.alias("x"))
    windows = own.select(*columns).unionByName(ruling.select(*columns)).groupBy("conv_id", "window_id").agg(F.sort_array(F.collect_list("x")).alias("turns"))

    def step(state: Column, t: Column) -> Column:
        body = (state["at"] + F.length(t["head"])).cast("long")
        size = F.length(t["body"]).cast("long")
        target = F.array(F.struct(body.alias("start"), size.alias("length")))
        return F.struct(
            (body + size + len(CLOSE)).cast("long").alias("at"),
            F.when(t["assistant"] & (t["part"] == 2), F.concat(state["spans"], target)).otherwise(state["spans"]).alias("spans"),
        )

    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    return windows.select(
        "conv_id",
        "window_id",
        F.size(F.filter("turns", lambda t: t["part"] < 2)).alias("n_repeated"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "").alias("formatted"),
        F.aggregate("turns", empty, step)["spans"].alias("loss_spans"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """A row per conversation, made from the windows alone: turns (array of role and text) and targets (array of texts)."""
    parts = F.slice(
        F.split("formatted", "</turn>\n", -1), F.col("n_repeated") + 1, F.greatest(F.lit(0), F.size(F.split("formatted", "</turn>\n", -1)) - 1 - F.col("n_repeated"))
    )

    def turn(part: Column) -> Column:
        role = F.substring_index(F.substring(part, len(OPEN) + 1, 1 << 30), MIDDLE, 1)
        text = F.substr(part, F.length(role) + F.lit(len(OPEN) + len(MIDDLE) + 1))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    read = windows.select(
        "conv_id",
        F.struct(
            "window_id",
            F.transform(parts, turn).alias("turns"),
            F.transform(
                "loss_spans", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int")))
            ).alias("targets"),
            F.length("formatted").cast("long").alias("chars"),
        ).alias("w"),
    )
    return (
        read.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("w")).alias("w"))
        .select(
            "conv_id",
            F.flatten(F.transform("w", lambda x: x["turns"])).alias("turns"),
            F.flatten(F.transform("w", lambda x: x["targets"])).alias("targets"),
            F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x["chars"]).alias("formatted_chars"),
        )
    )


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = shared.read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(hard).alias("text"),
    )
    back = read_back(format_windows(table.unionByName(extra)))
    all_turns = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(all_turns, 256).alias("turns_sha256"),
        F.length(F.array_join("targets", "")).cast("long").alias("loss_chars"),
        F.sha2(F.array_join("targets", ""), 256).alias("loss_sha256"),
        "formatted_chars",
    )


#: DuckDB: a window begins where the block of tokens changes and around every turn that a cut falls into.
OP10_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), n AS (
  SELECT *, CASE WHEN role = 'system' THEN 1 ELSE 1 + len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS tokens,
    6 + length(replace(replace(replace(replace(role, '\', '\\'), '<', '\l'), '#', '\h'), ':', '\c'))
      + length(replace(replace(replace(text, '\', '\\'), '<', '\l'), '#', '\h')) + 8 AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM t
), p AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY place) AS until FROM n),
c AS (SELECT *, until - tokens AS start, (until - tokens) // 512 AS block, (until - 1) // 512 <> (until - tokens) // 512 AS cut FROM p),
b AS (SELECT *, CASE WHEN cut OR coalesce(lag(cut) OVER o OR lag(block) OVER o <> block, true) THEN 1 ELSE 0 END AS opens FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY place)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY conv_id ORDER BY place) AS span FROM b),
w AS (SELECT conv_id, span, min(place) AS place, min(start) AS first FROM s GROUP BY conv_id, span),
h AS (SELECT w.conv_id, w.span, coalesce(sum(s.chars) FILTER (s.role <> 'system' AND s.start >= w.first - 128), 0)
    + coalesce(max_by(s.chars, s.place) FILTER (s.role = 'system'), 0) AS again
  FROM w LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.place < w.place GROUP BY w.conv_id, w.span),
f AS (SELECT conv_id, sum(again) AS again FROM h GROUP BY conv_id)
SELECT s.conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) + any_value(f.again) AS BIGINT) AS formatted_chars
FROM s JOIN f ON s.conv_id IS NOT DISTINCT FROM f.conv_id GROUP BY s.conv_id
"""
