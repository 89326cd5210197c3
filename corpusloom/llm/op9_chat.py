"""Chat formatting with a grammar round trip, in built-in column functions only.

Grammar of the rendered text::

    conversation := turn*
    turn         := "### " role ": " text "\\n</turn>\\n"
    text         := what has no control string ("###", "</turn>") but with backslashes before it

A turn is first rendered as it is and parsed again. Where the parser does not give back the very turn
(its text holds a control string, or one behind backslashes), it is rendered at the next escape level: each
control string gets one more backslash than it had before it, which the parser takes off. Level 1
is reversible for every text, so the escalation ends there; ``round_trip`` reports the comparison.

Cases: null text and null role count as empty. Rows of a conversation go by (turn, role, text), null turns
first; repeated rows stay. A null ``conv_id`` is a conversation of its own. An empty table gives no rows.
Extra columns are ignored, whatever their names. A conversation becomes one string, so it must stay under 2 GB; in the query, which cuts the mask from UTF-32, under 500 million code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import table

OPEN, CLOSE = "### ", "\n</turn>\n"
#: Turns that the first aggregation puts together, before those blocks meet in their conversation.
BLOCK_TURNS = 256

#: Patterns with backslashes before it begin where the run of them does, so that long runs are passed once.
_CONTROL = "(###|</turn>)"
_PARSE = r"(?s)\A### ((?:[^\\:]|\\.)*+): (.*)\z"


def escape(text: Column) -> Column:
    """One more backslash before each control string; undone by ``unescape`` for every text."""
    return F.regexp_replace(text, r"(?<!\\)(\\*+)" + _CONTROL, r"\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<!\\)\\(\\*+)" + _CONTROL, "$1$2")


def _escape_role(role: Column) -> Column:
    return F.regexp_replace(role, r"([\\:<#])", r"\\$1")


def _render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), _escape_role(role), F.lit(": "), text, F.lit(CLOSE))


def segments(formatted: Column) -> Column:
    """The rendered turns of a text, without their closing marker; what follows the last marker is dropped."""
    parts = F.split(formatted, r"\n</turn>\n", -1)
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def parsed_role(segment: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(segment, _PARSE, 1), r"(?s)\\(.)", "$1")


def parsed_text(segment: Column) -> Column:
    """The text of a rendered turn; null, as no turn of the grammar, if a control string is in it without a backslash."""
    raw = F.regexp_extract(segment, _PARSE, 2)
    bare = F.regexp_replace(raw, r"(?<!\\)\\++" + _CONTROL, " ").rlike(_CONTROL)
    return F.when(~bare, unescape(raw))


def _comes_back(rendered: Column, role: Column, text: Column) -> Column:
    parts = segments(rendered)
    same = (F.size(parts) == 1) & (parsed_role(parts[0]) == role) & (parsed_text(parts[0]) == text)
    return F.coalesce(same, F.lit(False))


def judge_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, level, round_trip), one row per row of ``turns``: the level at which a turn is rendered, and whether it then comes back."""
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    role, text, level = F.col("role"), F.col("text"), F.col("level")
    rows = rows.withColumn("level", F.when(_comes_back(_render(role, text), role, text), 0).otherwise(1))
    return rows.withColumn("round_trip", (level == 0) | _comes_back(_rendered(role, text, level), role, text))


def _rendered(role: Column, text: Column, level: Column) -> Column:
    return _render(role, F.when(level == 0, text).otherwise(escape(text)))


def _joined(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows (formatted, spans, level, round_trip) of each group put together in order, the spans moved to their places.

    Offsets are a running sum in the exchange and order of the keys, so that a group takes one shuffle and time in proportion to its rows.
    """
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("at", F.coalesce(F.sum(F.length("formatted")).over(before), F.lit(0)).cast("int"))
    moved = F.transform("spans", lambda s: F.struct((s["start"] + F.col("at")).alias("start"), s["length"].alias("length")))
    part = F.struct("at", "formatted", moved.alias("spans"))  # no turn is empty, so no two have one place
    return (
        placed.groupBy(*keys)
        .agg(F.sort_array(F.collect_list(part)).alias("parts"), F.max("level").alias("level"), F.min("round_trip").alias("round_trip"))
        .select(*keys, F.array_join("parts.formatted", "").alias("formatted"), F.flatten("parts.spans").alias("spans"), "level", "round_trip")
    )


def format_chat(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans, level, round_trip.

    ``loss_spans`` are (start, length) in code points of ``formatted``: the (escaped) assistant texts. Turns go to their conversation in one shuffle, as role and text
    alone, and are rendered there; those from turn BLOCK_TURNS on are put together in blocks first, so that a very long conversation does not arrive
    turn by turn in one task.
    """
    rows = judge_turns(turns).withColumn("block", F.greatest(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(0)))
    head = F.length(F.lit(OPEN)) + F.length(_escape_role(F.col("role"))) + 2
    span = F.struct(head.alias("start"), (F.length("formatted") - head - len(CLOSE)).alias("length"))
    none = F.array().cast("array<struct<start:int,length:int>>")
    spans = F.when(F.col("role") == "assistant", F.array(span)).otherwise(none)

    def rendered(some: DataFrame) -> DataFrame:
        return some.withColumn("formatted", _rendered(F.col("role"), F.col("text"), F.col("level"))).withColumn("spans", spans)

    later = _joined(rendered(rows.filter("block > 0")), ["conv_id", "block"], ["turn", "role", "text"])
    first = rows.filter("block = 0").withColumn("spans", none)
    blocks = later.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("formatted").alias("text"), "level", "round_trip", "block", "spans")
    both = first.unionByName(blocks)
    own = F.col("block") == 0
    whole = both.withColumn("formatted", F.when(own, _rendered(F.col("role"), F.col("text"), F.col("level"))).otherwise(F.col("text")))
    whole = whole.withColumn("spans", F.when(own, spans).otherwise(F.col("spans")))
    return _joined(whole, ["conv_id"], ["block", "turn", "role", "text"]).withColumnRenamed("spans", "loss_spans")


def masked(formatted: Column, spans: Column) -> Column:
    """The unescaped texts of the spans. They are cut from UTF-32, where a code point's place is known; a letter before each keeps a byte order mark in it."""
    letter = F.encode(F.lit("x"), "UTF-32")
    cut = lambda wide, s: F.decode(F.concat(letter, F.substring(wide, 4 * s["start"] + 1, 4 * s["length"])), "UTF-32")
    texts = lambda wide: F.transform(spans, lambda s: unescape(F.substring(cut(wide, s), F.lit(2), s["length"])))
    return F.transform(F.array(F.encode(formatted, "UTF-32")), texts)[0]  # a variable, so that it is encoded once


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse the rendered text again: conv_id, formatted, loss_spans, turns (role, text)."""
    return formatted.select(
        "conv_id", "formatted", "loss_spans",
        F.transform(
            segments(F.col("formatted")), lambda s: F.struct(parsed_role(s).alias("role"), parsed_text(s).alias("text"))
        ).alias("turns"),
    )


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, whose texts hold escaped and plain control strings."""
    tricky = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text")
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = read_back(format_chat(turns))
    loss = F.array_join(masked(F.col("formatted"), F.col("loss_spans")), "")
    script = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(script.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP9_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id,
  count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(4 + length(regexp_replace(role, '([\\:<#])', '\\\1', 'g')) + 2
      + length(regexp_replace(text, '(###|</turn>)', '\\\1', 'g')) + 9)::BIGINT AS formatted_chars
FROM rows_ GROUP BY conv_id
"""
