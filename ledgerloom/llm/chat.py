"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log holds events of conversations: ``delta`` appends text to a turn, ``edit``
replaces what the turn holds so far, ``regenerate`` empties the turn and takes
back all later turns. Events are ordered by ``seq`` within their conversation,
folded into final messages, and rendered with turn marks and a loss mask.

Template: ``<|im_start|>role\\n`` text ``<|im_end|>\\n``. Inside texts every ``<``
that reaches a ``|`` over any number of backslashes gets one more backslash, so
no text can hold a mark, and taking one away restores it. Roles are URL-encoded.

The output keeps a conversation as segments (text, loss): joined they are the
formatted conversation, and those with ``loss`` are the assistant's texts.

Definitions: null texts and roles are empty, unknown events are ignored, events
of equal ``seq`` are ordered by turn, event and text. Null conv_ids form one
conversation. A conversation without a message left is not returned. Extra
columns are ignored. A conversation is one output row and one group; before
that, its deltas are joined turn by turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import typed

START, END = "<|im_start|>", "<|im_end|>\n"
TRAINED = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def messages(log: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: what is left when all events are folded."""
    events = typed(log, conv_id="bigint", seq="bigint", turn="bigint", event="string", role="string", text="string")
    events = events.filter(F.col("event").isin("delta", "edit", "regenerate")).fillna("", ["role", "text"])
    order = ["seq", "turn", "event", "text"]
    later = Window.partitionBy("conv_id").orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    taken_back = F.min(F.when(F.col("event") == "regenerate", F.col("turn"))).over(later)
    events = events.withColumn("back", taken_back).filter("back is null or back > turn")
    # An edit is last of its turn's edits if none comes later; deltas before it are gone.
    of_turn = Window.partitionBy("conv_id", "turn").orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    edited = F.max(F.when(F.col("event") == "edit", F.lit(1))).over(of_turn)
    events = events.withColumn("gone", edited).filter("gone is null")
    pieces = F.array_sort(F.collect_list(F.struct(*order, "role")))
    return events.groupBy("conv_id", "turn").agg(pieces.alias("p")).select(
        "conv_id", "turn", F.col("p")[0]["role"].alias("role"), F.array_join(F.transform("p", lambda e: e["text"]), "").alias("text")
    )


def render(turns: DataFrame) -> DataFrame:
    """conv_id, segments: each conversation's formatted text with its loss mask."""
    one = turns.select("conv_id", F.struct(
        "turn",
        F.concat(F.lit(START), F.url_encode("role"), F.lit("\n")).alias("head"),
        escape(F.col("text")).alias("body"),
        (F.col("role") == TRAINED).alias("loss"),
    ).alias("m"))
    listed = one.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("m"))

    def segments(m: Column) -> Column:
        return F.array(
            F.struct(m["head"].alias("text"), F.lit(False).alias("loss")),
            F.struct(m["body"].alias("text"), m["loss"].alias("loss")),
            F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")),
        )

    return listed.select("conv_id", F.flatten(F.transform("m", segments)).alias("segments"))


def formatted(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def parse(text: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    # The last mark ends the string, so the split leaves one empty piece behind it.
    pieces = F.split(text, r"<\|im_end\|>\n")
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    head = r"^<\|im_start\|>([^\n]*)\n"
    return F.transform(pieces, lambda p: F.struct(
        F.url_decode(F.regexp_extract(p, head, 1)).alias("role"), unescape(F.regexp_replace(p, head, "")).alias("text")
    ))


def digests(rendered: DataFrame) -> DataFrame:
    """Counts and digests of rendered conversations, read back from their segments."""
    text = formatted(F.col("segments"))
    masked = F.filter("segments", lambda s: s["loss"])
    back = rendered.select(
        "conv_id", parse(text).alias("turns"), F.char_length(text).cast("long").alias("formatted_chars"),
        F.array_join(F.transform(masked, lambda s: unescape(s["text"])), "").alias("loss"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), "formatted_chars",
    )


def event_log(conversations: DataFrame) -> DataFrame:
    """The log that streams a table of turns: every row becomes two deltas.

    Rows are turns in order of (turn, role, text); repeated rows stay apart.
    """
    rows = typed(conversations, conv_id="bigint", turn="bigint", role="string", text="string").fillna("", ["role", "text"])
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    half = F.floor(F.char_length("text") / 2).cast("int")
    parts = F.array(F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.char_length("text")))
    return rows.withColumn("turn", place).select(
        "conv_id", "turn", "role", F.lit("delta").alias("event"), F.posexplode(parts).alias("k", "text")
    ).select("conv_id", (2 * F.col("turn") + F.col("k")).alias("seq"), "turn", "event", "role", "text")
