"""Chat logs folded into final messages and rendered with one template; DataFrame functions only.

A log is a table of events (conv_id, seq, turn, kind, role, text). Kinds:

* message: a complete message, or the start of a streamed one;
* delta: text appended to the turn's latest message;
* edit: new text of the turn's latest message, in place of all before;
* regenerate: the turn's latest message begins anew with this text, and what was logged before it for
  later turns goes, as those turns answered the old version.

Logs are partitioned by conversation once and sorted by sequence; every later step keeps that
partitioning. Defined cases: a null text is empty, a null role is an empty role, an unknown or null
kind is a message, a null turn or seq sorts first, events tied in seq are taken in the order of turn,
kind, role and text, repeated rows are events of their own, a delta before any message starts one.
Other columns of the log are ignored. A conversation is the unit of the output: it becomes one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What opens and closes a turn. Both begin with <, which escaped text never holds.
OPEN, CLOSE = "<turn ", "\n</turn>\n"
#: Characters with a meaning in the template, and what stands for them. The backslash comes first.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))
EVENTS = ("conv_id", "seq", "turn", "kind", "role", "text")


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    """Undoes escape(): every backslash of coded text starts a pair, so the pairs can be undone in turn, its own last."""
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def reconstruct(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, at, role, text); at is the sequence at which the message began."""
    logs = events.select(
        "conv_id", "seq", "turn", F.coalesce("kind", F.lit("message")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).repartition("conv_id")
    order = ["seq", "turn", "kind", "role", "text"]
    in_conversation = Window.partitionBy("conv_id").orderBy(*order)
    in_turn = Window.partitionBy("conv_id", "turn").orderBy("n")
    starts = ~F.col("kind").isin("delta", "edit", "regenerate")
    numbered = logs.withColumn("n", F.row_number().over(in_conversation)).withColumn("anew", F.when(F.col("kind") == "regenerate", F.col("n")))
    numbered = numbered.withColumn("own_anew", F.max("anew").over(Window.partitionBy("conv_id", "turn")))
    # the latest regeneration of an earlier turn: each turn's own stands at its first event
    earlier = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "n")
    turn_first = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("n")) == 1
    numbered = numbered.withColumn("turn_anew", F.when(turn_first, F.col("own_anew")))
    numbered = numbered.withColumn("before", F.max("turn_anew").over(earlier.rowsBetween(Window.unboundedPreceding, -1)))
    numbered = numbered.withColumn("before", F.first("before").over(in_turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    alive = numbered.where(F.col("before").isNull() | (F.col("n") > F.col("before")))
    message = F.sum(starts.cast("int")).over(in_turn.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    alive = alive.withColumn("message", F.greatest(message, F.lit(1)))
    of_message = Window.partitionBy("conv_id", "turn", "message")
    alive = alive.withColumn("reset", F.max(F.when(F.col("kind") != "delta", F.col("n"))).over(of_message))
    final = alive.where(F.col("reset").isNull() | (F.col("n") >= F.col("reset")) | starts)
    texts = F.sort_array(F.collect_list(F.struct("n", F.when(F.col("reset").isNull() | (F.col("n") >= F.col("reset")), F.col("text")).alias("text"))))
    return final.groupBy("conv_id", "turn", "message").agg(
        F.min("n").alias("at"), F.min_by("role", "n").alias("role"), F.array_join(F.transform(texts, lambda e: e["text"]), "").alias("text")
    ).select("conv_id", "turn", "at", "role", "text")


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_mask) of messages; loss_mask has [start, end) in code points of every assistant text."""
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(">\n"))
    body = escape(F.col("text"))
    pieces = messages.select("conv_id", "turn", "at", (F.col("role") == "assistant").alias("learn"), F.length(head).alias("head"), F.length(body).alias("body"), F.concat(head, body, F.lit(CLOSE)).alias("piece"))
    turns = F.sort_array(F.collect_list(F.struct("turn", "at", "learn", "head", "body", "piece")))
    grouped = pieces.groupBy("conv_id").agg(turns.alias("turns"))
    # ends of the pieces, as running sums
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    folded = F.aggregate(
        "turns",
        start,
        lambda acc, t: F.struct(
            (acc["at"] + t["head"] + t["body"] + F.lit(len(CLOSE))).alias("at"),
            F.when(t["learn"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + t["head"]).alias("start"), (acc["at"] + t["head"] + t["body"]).alias("end"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return grouped.select("conv_id", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), folded.alias("loss_mask"))


def parse(formatted: DataFrame) -> DataFrame:
    """Reads rendered conversations back: adds turns (role and text of each) and loss_texts."""
    pieces = F.slice(F.split("formatted", OPEN, -1), F.lit(2), F.greatest(F.size(F.split("formatted", OPEN, -1)) - 1, F.lit(0)))
    turns = F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring_index(p, ">\n", 1)).alias("role"),
            unescape(_body(p)).alias("text"),
        ),
    )
    loss = F.transform("loss_mask", lambda s: unescape(F.substring("formatted", s["start"] + 1, s["end"] - s["start"])))
    return formatted.select("*", turns.alias("turns"), loss.alias("loss_texts"))


def _body(piece: Column) -> Column:
    head = F.length(F.substring_index(piece, ">\n", 1)) + 2
    return F.substring(piece, head + 1, F.length(piece) - head - len(CLOSE))


def conversation_events(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as a log in which every row is a complete message."""
    return conversations.select("conv_id", F.col("turn").alias("seq"), "turn", F.lit("message").alias("kind"), "role", "text")


def format_conversations(events: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_mask) of a log: reconstruct(), then render()."""
    return render(reconstruct(events))


def digest(formatted: DataFrame) -> DataFrame:
    """Figures of rendered conversations, all read back from the rendered string."""
    back = parse(formatted)
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
