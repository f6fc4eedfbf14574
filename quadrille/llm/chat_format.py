"""Chat formatting by event-sourced reconstruction, in DataFrame operations only.

A conversation is a log of events, ordered by sequence number. A message event starts a message,
a delta appends to it, an edit replaces its text, a regenerate empties it and abandons later
messages that were begun before. Folding keeps, for each message, the last event that sets its
text and the deltas after it; the messages are then rendered with a template and a loss mask.

Template: each turn is <|role|> text <|end|>, without the spaces here. Inside texts and roles the
backslash becomes \\e, < becomes \\l and, in roles, | becomes \\p; so no text holds a marker, and the way
back is exact. The loss mask is a list of spans of the formatted string: assistant texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EVENT_COLUMNS = ["conv_id", "seq", "op", "msg", "role", "text"]
END = "<|end|>"


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\e")), F.lit("<"), F.lit("\\l"))
    return F.replace(out, F.lit("|"), F.lit("\\p")) if role else out


def unescape(text: Column) -> Column:
    for mark, plain in (("\\l", "<"), ("\\p", "|"), ("\\e", "\\")):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def fold_events(events: DataFrame) -> DataFrame:
    """events (conv_id, seq, op, msg, role, text) -> (conv_id, msg, role, text): the final messages.

    op: message, delta, edit or regenerate; another or null op is read as message. Events are
    ordered by seq, ties by op (message before edit before regenerate before delta), then text. A null text
    is empty. The role is that of the message's first event with one, or empty. Repeated deltas
    count as often as they come.
    """
    op = F.when(F.col("op").isin("delta", "edit", "regenerate"), F.col("op")).otherwise("message")
    rank = F.when(op == "message", 0).when(op == "edit", 1).when(op == "regenerate", 2).otherwise(3)
    e = events.select("conv_id", "msg", "role", F.coalesce("text", F.lit("")).alias("text"), op.alias("op"), F.struct("seq", rank.alias("r"), F.coalesce("text", F.lit("")).alias("t")).alias("at"))
    conv = W.partitionBy("conv_id")
    earlier = conv.orderBy("msg").rangeBetween(W.unboundedPreceding, -1)
    e = e.withColumn("msg", F.col("msg").cast("long"))
    e = e.withColumn("cut", F.max(F.when(F.col("op") == "regenerate", F.col("at"))).over(earlier))
    e = e.where("cut is null or at > cut")
    e = e.withColumn("reset", F.max(F.when(F.col("op") != "delta", F.col("at"))).over(W.partitionBy("conv_id", "msg")))
    e = e.withColumn("live", F.col("reset").isNull() | (F.col("at") >= F.col("reset")))
    piece = F.when(F.col("live"), F.struct("at", F.when(F.col("op") == "regenerate", "").otherwise(F.col("text")).alias("x")))
    return e.groupBy("conv_id", "msg").agg(
        F.coalesce(F.min_by("role", F.when(F.col("role").isNotNull(), F.col("at"))), F.lit("")).alias("role"),
        F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["x"]), "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """messages (conv_id, msg, role, text) -> (conv_id, formatted, loss_mask array<struct<start, length>>).

    Start counts characters from 0. Turns are ordered by msg, ties by role, then text; each row is a turn.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit("<|"), escape(role, True), F.lit("|>"))
    turns = messages.select("conv_id", "msg", role.alias("role"), head.alias("head"), escape(text).alias("body"))
    turns = turns.select("*", F.concat("head", "body", F.lit(END)).alias("piece"))
    ordered = W.partitionBy("conv_id").orderBy("msg", "role", "body")
    turns = turns.withColumns({"turn": F.row_number().over(ordered), "stop": F.sum(F.length("piece").cast("long")).over(ordered.rowsBetween(W.unboundedPreceding, 0))})
    start = F.col("stop") - F.length("piece") + F.length("head")
    mask = F.when(F.col("role") == "assistant", F.struct(start.alias("start"), F.length("body").cast("long").alias("length")))
    return turns.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "piece"))), lambda p: p["piece"]), "").alias("formatted"),
        F.array_sort(F.collect_list(mask)).alias("loss_mask"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>."""
    parts = F.split(formatted, r"<\|end\|>", -1)

    def turn(part):
        cut = F.instr(part, F.lit("|>"))
        return F.struct(unescape(F.substring(part, F.lit(3), cut - 3)).alias("role"), unescape(F.substring(part, cut + 2, F.length(part))).alias("text"))

    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)


def loss_texts(formatted: Column, loss_mask: Column) -> Column:
    return F.transform(loss_mask, lambda m: unescape(F.substring(formatted, (m["start"] + 1).cast("int"), m["length"].cast("int"))))


def format_chats(events: DataFrame) -> DataFrame:
    """events -> (conv_id, formatted, loss_mask), one row for each conversation.

    Events without a conv_id form one conversation with a null id. An empty table gives an
    empty table. A conversation becomes one string, so one conversation must fit in a task; the number of
    conversations is not limited. Other columns are not looked at.
    """
    return render(fold_events(events.select(*EVENT_COLUMNS)))


def message_log(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text), each a finished turn, as events. Turns that repeat a number stay apart:
    they are ordered by role, then text, and numbered anew."""
    text = F.coalesce("text", F.lit(""))
    at = W.partitionBy("conv_id").orderBy("turn", "role", text)
    return conversations.select("conv_id", F.row_number().over(at).cast("long").alias("seq"), F.lit("message").alias("op"), F.row_number().over(at).cast("long").alias("msg"), "role", text.alias("text"))
