"""Chat formatting by event-sourced reconstruction, with DataFrame functions only.

``fold_events`` turns a log into final messages. An event has a conversation, a sequence number, a message (any
orderable value; messages are in its order), a kind and a text:

* ``message``, ``edit``, ``regenerate`` set the message's text anew, and its role where one is given;
* ``delta`` adds its text at the end;
* ``regenerate`` also takes away every later message of the conversation that had its last event before it.

``render`` writes the messages of a conversation as one string and a loss mask, a run for each turn. In bodies and
roles ``\\``, ``<`` and ``[`` (and newlines in roles) are written as ``\\e``, ``\\l``, ``\\b`` (``\\n``), so no control string of this
template, or of others that begin with these characters, can come about inside a text, and ``read_back`` gets every text as it was.

Events are folded by (conversation, message), so that a long conversation's log is spread over tasks; what comes
together for each conversation is its final text, which the result holds as one value anyway.

A null text counts as empty, a null role as the empty role, and a null kind as ``message``. Null sequence numbers and messages
come first. Events that tie in their sequence number are taken in the order of their text. Repeated rows of a plain table are
separate turns; rows of the same turn are in the order of role and text. A null conversation is one of its own. No rows give no
conversations. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>\n"


def escape(text: Column) -> Column:
    for a, b in (("\\", "\\e"), ("<", "\\l"), ("[", "\\b")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column) -> Column:
    for a, b in (("[", "\\b"), ("<", "\\l"), ("\n", "\\n"), ("\\", "\\e")):
        text = F.replace(text, F.lit(b), F.lit(a))
    return text


def plain_events(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A table of finished turns as a log: each row is a message of its own."""
    rows = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    copy = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    return rows.withColumn("copy", copy).select("conv_id", F.lit(0).alias("seq"), F.struct("turn", "copy").alias("message"), F.lit("message").alias("kind"), "role", "text")


def fold_events(events: DataFrame, regenerates: bool = True) -> DataFrame:
    """(conv_id, message, role, text) of the messages that are left.

    regenerates: whether the log may have such events; without them conversations need not be sorted.
    """
    kind = F.coalesce("kind", F.lit("message"))
    event = F.struct(F.col("seq"), (kind == "delta").alias("adds"), F.coalesce("text", F.lit("")).alias("text"), F.col("role"))
    log = F.array_sort(F.collect_list(event))
    folded = events.groupBy("conv_id", "message").agg(log.alias("log"), F.max("seq").alias("last"), F.max(F.when(kind == "regenerate", F.col("seq"))).alias("again"))
    start = F.array_max(F.transform(F.col("log"), lambda e, i: F.when(~e["adds"], i).otherwise(F.lit(0))))
    kept = F.slice("log", start + 1, F.size("log"))
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull())
    out = folded.withColumn("text", F.when(F.size("log") == 1, F.col("log")[0]["text"]).otherwise(F.array_join(F.transform(kept, lambda e: e["text"]), "")))
    out = out.withColumn("role", F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")))
    if regenerates:
        before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("cut", F.max("again").over(before)).where("cut is null or last > cut")
    return out.select("conv_id", "message", "role", "text")


def render(messages: DataFrame, learn: str = "assistant") -> DataFrame:
    """(conv_id, formatted, mask): mask has for each turn how many code points come before its body, how many the body has, and whether it is learned."""
    head = F.concat(F.lit(TURN), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    body = escape(F.col("text"))
    piece = F.struct(F.col("message"), head.alias("head"), body.alias("body"), (F.col("role") == learn).alias("loss"))
    turns = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(piece)).alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    mask = F.transform("turns", lambda t: F.struct(F.length(t["head"]).alias("skip"), F.length(t["body"]).alias("keep"), t["loss"].alias("loss")))
    return turns.select("conv_id", text.alias("formatted"), mask.alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>, learned array<string>) from the rendered strings and masks alone."""
    parts = F.split("formatted", r"<\|end\|>\n")
    parts = F.slice(parts, 1, F.size(parts) - 1)
    cut = formatted.select("conv_id", "formatted", "mask", parts.alias("parts"))

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        return F.struct(unescape(F.substr(role, F.lit(len(TURN) + 1))).alias("role"), unescape(F.substr(p, F.length(role) + 2)).alias("text"))

    masked = F.zip_with("parts", "mask", lambda p, m: F.when(m["loss"], unescape(F.substr(p, m["skip"] + 1, m["keep"]))))
    return cut.select("conv_id", "formatted", F.transform("parts", turn).alias("turns"), F.filter(masked, lambda x: x.isNotNull()).alias("learned"))
