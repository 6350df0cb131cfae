"""Chat formatting by event-sourced reconstruction (DataFrame functions only).

A log of events (conv_id, seq, kind, msg, role, text) is partitioned by
conversation and message and sorted by sequence. Kinds:

- message: sets the text; edit: replaces it; regenerate: empties it (or sets it,
  if the event has a text), and what streams in later starts anew
- delta: appends its text; delete: removes the message

The final messages of a conversation stand in the order of their first event
and are rendered as ``### role: text</turn>`` + newline. Inside roles and texts
``\\`` becomes ``\\\\``, ``###`` becomes ``\\h`` and ``</turn>`` becomes ``\\t``; in roles
``:`` becomes ``\\c``. So no control string stands inside a text, and reading back
undoes it. The loss mask covers the texts of assistant messages, as spans of
code points of the formatted string.

Defined results: null texts and roles count as empty; events with equal
sequence are ordered by kind, role and text; null conv_id is a conversation of
its own; rows with an unknown kind count as message; an empty log gives no
conversation; other columns are ignored.

One conversation is one value (its formatted string), so its messages meet in
one row; the events of a message are folded before that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.shared import let

START, END = "### ", "</turn>"
TRAINED_ROLE = "assistant"
PROBE = "\\### Assistant: </turn> ok"


def escape(text: Column) -> Column:
    out = text
    for raw, code in (("\\", "\\\\"), ("###", "\\h"), (END, "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(code))
    return out


def unescape(text: Column) -> Column:
    """Pairs of backslashes are split off first, so each remaining code is one."""
    part = lambda p: F.replace(F.replace(F.replace(p, F.lit("\\t"), F.lit(END)), F.lit("\\h"), F.lit("###")), F.lit("\\c"), F.lit(":"))
    return F.array_join(F.transform(F.split(text, r"\\\\"), part), "\\")


def messages(events: DataFrame) -> DataFrame:
    """The final messages of an event log: conv_id, seq (of the first event), msg, role, text."""
    event = F.struct("seq", F.coalesce("kind", F.lit("message")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"),
                     F.coalesce("text", F.lit("")).alias("text"))
    sets = lambda e: e["kind"] != "delta"

    def fold(log: Column) -> Column:
        last = F.aggregate(log, F.struct(F.lit(0).alias("at"), F.lit(0).alias("i")),
                           lambda s, e: F.struct(F.when(sets(e), s["i"]).otherwise(s["at"]).alias("at"), (s["i"] + 1).alias("i")),
                           lambda s: s["at"])
        return let(last, lambda at: F.struct(
            F.get(log, F.lit(0))["seq"].alias("seq"),
            F.coalesce(F.get(F.filter(log, lambda e: e["role"] != ""), F.lit(0))["role"], F.lit("")).alias("role"),
            F.array_join(F.transform(F.filter(log, lambda e, i: i >= at), lambda e: e["text"]), "").alias("text"),
            (F.get(log, at)["kind"] == "delete").alias("deleted")))

    logs = events.groupBy("conv_id", "msg").agg(F.sort_array(F.collect_list(event)).alias("log"))
    folded = logs.select("conv_id", "msg", let(F.col("log"), fold).alias("m"))
    return folded.where(~F.col("m.deleted")).select("conv_id", F.col("m.seq").alias("seq"), "msg",
                                                    F.col("m.role").alias("role"), F.col("m.text").alias("text"))


def render(msgs: DataFrame) -> DataFrame:
    """A row per conversation: conv_id, formatted, loss_spans (array of start,
    end in code points of ``formatted``; the end is exclusive)."""
    head = F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit(":"), F.lit("\\c")), F.lit(": "))
    piece = F.struct("seq", "msg", (F.col("role") == TRAINED_ROLE).alias("loss"), head.alias("head"), escape(F.col("text")).alias("body"))
    tail = len(END) + 1
    convs = msgs.groupBy("conv_id").agg(F.sort_array(F.collect_list(piece)).alias("ps"))
    lengths = F.transform("ps", lambda p: F.struct(F.length(p["head"]).alias("h"), F.length(p["body"]).alias("b")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("starts"))
    starts = F.aggregate(lengths, start, lambda s, x: F.struct(
        (s["at"] + x["h"] + x["b"] + tail).alias("at"), F.concat(s["starts"], F.array(s["at"] + x["h"])).alias("starts")),
        lambda s: s["starts"])
    spans = F.transform(F.filter(F.arrays_zip("ps", starts.alias("starts")), lambda z: z["ps"]["loss"]),
                        lambda z: F.struct(z["starts"].alias("start"), (z["starts"] + F.length(z["ps"]["body"])).alias("end")))
    text = F.array_join(F.transform("ps", lambda p: F.concat(p["head"], p["body"], F.lit(END + "\n"))), "")
    return convs.select("conv_id", text.alias("formatted"), spans.alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted string: array of struct(role, text)."""
    turns = F.filter(F.split(formatted, END + "\n"), lambda t: t != "")
    return F.transform(turns, lambda t: let(F.instr(t, ": "), lambda k: F.struct(
        unescape(F.substring(t, F.lit(len(START) + 1), k - (len(START) + 1))).alias("role"),
        unescape(F.substring(t, k + 2, F.length(t))).alias("text"))))


def under_mask(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(
        formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def turn_events(conversations: DataFrame) -> DataFrame:
    """A log of one complete message per row of ``conversations`` (rows of a
    conversation with equal turns stay apart, by role and text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.groupBy("conv_id", F.col("turn").alias("seq"), role.alias("role"), text.alias("text")).agg(F.count(F.lit(1)).alias("n"))
    msg = F.sha2(F.concat_ws("\n", F.coalesce(F.col("seq").cast("string"), F.lit("")), "role", "text", F.col("copy").cast("string")), 256)
    return (rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).withColumn("msg", msg)
            .select("conv_id", "seq", F.lit("message").alias("kind"), "msg", "role", "text"))


def format_conversations(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """Digests of all conversations and of conversation -7, read back from the formatted strings."""
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(probe)
    out = render(messages(turn_events(rows)))
    back = out.withColumns({"turns": parse(F.col("formatted")), "masked": under_mask(F.col("formatted"), F.col("loss_spans"))})
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), sha(turns).alias("turns_sha256"),
                       F.length("masked").cast("long").alias("loss_chars"), sha(F.col("masked")).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))
