"""Operator 4, chat formatting: event-sourced reconstruction.

A log holds events (conversation, sequence number, message, kind, role, text). Events are
taken by conversation in order of their number and folded: `delta` appends to its message,
`edit` replaces its text, `regenerate` empties it, so that the deltas after it build it
anew, `delete` removes it. A message stands where its first event stood and has the role
of its last event that names one. The messages are rendered with a template, and can be
read back from what was rendered.

Template. A user's turn is `[INST] text [/INST]`, an assistant's `<s>text</s>`, any other
`<<SYS>>role\\ntext<</SYS>>`; nothing stands between turns. Control strings in a text or role are
replaced by the escape sign and a letter, the sign itself first, so texts that hold control
strings can't end a turn and come back unchanged.

Everything is built-in functions; one shuffle brings a message together and one a
conversation. A rendered conversation is one value, so it is the unit that has to fit a task.

Defined cases. Null text is empty. A null role is rendered by a sign of its own and read
back as null; digests take it as empty. Null conversation ids form one conversation. Events
of equal number go by kind, role and text; messages that begin at equal numbers go by role
and text, as they are in the end. Repeated rows are events of their own.
An empty log gives an empty result. Extra columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drumlin.llm.common import let

# The template's control strings and the letters that stand for them after the sign.
SIGN = "␛"
CONTROL = {SIGN: "e", "[INST]": "i", "[/INST]": "j", "<s>": "s", "</s>": "t", "<<SYS>>": "y", "<</SYS>>": "z"}
NEW_LINE, NO_ROLE = SIGN + "n", SIGN + "0"
USER, ASSISTANT = "user", "assistant"


def escape(text: Column) -> Column:
    for string, letter in CONTROL.items():
        text = F.replace(text, F.lit(string), F.lit(SIGN + letter))
    return text


def unescape(text: Column) -> Column:
    for string, letter in reversed(CONTROL.items()):
        text = F.replace(text, F.lit(SIGN + letter), F.lit(string))
    return text


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, messages): each message with role and text, in order.

    `events` has conv_id, seq, message, kind, role and text; null kind means delta. The
    first aggregation brings the events of a message together and folds them, the second
    lines the messages of a conversation up; so a long conversation's events are folded by
    many tasks and only finished messages meet in one."""
    event = F.struct(F.col("seq"), F.coalesce(F.col("kind"), F.lit("delta")).alias("kind"), F.col("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    logs = events.select("conv_id", "message", event.alias("event")).groupBy("conv_id", "message").agg(F.sort_array(F.collect_list("event")).alias("log"))

    def folded(log: Column) -> Column:
        # After the last reset of a message only deltas follow; an edit is its own first piece.
        last = F.coalesce(F.array_max(F.transform(log, lambda e, i: F.when(e["kind"] != "delta", i))), F.lit(0))
        tail = let(last, lambda k: F.filter(log, lambda e, i: (i >= k) & e["kind"].isin("delta", "edit")))
        roles = F.filter(F.transform(log, lambda e: e["role"]), lambda r: r.isNotNull())
        return F.when(F.element_at(log, -1)["kind"] != "delete", F.struct(
            log[0]["seq"].alias("seq"), F.element_at(F.concat(F.array(F.lit(None).cast("string")), roles), -1).alias("role"), F.array_join(F.transform(tail, lambda e: e["text"]), "").alias("text"),
        ))

    messages = logs.select("conv_id", let(F.col("log"), folded).alias("m")).groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("messages"))
    return messages.select("conv_id", F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"))).alias("messages"))


def render(messages: Column) -> Column:
    def turn(m: Column) -> Column:
        text = escape(m["text"])
        role = F.coalesce(F.replace(escape(m["role"]), F.lit("\n"), F.lit(NEW_LINE)), F.lit(NO_ROLE))
        other = F.concat(F.lit("<<SYS>>"), role, F.lit("\n"), text, F.lit("<</SYS>>"))
        return F.when(m["role"] == USER, F.concat(F.lit("[INST] "), text, F.lit(" [/INST]"))).when(m["role"] == ASSISTANT, F.concat(F.lit("<s>"), text, F.lit("</s>"))).otherwise(other)

    return F.array_join(F.transform(messages, turn), "")


def read_back(rendered: Column) -> Column:
    """The messages of a rendered conversation. A turn's end is the only place where a
    closing control string can stand, so the text is split there."""
    turns = F.array_remove(F.split(rendered, r"(?<=\[/INST\]|</s>|<</SYS>>)"), "")

    def message(t: Column) -> Column:
        n = F.char_length(t)
        head = F.substring_index(t, "\n", 1)
        role = F.substr(head, F.lit(8), F.char_length(head) - 7)
        other = F.when(role != NO_ROLE, unescape(F.replace(role, F.lit(NEW_LINE), F.lit("\n"))))
        return (
            F.when(t.startswith("[INST] "), F.struct(F.lit(USER).alias("role"), unescape(F.substr(t, F.lit(8), n - 15)).alias("text")))
            .when(t.startswith("<s>"), F.struct(F.lit(ASSISTANT).alias("role"), unescape(F.substr(t, F.lit(4), n - 7)).alias("text")))
            .otherwise(F.struct(other.alias("role"), unescape(F.substr(t, F.char_length(head) + 2, n - F.char_length(head) - 9)).alias("text")))
        )

    return F.transform(turns, message)


def format_conversations(events: DataFrame) -> DataFrame:
    """(conv_id, formatted): every conversation of the log, rendered."""
    return fold_events(events).select("conv_id", render(F.col("messages")).alias("formatted"))


def with_loss_mask(formatted: DataFrame) -> DataFrame:
    """Adds `turns`, read back from the text, and `loss_text`, what the loss is taken on:
    the assistants' texts between <s> and </s>, unescaped, in order."""
    read = formatted.withColumn("turns", read_back(F.col("formatted")))
    return read.withColumn("loss_text", F.array_join(F.transform(F.filter("turns", lambda m: m["role"] == ASSISTANT), lambda m: m["text"]), ""))


def digests(formatted: DataFrame) -> DataFrame:
    """One row for each conversation, from what was read back."""
    lines = F.array_join(F.transform("turns", lambda m: F.concat(F.coalesce(m["role"], F.lit("")), F.lit("\n"), m["text"], F.lit("\n"))), "")
    read = with_loss_mask(formatted)
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def events_of(conversations: DataFrame, piece_chars: int = 400) -> DataFrame:
    """A finished table as the log of a chat that led to it: each row is a message of its own.

    Every text is streamed in deltas of up to `piece_chars` characters. An assistant's first
    try is broken off and generated anew; a user's first try is edited, so the first piece
    comes as the edit. Neither try is in the result."""
    text, answer = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role") == ASSISTANT, F.lit(False))
    size = F.char_length(text)
    draft = F.concat(F.substr(text, F.lit(1), F.lit(piece_chars)), F.lit(" ..."))
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(size - 1, F.lit(0)) / piece_chars).cast("int")), lambda i: F.substr(text, i * piece_chars + 1, F.lit(piece_chars)))
    event = lambda kind, role, value: F.struct(kind.alias("kind"), role.alias("role"), value.alias("text"))
    none, role = F.lit(None).cast("string"), F.col("role")
    first = F.array(event(F.lit("delta"), role, draft), event(F.when(answer, "regenerate").otherwise("edit"), none, F.when(~answer, F.substr(text, F.lit(1), F.lit(piece_chars)))))
    rest = F.transform(pieces, lambda p, i: F.when((i > 0) | answer, event(F.lit("delta"), none, p)))
    log = F.concat(first, F.filter(rest, lambda e: e.isNotNull()))
    rows = conversations.select("conv_id", "turn", F.monotonically_increasing_id().alias("message"), log.alias("log")).select("conv_id", "turn", "message", F.posexplode("log").alias("step", "e"))
    return rows.select("conv_id", F.struct("turn", "step").alias("seq"), "message", "e.kind", "e.role", "e.text")


def with_probe(conversations: DataFrame) -> DataFrame:
    """Adds conversation -7, whose texts are control strings."""
    spark: SparkSession = conversations.sparkSession
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, USER).otherwise(ASSISTANT).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    return conversations.select("conv_id", "turn", "role", "text").union(probe)
