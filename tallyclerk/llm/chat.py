"""Chat formatting: final messages rebuilt from an event log, then rendered with a loss mask.

A log has (conv_id, seq, message_id, op, role, text). `message` and `edit` set a message's text,
`delta` appends to it, `regenerate` empties it and withdraws every message begun between the
message and the regeneration. Events are dealt by conversation and folded in order of seq; all of it
is grouping and array functions of the DataFrame API.

The template is `<|im_start|>role\\ntext<|im_end|>\\n` for each message. Inside a text a
control string could only begin with `<|`; every `<`, run of backslashes, `|` gets one more
backslash, which is undone exactly by taking one away, so no text can forge a turn. Roles are
URL-encoded, which leaves plain words as they are.

Odd input: null text is empty, a null role is empty, a null conv_id is a conversation of its own,
a conversation whose messages were all withdrawn formats to the empty string. Events of a log equal in
every column are one event delivered twice and count once, while equal rows of a table of finished turns are as many turns; other ties are taken in the order of role and
text. An empty log gives an empty result. A conversation is one output row and so one group: the
largest conversation, not the number of rows, bounds a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
EVENT_SCHEMA = "conv_id bigint, seq bigint, message_id string, op string, role string, text string"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def turns_as_events(turns: DataFrame) -> DataFrame:
    """A table of finished turns (conv_id, turn, role, text) as a log: each row is a whole message,
    also where rows are equal in every column."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    own = F.concat_ws(":", F.coalesce(F.col("turn").cast("string"), F.lit("")), F.sha2(F.concat(role, F.lit("\n"), text), 256))
    said = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("seq"), own.alias("own"), role.alias("role"), text.alias("text"))
    # Equal rows are counted, then numbered, so each has its own message_id. They are spread as final_messages needs them.
    counted = said.repartition("conv_id").groupBy("conv_id", "seq", "own", "role", "text").agg(F.count("*").alias("n"))
    return counted.select("conv_id", "seq", "own", "role", "text", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("k")).select(
        "conv_id", "seq", F.concat_ws(":", "own", F.col("k").cast("string")).alias("message_id"), F.lit("message").alias("op"), "role", "text")


def final_messages(events: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, messages array<struct<created, role, text>> in order."""
    clean = events.select(
        "conv_id", "seq", F.coalesce("message_id", F.lit("")).alias("message_id"), F.coalesce("op", F.lit("message")).alias("op"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    resets = F.col("op") != "delta"
    # One shuffle serves both groupings: rows of a conversation stay together.
    message = clean.repartition("conv_id").groupBy("conv_id", "message_id").agg(
        F.min("seq").alias("created"),
        F.max(F.when(F.col("role") != "", F.struct("seq", "role"))).alias("named"),
        F.max(F.when(resets, F.col("seq"))).alias("reset"),
        F.max(F.when(F.col("op") == "regenerate", F.col("seq"))).alias("again"),
        F.sort_array(F.collect_set(F.struct("seq", (~resets).cast("int").alias("later"), "op", "role", "text"))).alias("parts"),
    )
    live = F.filter("parts", lambda p: F.col("reset").isNull() | p["seq"].isNull() | (p["seq"] >= F.col("reset")))
    text = F.array_join(F.transform(F.filter(live, lambda p: p["op"] != "regenerate"), lambda p: p["text"]), "")
    grouped = message.select(
        "conv_id", F.struct("created", F.coalesce("named.role", F.lit("")).alias("role"), text.alias("text")).alias("m"),
        F.when(F.col("again").isNotNull(), F.struct("created", "again")).alias("gap"),
    ).groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("messages"), F.collect_list("gap").alias("gaps"))
    withdrawn = lambda m: F.exists("gaps", lambda g: (m["created"] > g["created"]) & (m["created"] < g["again"]))
    return grouped.select("conv_id", F.when(F.size("gaps") == 0, F.col("messages")).otherwise(F.filter("messages", lambda m: ~withdrawn(m))).alias("messages"))


def formatted(conversations: DataFrame, roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted text, and loss spans (start, length in code points) over texts of `roles`."""
    head = lambda m: F.concat(F.lit(START), F.url_encode(m["role"]), F.lit("\n"))
    pieces = F.transform("messages", lambda m: F.struct(
        head(m).alias("head"), escaped(m["text"]).alias("body"), m["role"].isin(*roles).alias("loss")))
    with_pieces = conversations.select("conv_id", pieces.alias("pieces"))
    ends = F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END + "\n")))
    # Running offsets: sums of the lengths before each piece.
    sizes = F.transform("pieces", lambda p: F.struct(
        F.length(p["head"]).cast("bigint").alias("head"), F.length(p["body"]).cast("bigint").alias("body"), p["loss"].alias("loss")))
    folded = F.aggregate(
        "sizes", F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda s, p: F.struct(
            (s["at"] + p["head"] + p["body"] + F.lit(len(END) + 1)).alias("at"),
            F.when(p["loss"], F.concat(s["spans"], F.array(F.struct((s["at"] + p["head"]).alias("start"), p["body"].alias("length"))))).otherwise(s["spans"]).alias("spans"),
        ),
        lambda s: s["spans"],
    )
    return with_pieces.select("conv_id", F.array_join(ends, "").alias("formatted"), sizes.alias("sizes")).select("conv_id", "formatted", folded.alias("loss_spans"))


def parsed(text: Column) -> Column:
    """Turns read back from formatted text: array<struct<role, text>>."""
    chunks = F.regexp_extract_all(text, F.lit(r"(?s)<\|im_start\|>(.*?)<\|im_end\|>\n"), 1)
    role = lambda c: F.substring_index(c, "\n", 1)
    return F.transform(chunks, lambda c: F.struct(F.url_decode(role(c)).alias("role"), unescaped(c.substr(F.length(role(c)) + 2, F.length(c))).alias("text")))


def under_mask(formatted_text: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescaped(formatted_text.substr((s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def format_log(events: DataFrame, roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    return formatted(final_messages(events), roles)
