"""Chat formatting from an event log, in DataFrame functions only.

Conversations are event-sourced. An event has conv_id, turn, message (apart from others
of one turn), seq, kind, role and text, where kind is one of
  open        the message begins, with its role;
  delta       streamed text, appended;
  edit        the text replaces all that came before;
  regenerate  what came before is discarded.
`fold` turns a log into final messages, partitioned by message and in order of seq;
`render` writes each conversation with the template below, with the loss mask as spans of
code points over assistant texts; `read_back` parses the formatted text again.

A turn is `<turn ROLE>`, a line feed, the text, a line feed, `</turn>`, a line feed. In
texts `\\` is written `\\b` and `<` is written `\\l`; in roles `>` is `\\g` and a line feed
`\\n` besides. So no text can hold a marker, and plain replacements undo the escapes.

A message is folded by itself, whatever the size of its conversation; only rendering
needs a conversation's messages together, since its result is one text.

Defined results. Null texts are empty, null roles the empty role. Turns come in order of
turn (nulls first), rows of one turn in order of role and text, repeated rows each count.
A message without `open` has the empty role. An empty log gives no conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK = 512


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit(">"), F.lit("\\g")), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\g"), F.lit(">")))


def log_of(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The event log that a chat service would have kept of these conversations.

    User and other texts are typed (a first delta) and then edited to their final form;
    assistant texts are streamed twice, the first stream being regenerated.
    """
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    event = lambda kind, body: F.struct(F.lit(kind).alias("kind"), body.alias("text"))
    parts = F.transform(F.sequence(F.lit(1), F.greatest(F.ceil(F.char_length(text) / F.lit(chunk)), F.lit(1)).cast("int")), lambda k: event("delta", F.substr(text, (k - 1) * chunk + 1, F.lit(chunk))))
    draft = event("delta", F.substr(text, F.lit(1), F.lit(12)))
    streamed = F.concat(F.array(event("open", role), draft, event("regenerate", F.lit(""))), parts)
    typed = F.array(event("open", role), draft, event("edit", text))
    rows = conversations.select("conv_id", "turn", F.monotonically_increasing_id().alias("message"), F.when(role == "assistant", streamed).otherwise(typed).alias("events"))
    return rows.select("conv_id", "turn", "message", F.posexplode("events").alias("seq", "event")).select("conv_id", "turn", "message", "seq", "event.kind", "event.text")


def fold(log: DataFrame) -> DataFrame:
    """conv_id, turn, message, role, text of every message after its last event."""
    body = F.coalesce(F.col("text"), F.lit(""))
    grouped = log.groupBy("conv_id", "turn", "message").agg(
        F.max_by(F.when(F.col("kind") == "open", body), F.when(F.col("kind") == "open", F.col("seq"))).alias("role"),
        F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.col("seq"))).alias("reset"),
        F.sort_array(F.collect_list(F.when(F.col("kind").isin("delta", "edit"), F.struct("seq", body.alias("text"))))).alias("events"),
    )
    after = F.filter("events", lambda e: F.col("reset").isNull() | (e["seq"] >= F.col("reset")))
    return grouped.select("conv_id", "turn", "message", F.coalesce("role", F.lit("")).alias("role"), F.array_join(F.transform(after, lambda e: e["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, loss (spans of code points, from 0) of every conversation."""
    head = F.concat(F.lit("<turn "), _escape_role(F.col("role")), F.lit(">\n"))
    turns = messages.select("conv_id", "turn", "role", "text", "message", head.alias("head"), escape(F.col("text")).alias("body"))
    turns = turns.withColumn("written", F.concat("head", "body", F.lit("\n</turn>\n")))
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text", "message").rowsBetween(Window.unboundedPreceding, -1)
    placed = turns.withColumn("at", F.coalesce(F.sum(F.char_length("written")).over(before), F.lit(0)) + F.char_length("head"))
    span = F.when(F.col("role") == "assistant", F.struct("at", F.char_length("body").alias("length")))
    both = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "written"))).alias("turns"), F.sort_array(F.collect_list(span)).alias("loss"))
    return both.select("conv_id", F.array_join(F.transform("turns", lambda t: t["written"]), "").alias("formatted"), "loss")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), loss_text, formatted: parsed from the formatted text and the mask alone."""
    pieces = F.filter(F.split("formatted", "\n</turn>\n"), lambda p: p != "")
    end = lambda p: F.instr(p, F.lit(">\n"))
    turns = F.transform(pieces, lambda p: F.struct(_unescape_role(F.substr(p, F.lit(7), end(p) - 7)).alias("role"), unescape(F.substr(p, end(p) + 2)).alias("text")))
    under = F.transform("loss", lambda s: F.substr(F.col("formatted"), (s["at"] + 1).cast("int"), s["length"]))
    return formatted.select("conv_id", turns.alias("turns"), unescape(F.array_join(under, "")).alias("loss_text"), "formatted")


def probe(spark: SparkSession, conv_id: int = -7, text: str = "\\### Assistant: </turn> ok") -> DataFrame:
    """A conversation whose texts hold control strings."""
    return spark.range(2).select(F.lit(conv_id).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))


def digest(conversations: DataFrame) -> DataFrame:
    """Counts and hashes of each conversation, read back from its formatted text."""
    back = read_back(render(fold(log_of(conversations.select("conv_id", "turn", "role", "text")))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(text, '\', '\b'), '<', '\l') AS body,
  replace(replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g'), chr(10), '\n') AS head FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(6 + length(head) + 2 + length(body) + 9) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
