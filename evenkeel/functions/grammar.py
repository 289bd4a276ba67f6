"""Decision grammar: from a raw reply to one outcome of a closed set.

A reply is split into lines; a line is normalized (NFC, case folded, emphasis marks
removed, white space collapsed, closing marks stripped) and may state a decision. ASCII
replies are classified by native expressions alone; the others, where normalization
needs Unicode tables, go through one vectorized function with the same rules.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT = "outcome string, token string, reason string"
# Fixed values of the decision grammar.
EMPHASIS = "*_`"
CLOSING = ".!;·"
DECISION = "^decision ?[:：] ?(.*)$"
PYTHON_LINES = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E]"
PYTHON_SPACE = r"[ \t\n\r\x0B\x0C\x1C-\x1F]+"


def normalized(line: str) -> str:
    """One line, exactly: the rule that both paths follow."""
    folded = unicodedata.normalize("NFC", line).casefold()
    kept = "".join(c for c in folded if c not in EMPHASIS)
    return " ".join(kept.split()).rstrip(CLOSING + " ")


def option_table(options: list[str]) -> dict[str, str]:
    table: dict[str, str] = {}
    for option in options:
        if normalized(option) in table:
            raise ValueError(f"two options read alike: {options}")
        table[normalized(option)] = option
    return table


def _native_line(line: Column) -> Column:
    bare = F.translate(F.lower(line), EMPHASIS, "")
    return F.regexp_replace(F.trim(F.regexp_replace(bare, PYTHON_SPACE, " ")), "[.!; ]+$", "")


def option_keys(options: Column) -> Column:
    """Options as the grammar compares them: those of plain ASCII natively, the others by its exact rule."""

    @F.pandas_udf("array<string>")
    def exact(lists: pd.Series) -> pd.Series:
        return lists.map(lambda options: None if options is None else [None if o is None else normalized(o) for o in options])

    odd = F.exists(options, lambda o: F.octet_length(o) != F.char_length(o))
    return F.when(odd, exact(F.when(odd, options))).otherwise(F.transform(options, _native_line))


def _verdict(stated: Column, tails: Column, known: Column, token: Column, strict: Column) -> Column:
    """Outcome, token and reason from the tails of decision lines and those that are options; `token` is the option of the first of them."""
    bad = lambda outcome, reason: F.struct(F.lit(outcome).alias("outcome"), F.lit(None).cast("string").alias("token"), F.lit(reason).alias("reason"))
    out = F.when(~stated, bad("empty", "empty_response"))
    out = out.when(F.when(strict, F.size(tails)).otherwise(F.size(known)) == 0, bad("unparseable", "no_decision_line"))
    out = out.when(strict & (F.size(known) < F.size(tails)), bad("unparseable", "token_not_in_options"))
    out = out.when(F.size(F.array_distinct(known)) > 1, bad("unparseable", "conflicting_decisions"))
    return out.otherwise(F.struct(F.lit("valid").alias("outcome"), token.alias("token"), F.lit(None).cast("string").alias("reason")))


def native_stated(text: Column) -> Column:
    """Whether an ASCII text says anything."""
    return F.coalesce(F.regexp_replace(text, PYTHON_SPACE, "") != "", F.lit(False))


def native_tails(text: Column) -> Column:
    """What the decision lines of an ASCII text state, whichever options there are."""
    lines = F.transform(F.split(text, PYTHON_LINES), _native_line)
    return F.transform(F.filter(lines, lambda line: line.rlike(DECISION)), lambda line: F.regexp_extract(line, DECISION, 1))


def verdict(stated: Column, tails: Column, known: Column, keys: Column, options: Column, version: Column) -> Column:
    """Outcome, token and reason by each row's own options: `keys` are the options as the grammar compares them, `known` the tails that are one."""
    token = F.get(options, (F.array_position(keys, F.get(known, F.lit(0))) - 1).cast("int"))
    return _verdict(stated, tails, known, token, strict=version == 1)


def native_extract(text: Column, options: list[str], version: int) -> Column:
    """The grammar over ASCII text, in native expressions."""
    table = option_table(options)
    names = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    tails = native_tails(text)
    known = F.filter(tails, lambda t: t.isin(*table))
    return _verdict(native_stated(text), tails, known, F.element_at(names, F.get(known, F.lit(0))), strict=F.lit(version == 1))


def plain(text: str = "text") -> Column:
    """Whether native expressions may read the text: it is ASCII, or null."""
    return F.coalesce(F.octet_length(text) == F.char_length(text), F.lit(True))


def exact_extract(texts: pd.Series, options: list[str], version: int) -> pd.DataFrame:
    """The grammar over any text."""
    table, decision = option_table(options), re.compile(DECISION)
    rows = []
    for text in texts:
        if text is None or not text.strip():
            rows.append(("empty", None, "empty_response"))
            continue
        tails = [m[1] for m in map(decision.match, map(normalized, text.splitlines())) if m]
        known = [t for t in tails if t in table]
        if not (tails if version == 1 else known):
            rows.append(("unparseable", None, "no_decision_line"))
        elif version == 1 and len(known) < len(tails):
            rows.append(("unparseable", None, "token_not_in_options"))
        elif len(set(known)) > 1:
            rows.append(("unparseable", None, "conflicting_decisions"))
        else:
            rows.append(("valid", table[known[0]], None))
    return pd.DataFrame(rows, columns=["outcome", "token", "reason"])


def extract(rows: DataFrame, options: list[str], version: int, text: str = "text") -> DataFrame:
    """rows with a struct `read` (outcome, token, reason)."""
    @F.pandas_udf(RESULT)
    def exact(texts: pd.Series) -> pd.DataFrame:
        return exact_extract(texts, options, version)

    return rows.where(plain(text)).withColumn("read", native_extract(F.col(text), options, version)).unionByName(rows.where(~plain(text)).withColumn("read", exact(text)))


def early() -> Column:
    """Outcome, token and reason that hold before the grammar is asked; null if it decides."""
    bad = lambda outcome, reason: F.struct(F.lit(outcome).alias("outcome"), F.lit(None).cast("string").alias("token"), reason.cast("string").alias("reason"))
    return (
        F.when(F.col("error").isNotNull(), bad("blocked_upstream", F.col("error")))
        .when(F.col("stop_reason") == "refusal", bad("refused", F.lit("stop_reason=refusal")))
        .when(F.col("stop_reason") == "max_tokens", bad("truncated", F.lit("stop_reason=max_tokens")))
        .when(F.col("text").isNull(), bad("off_format", F.lit("no_text_content")))
    )


def classify(rows: DataFrame, options: list[str], version: int) -> DataFrame:
    """rows (text, error, stop_reason) with outcome, token, reason.

    In this order: failed transport, refusal, truncation, missing text, grammar.
    """
    marked = rows.withColumn("early", early())
    read = extract(marked.where("early is null"), options, version)
    done = marked.where("early is not null").withColumn("read", F.col("early"))
    return read.unionByName(done).drop("early").select("*", "read.*").drop("read")


def surface_skeleton(text: Column) -> Column:
    """Letters and digits alone, case-folded: what a change of spaces and marks leaves as it was."""
    return F.regexp_replace(folded(text), r"(?U)[\W_]+", "")


#: Small and capital Cherokee letters: full case folding ends in the capital ones.
_CHEROKEE = tuple("".join(map(chr, [*range(a, a + 80), *range(b, b + 6)])) for a, b in ((0xAB70, 0x13F8), (0x13A0, 0x13F0)))


def folded(text: Column) -> Column:
    """Full Unicode case folding (ß becomes ss), by way of upper case; the letters for which that way ends elsewhere are set right."""
    apart = "\uE131"  # stands for the dotless i, which has no fold
    low = F.lower(F.translate(F.upper(F.translate(F.lower(text), "ı", apart)), apart, "ı"))
    return F.translate(low, f"ς{_CHEROKEE[0]}", f"σ{_CHEROKEE[1]}")


def prompt(template: Column, scenario: Column) -> Column:
    return F.replace(template, F.lit("{scenario}"), scenario)


def version_of(protocol_id: Column) -> tuple[Column, Column]:
    """Prefix and number of a `__v<N>` ending; without one the whole id and 0."""
    n = F.regexp_extract(protocol_id, r"^(.+)__v(\d+)$", 2)
    return F.when(n != "", F.regexp_extract(protocol_id, r"^(.+)__v(\d+)$", 1)).otherwise(protocol_id), F.when(n != "", n.cast("int")).otherwise(0)


# Answers that say the account's funds are spent.
FUNDS_STATUSES = (400, 402, 403, 429)
FUNDS_MARKS = ("credit balance is too low", "api usage limits", "reached your specified")


def funds_error(status: Column, message: Column, statuses: tuple[int, ...] = FUNDS_STATUSES, marks: tuple[str, ...] = FUNDS_MARKS) -> Column:
    low = F.lower(message)
    hit = F.lit(False)
    for mark in marks:
        hit |= F.contains(low, F.lit(mark))
    return F.coalesce(status.isin(*statuses) & hit, F.lit(False))


def text_blocks(blocks: Column) -> Column:
    """Texts of the blocks of type `text`, one a line; null if there are none."""
    said = F.filter(blocks, lambda b: b["type"] == "text")
    return F.when(F.size(said) > 0, F.array_join(F.transform(said, lambda b: b["text"]), "\n"))


def slug(title: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(title), r"[^a-z0-9]+", "-"), "^-|-$", "")
