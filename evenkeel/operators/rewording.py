"""What each rewording type allows a version B to change in the text of version A.

A text is seen as an array of lines or of tokens; the places at which two arrays differ and
the values there decide every rule, in Spark expressions alone. A conforming pair breaks no
rule; otherwise all broken ones are named.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases and forms that protocol texts use.
OPTION_LINE = r"(?U)^(Plan|Option) [AB]:"
OPTION_NAME = r"(?U)(Plan|Option) ([AB])\b"
WHOLE_NUMBER = r"(?U)^\d[\d,]*$"
DEFAULT_PHRASE = "by default"
SPENT = r"(?U)So far, €(\d[\d,]*) has been spent"
SPENT_PHRASE = (", giving up the €", " already spent,")
PERCENT_OF = r"(?U)(\d+)% of the .* are (\w+)"
OUT_OF_1000 = r"(?U)Out of every 1,000 .*?, (\d+) are "
FLAGGED = r"(?U)wrongly flags (\d+)"
FLAGGED_PERCENT = r"(?U)wrongly flags (\d+)%"
END_MARKS, AROUND_MARKS = ".,;", ".,;:€%()"
WORDING_FAMILIES = ("risky_choice_framing", "sunk_cost_fallacy", "base_rate_neglect")


def _named(**rules: Column) -> Column:
    return F.array_compact(F.array(*(F.when(F.coalesce(broken, F.lit(True)), F.lit(name)) for name, broken in rules.items())))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _tokens(text: Column) -> Column:
    return F.array_remove(F.split(text, r"(?U)\s+"), "")


def _changes(a: Column, b: Column) -> Column:
    """The places at which two arrays differ, as structs of place, one and two; a missing side is null."""
    both = F.arrays_zip(a.alias("one"), b.alias("two"))
    placed = F.transform(both, lambda p, at: F.struct(at.alias("place"), p["one"].alias("one"), p["two"].alias("two")))
    return F.filter(placed, lambda p: ~p["one"].eqNullSafe(p["two"]))


def _split_lines(lines: Column) -> tuple[Column, Column]:
    """Option lines and other lines, each in order."""
    return F.filter(lines, lambda x: x.rlike(OPTION_LINE)), F.filter(lines, lambda x: ~x.rlike(OPTION_LINE))


def _reordered(a: Column, b: Column) -> Column:
    (options_a, rest_a), (options_b, rest_b) = _split_lines(_lines(a)), _split_lines(_lines(b))
    return _named(other_lines_changed=rest_a != rest_b, options_changed=F.array_sort(options_a) != F.array_sort(options_b), options_not_moved=options_a == options_b)


def _one(changes: Column, a: Column, b: Column) -> Column:
    """Whether exactly one place differs and nothing is missing on either side."""
    return (F.size(a) == F.size(b)) & (F.size(changes) == 1)


def _default_switched(a: Column, b: Column) -> Column:
    a, b = _lines(a), _lines(b)
    changes = _changes(a, b)
    one, two = (F.get(changes, F.lit(0))[side] for side in ("one", "two"))
    letter = lambda x: F.regexp_extract(x, OPTION_NAME, 2)
    bare = lambda x: F.regexp_replace(x, OPTION_NAME, "#")
    single = _one(changes, a, b)
    return _named(
        not_one_line=~single,
        no_default_sentence=single & ~(F.contains(one, F.lit(DEFAULT_PHRASE)) & F.contains(two, F.lit(DEFAULT_PHRASE))),
        not_switched=single & ((letter(one) == "") | (letter(two) == "") | (letter(one) == letter(two))),
        more_than_the_letter=single & (bare(one) != bare(two)),
    )


def _anchor_changed(a: Column, b: Column) -> Column:
    a, b = _tokens(a), _tokens(b)
    changes = _changes(a, b)
    whole, other = (F.get(changes, F.lit(0))[side] for side in ("one", "two"))
    one, two = F.rtrim(whole, F.lit(END_MARKS)), F.rtrim(other, F.lit(END_MARKS))
    single = _one(changes, a, b)
    rest = F.transform(F.filter(a, lambda t: t != whole), lambda t: F.btrim(t, F.lit(AROUND_MARKS)))
    return _named(
        not_one_token=~single,
        not_a_number=single & ~(one.rlike(WHOLE_NUMBER) & two.rlike(WHOLE_NUMBER)),
        anchor_repeated=single & F.arrays_overlap(rest, F.array(one, two)),
    )


def _framed(a: Column, b: Column) -> Column:
    a, b = _lines(a), _lines(b)
    return _named(unchanged=a == b, line_count=F.size(a) != F.size(b), other_line_changed=(F.size(a) == F.size(b)) & F.exists(_changes(a, b), lambda p: ~p["one"].rlike(OPTION_LINE)))


def _cost_named(text_a: Column, b: Column) -> Column:
    a, b = _lines(text_a), _lines(b)
    changes = _changes(a, b)
    single = _one(changes, a, b)
    one, two = (F.get(changes, F.lit(0))[side] for side in ("one", "two"))
    amount = F.regexp_extract(text_a, SPENT, 1)
    phrase = F.concat(F.lit(SPENT_PHRASE[0]), amount, F.lit(SPENT_PHRASE[1]))
    at = F.locate("\u0000", F.replace(two, phrase, F.lit("\u0000")))
    without = F.when(at > 0, F.concat(F.substring(two, F.lit(1), at - 1), F.substring(two, at + F.length(phrase), F.length(two)))).otherwise(two)
    return _named(not_one_line=~single, no_amount=amount == "", not_the_phrase=single & (amount != "") & (without != one))


def _rates_restated(a: Column, b: Column) -> Column:
    (options_a, _), (options_b, _) = _split_lines(_lines(a)), _split_lines(_lines(b))
    number = lambda text, form: F.regexp_extract(text, form, 1).try_cast("decimal(18,0)")
    share, wrong, out_of, flagged = number(a, PERCENT_OF), number(a, FLAGGED_PERCENT), number(b, OUT_OF_1000), number(b, FLAGGED)
    known = share.isNotNull() & wrong.isNotNull() & out_of.isNotNull() & flagged.isNotNull()
    return _named(
        unchanged=a == b,
        options_changed=options_a != options_b,
        no_rates=~known,
        rates_differ=known & ((out_of != share * 10) | (flagged * 100 != wrong * (F.lit(1000) - out_of))),
        opening_changed=F.get(_lines(a), F.lit(0)) != F.get(_lines(b), F.lit(0)),
    )


def broken_rules(kind: Column, family: Column, a: Column, b: Column) -> Column:
    """Names of the rules of its rewording type (and family, for wordings) that text b breaks against text a."""
    risky, sunk, rates = WORDING_FAMILIES
    wording = F.when(family == risky, _framed(a, b)).when(family == sunk, _cost_named(a, b)).when(family == rates, _rates_restated(a, b))
    rule = F.when(kind == "order", _reordered(a, b)).when(kind == "default", _default_switched(a, b)).when(kind == "anchoring", _anchor_changed(a, b)).when(kind == "wording", wording)
    return F.when(a.isNull() | b.isNull(), F.array(F.lit("no_text"))).otherwise(F.coalesce(rule, F.array(F.lit("no_rule"))))
