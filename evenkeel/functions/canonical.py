"""One canonical JSON text for any value: keys in order at every depth, no spaces, numbers in shortest form.

The writer follows the schema and is one Spark expression. Hashes of the text then
agree with those of any writer that keeps the same rules: keys sorted by code point, nulls
kept, doubles in the fewest digits that read back alike (1e-05, 0.0004, 1e+16, 2.0),
control characters escaped, others escaped on demand (`ascii`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _code(unit: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(unit)), 4, "0"))


def _escaped(char: Column, ascii: bool) -> Column:
    point = F.ascii(char).cast("long")
    named = F.when(char == '"', '\\"').when(char == "\\", "\\\\").when(char == "\n", "\\n").when(char == "\r", "\\r").when(char == "\t", "\\t").when(char == "\b", "\\b").when(char == "\f", "\\f")
    plain = (point >= 0x20) & (point < 0x7F) if ascii else point >= 0x20
    over = point - 0x10000
    pair = F.concat(_code(F.lit(0xD800) + F.shiftright(over, 10)), _code(F.lit(0xDC00) + over.bitwiseAND(F.lit(0x3FF))))
    return named.when(plain, char).when(point < 0x10000, _code(point)).otherwise(pair)


def quoted(text: Column, ascii: bool = False) -> Column:
    odd = r'[^ !#-\[\]-~]' if ascii else r'[\x00-\x1F"\\]'
    chars = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    slow = F.array_join(F.transform(chars, lambda c: _escaped(c, ascii)), "")
    return F.concat(F.lit('"'), F.when(text.rlike(odd), slow).otherwise(text), F.lit('"'))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _digits(size: Column) -> Column:
    """digits and point of a positive double: 0.digits times ten to the power of point; closing zeros may remain."""
    told = size.cast("string")
    power = F.coalesce(F.regexp_extract(told, r"E(-?\d+)$", 1).try_cast("int"), F.lit(0))
    whole, part = F.regexp_extract(told, r"^(\d+)", 1), F.regexp_extract(told, r"\.(\d+)", 1)
    parts = F.struct(F.concat(whole, part).alias("all"), (F.length(whole) + power).alias("point"))
    bare = lambda p: F.struct(F.ltrim(p["all"], F.lit("0")).alias("digits"), (p["point"] - F.length(p["all"]) + F.length(F.ltrim(p["all"], F.lit("0")))).alias("point"))
    return _let(parts, bare)


def _shorter(d: Column, size: Column) -> Column:
    """The digits without the last one, rounded, where they still read back as the value."""
    tenth = d["digits"].cast("decimal(20,0)") / 10
    near, down = F.round(tenth, 0), F.floor(tenth)
    text = lambda x: x.cast("decimal(20,0)").cast("string")
    cuts = F.array(text(near), text(F.when(near > down, down).otherwise(down + 1)))  # the nearer one first
    same = lambda c: (F.length(c) == F.length(d["digits"]) - 1) & (F.concat(F.lit("0."), c, F.lit("E"), d["point"].cast("string")).cast("double") == size)
    return F.struct(F.coalesce(F.get(F.filter(cuts, same), F.lit(0)), d["digits"]).alias("digits"), d["point"].alias("point"))


def _written(d: Column) -> Column:
    """Digits (without closing zeros) and point as text."""
    digits, point, n = d["digits"], d["point"], F.length(d["digits"])
    exponent = F.abs(point - 1).cast("string")
    power = F.concat(F.when(point < 1, "-").otherwise("+"), F.when(F.length(exponent) < 2, "0").otherwise(""), exponent)
    scientific = F.concat(F.left(digits, F.lit(1)), F.when(n > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise(""), F.lit("e"), power)
    return (
        F.when((point < -3) | (point > 16), scientific)
        .when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .when(point >= n, F.concat(digits, F.repeat(F.lit("0"), point - n), F.lit(".0")))
        .otherwise(F.concat(F.left(digits, point), F.lit("."), F.substr(digits, point + 1)))
    )


def number(value: Column) -> Column:
    """A double in the fewest digits that read back alike; plain from 1e-4 up to 1e16, else with an exponent."""

    def slow(x: Column) -> Column:
        size = F.abs(x)
        digits = _digits(size)
        for _ in range(2):  # the platform may write one or two digits too many
            digits = _let(digits, lambda d: _shorter(d, size))
        bare = _let(digits, lambda d: F.struct(F.rtrim(d["digits"], F.lit("0")).alias("digits"), d["point"].alias("point")))
        sign = F.when(F.startswith(x.cast("string"), F.lit("-")), "-").otherwise("")
        return F.when(F.isnan(x), "NaN").otherwise(F.concat(sign, F.when(size == float("inf"), "Infinity").otherwise(_let(bare, _written))))

    return _let(value, lambda x: F.when(x.cast("string").rlike(r"^-?\d{1,7}\.\d{1,8}$"), x.cast("string")).otherwise(slow(x)))


def json_text(value: Column, kind: T.DataType, ascii: bool = False) -> Column:
    """Canonical JSON of a value of the given type; a null is null."""
    joined = lambda parts: F.array_join(parts, ",")
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        parts = [F.concat(quoted(F.lit(f.name), ascii), F.lit(":"), json_text(value[f.name], f.dataType, ascii)) for f in fields]
        out = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    elif isinstance(kind, T.MapType):
        key = lambda k: quoted(k if isinstance(kind.keyType, T.StringType) else k.cast("string"), ascii)
        pair = lambda k: F.concat(key(k), F.lit(":"), json_text(F.element_at(value, k), kind.valueType, ascii))
        out = F.concat(F.lit("{"), joined(F.transform(F.sort_array(F.map_keys(value)), pair)), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), joined(F.transform(value, lambda x: json_text(x, kind.elementType, ascii))), F.lit("]"))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        out = number(value.cast("double"))
    elif isinstance(kind, (T.BooleanType, T.IntegralType)) or isinstance(kind, T.DecimalType) and kind.scale == 0:
        out = value.cast("string")
    elif isinstance(kind, T.DecimalType):
        out = number(value.cast("double"))
    elif isinstance(kind, T.NullType):
        return F.lit("null")
    else:  # text, dates
        out = quoted(value.cast("string"), ascii)
    return F.when(value.isNull(), "null").otherwise(out)


def row_json(schema: T.StructType, *names: str, ascii: bool = False) -> Column:
    """Canonical JSON of the named columns of a row as one object."""
    parts = [F.concat(quoted(F.lit(n), ascii), F.lit(":"), json_text(F.col(n), schema[n].dataType, ascii)) for n in sorted(names)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
