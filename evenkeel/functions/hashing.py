"""Hashes and seeds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions.canonical import json_text, row_json
from evenkeel.functions.exact import rounded

JOINT = "‖"


def row_sha256(schema: T.StructType, *names: str) -> Column:
    """Hash of the named columns' canonical JSON."""
    return sha256(row_json(schema, *names))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def files_sha256(files: Column) -> Column:
    """Hash of several files (structs of path and content): both closed by a zero, in order of path."""
    closed = F.transform(F.sort_array(files), lambda f: F.concat(f["path"], F.lit("\0"), f["content"], F.lit("\0")))
    return F.sha2(F.array_join(closed, ""), 256)


def run_id(day: Column, protocol_id: Column, model_id: Column, replicate: Column) -> Column:
    return F.concat_ws("__", day.cast("string"), protocol_id, model_id, F.concat(F.lit("r"), replicate.cast("string")))


def seed(*parts: Column) -> Column:
    """The first 64 bits of the parts' hash, as decimal text (it may exceed BIGINT)."""
    return F.conv(F.substring(F.sha2(F.concat_ws(JOINT, *parts), 256), 1, 16), 16, 10)


def sample_order(day: Column, run_id: Column) -> Column:
    """A hash order in which the first rows of a day are its sample."""
    return F.sha2(F.concat_ws(":", day, run_id), 256)


def token_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Cost rounded up to 1e-4, from whole prices for a million tokens; null for an unknown price."""
    units = tokens_in.cast("long") * price_in + tokens_out.cast("long") * price_out
    return F.ceil(units / 100) / F.lit(10_000.0)


def logprob_fingerprint(text: Column, steps: Column, places: int = 4) -> Column:
    """Hash of a reply and of its steps (maps of token to log-probability, rounded)."""
    near = F.transform(steps, lambda step: F.transform_values(step, lambda _, lp: rounded(lp, places)))
    kind = T.ArrayType(T.MapType(T.StringType(), T.DoubleType()))
    told = F.concat(F.lit('{"text":'), json_text(text, T.StringType(), ascii=True), F.lit(',"tokens":'), json_text(near, kind, ascii=True), F.lit("}"))
    return F.sha2(told, 256)
