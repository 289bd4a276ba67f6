"""Published files: flat tables with JSON cells, open trials by year, append-only logs, a descriptor."""

from __future__ import annotations

import json
import uuid
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.sources import records, versioned
from evenkeel.sources.tables import materialize


def _spaced_json(value: Column, kind: T.DataType) -> Column:
    """JSON of an array of strings or a map of numbers, with a space after commas and colons and sorted keys."""
    if isinstance(kind, T.ArrayType):
        quoted = F.transform(value, lambda x: F.to_json(F.array(x)))
        return F.concat(F.lit("["), F.array_join(F.transform(quoted, lambda q: F.substr(q, F.lit(2), F.length(q) - 2)), ", "), F.lit("]"))
    pairs = F.array_sort(F.map_entries(value))
    return F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda e: F.concat(F.lit('"'), e["key"], F.lit('": '), F.coalesce(e["value"].cast("string"), F.lit("null")))), ", "), F.lit("}"))


def csv_cells(rows: DataFrame) -> DataFrame:
    """Every column as the text of a CSV cell: null is empty, booleans are True or False, nested values JSON."""

    def cell(field: T.StructField) -> Column:
        c = F.col(field.name)
        if isinstance(field.dataType, (T.ArrayType, T.MapType)):
            text = _spaced_json(c, field.dataType)
        elif isinstance(field.dataType, T.BooleanType):
            text = F.when(c, "True").otherwise("False")
        else:
            text = c.cast("string")
        return F.when(c.isNull(), "").otherwise(text).alias(field.name)

    return rows.select(*(cell(f) for f in rows.schema.fields))


def write_csv(rows: DataFrame, path: str, order: list[str]) -> None:
    """A sorted CSV table with a header. Range partitions keep the order over files, whatever the size."""
    out = csv_cells(rows.orderBy(*order)) if set(order) <= set(rows.columns) else csv_cells(rows)
    out.write.mode("errorifexists").option("header", True).option("emptyValue", "").option("quoteAll", False).csv(path)


def write_open_trials(trials: DataFrame, measurements: DataFrame, path: str) -> None:
    """Trials of open runs alone, as JSON lines in a folder for each year. Other lanes are cut off before the join."""
    is_open = measurements.where("lane = 'open'").select("run_id", F.year("run_date").alias("year"))
    rows = trials.join(is_open, "run_id")
    ordered = rows.select("year", *sorted(trials.columns))
    ordered.repartition("year", "run_id").sortWithinPartitions("year", "run_id", "place").write.mode("errorifexists").partitionBy("year").json(path)


def append_observations(rows: DataFrame, path: str, causes: list[str]) -> None:
    """Append log lines; a line that ran has no cause, one that didn't has a known one."""
    bad = F.when(F.col("ran") & F.col("cause").isNotNull(), "a run has no cause").when(~F.col("ran") & ~F.coalesce(F.col("cause").isin(*causes), F.lit(False)), "unknown cause")
    checked = rows.withColumn("day", F.when(bad.isNull(), F.col("day")).otherwise(F.raise_error(bad).cast("date")))
    checked.write.mode("append").json(path)


def upsert_state(state: DataFrame, runs: DataFrame, path: str) -> None:
    """Write the last run of each job, old and new, to a new path."""
    last = state.unionByName(runs).groupBy("job").agg(F.max("last_run").alias("last_run"))
    last.write.mode("errorifexists").json(path)


def write_run(trials: DataFrame, measurement: DataFrame, path: str) -> None:
    """A run's files; nothing is ever written over."""
    trials.write.mode("errorifexists").json(f"{path}/trials")
    measurement.write.mode("errorifexists").json(f"{path}/measurement")


def write_declassified(protocols: DataFrame, trials: DataFrame, reasons: DataFrame, path: str) -> None:
    """All trials of protocols that may be opened; one that may not stops the whole bundle."""
    blocked = reasons.join(protocols.select("protocol_id"), "protocol_id").where(F.size("broken") > 0)
    if not blocked.isEmpty():
        raise ValueError("a protocol of the bundle may not be opened")
    chosen = materialize(protocols, "open-protocols")
    chosen.write.mode("errorifexists").json(f"{path}/protocols")
    trials.join(chosen.select("protocol_id"), "protocol_id").repartition("protocol_id", "run_id").sortWithinPartitions("protocol_id", "run_id", "place").write.mode("errorifexists").partitionBy("protocol_id").json(f"{path}/trials")


_KINDS = {"double": "sc:Float", "float": "sc:Float", "bigint": "sc:Integer", "int": "sc:Integer", "boolean": "sc:Boolean"}


def descriptor(name: str, sets: dict[str, DataFrame]) -> str:
    """A JSON description: one typed field for each column of each record set."""
    of = lambda df: [{"name": f.name, "dataType": _KINDS.get(f.dataType.simpleString(), "sc:Text")} for f in df.schema.fields]
    return json.dumps({"name": name, "recordSet": [{"name": k, "field": of(df)} for k, df in sets.items()]}, indent=2)


def file_manifest(spark, path: str) -> DataFrame:
    """path, bytes and a readable size of every file under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"))
    size = F.when(F.col("bytes") < 1024, F.concat(F.col("bytes").cast("string"), F.lit(" B"))).when(F.col("bytes") < 1 << 20, F.format_string("%.1f KB", F.col("bytes") / 1024)).otherwise(F.format_string("%.1f MB", F.col("bytes") / (1 << 20)))
    return files.withColumn("size", size)


def parsed_cells(cells: DataFrame, schema: str) -> DataFrame:
    """Cells of a published table in the types of `schema`; an empty cell is null."""

    def value(field: T.StructField) -> Column:
        text = F.nullif(F.col(field.name), F.lit(""))
        nested = isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType))
        return (F.from_json(text, field.dataType) if nested else text.cast(field.dataType)).alias(field.name)

    return cells.select(*(value(f) for f in T.StructType.fromDDL(schema).fields))


def append_alarms(records: DataFrame, path: str) -> None:
    """Append a line for each instrument record: run_date, ok, flag, the two checks and the guard protocol."""
    fields = ["run_date", "ok", "flag", "runtime_fingerprint_ok", "guard_margin_ok", "guard_protocol_id"]
    records.select(*fields).write.mode("append").option("ignoreNullFields", False).json(path)


def write_once(record: DataFrame, path: str) -> None:
    """Write a record that must not exist yet."""
    record.write.mode("errorifexists").json(path)


def log_bridge_gap(spark: SparkSession, path: str, today: str) -> bool:
    """Disclose that a bridge takes the place of this month's sweep: one gap line, unless the sweep ran or the gap is logged already."""
    row = spark.createDataFrame([("full_sweep", date.fromisoformat(today), False, "generation_bridge")], records.OBSERVATION)
    month = F.date_format("date", "yyyy-MM")

    def still_due(rows: DataFrame, log: DataFrame) -> DataFrame:
        seen = log.where((F.col("job") == "full_sweep") & (F.col("ran") | (F.col("cause") == "generation_bridge"))).select(month.alias("month")).distinct()
        return rows.withColumn("month", month).join(seen, "month", "left_anti").drop("month")

    return versioned.append(path, row, f"bridge-gap-{today}-{uuid.uuid4().hex}", still_due)


def log_listing(path: str, changes: DataFrame, today: str) -> bool:
    """Append the events of a listing's changes (family, model_id, change) for a day, once for each family, model and event."""
    rows = changes.select(F.lit("model_observed").alias("record_type"), F.lit(today).alias("observed_date"), "family", "model_id", F.col("change").alias("event"))
    same_day = lambda rows, log: rows.join(log.select("observed_date", "family", "model_id", "event"), ["observed_date", "family", "model_id", "event"], "left_anti").select(*rows.columns)
    return versioned.append(path, rows, f"listing-{today}-{uuid.uuid4().hex}", same_day)


def misnamed_percentages(units: dict[str, str], percent_units: set[str]) -> list[str]:
    """Fields whose name and unit disagree: `_pct` is in the name if and only if the unit is a percentage."""
    return [field for field, unit in units.items() if ("_pct" in field) != (unit in percent_units)]
