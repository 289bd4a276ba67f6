"""Readers of the record files that runs, schedulers and registries leave behind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRIAL = "record_type string, run_id string, index int, version string, scenario_id string, rep int, prompt_sha256 string, response_text string, stop_reason string, returned_model_id string, error string, outcome string, token string, reason string"
MEASUREMENT = "run_id string, run_date date, protocol_id string, series string, lane string, subject_model_id string, stability_pct double, ci_low_pct double, ci_high_pct double, gap_pct double, n int, n_valid map<string,bigint>, flags array<string>, outcomes map<string,map<string,bigint>>, on_curve boolean"
OBSERVATION = "job string, date date, ran boolean, cause string"
#: Bytes of a timestamp proof's header before the 32 bytes of the digest it proves, counted from 1.
DIGEST_AT = 34


def measurements(spark: SparkSession, folder: str) -> DataFrame:
    """Every run's measurement document; unfinished runs, staged in hidden folders, are left out."""
    rows = spark.read.schema(MEASUREMENT).option("multiLine", True).json(f"{folder}/*/measurement.json").withColumn("path", F.input_file_name())
    return rows.where(~F.col("path").rlike(r"/\.[^/]+/")).drop("path")


def protocol_documents(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Protocol documents by id; of documents with one id the last by path holds."""
    rows = spark.read.schema(schema).option("multiLine", True).json(folder).withColumn("_path", F.input_file_name())
    fields = [c for c in rows.columns if c != "_path"]
    return rows.groupBy("protocol_id").agg(F.max_by(F.struct(*fields), "_path").alias("p")).select("p.*")


def trials(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.schema(TRIAL).json(paths)


def saved_trials(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Trials of runs that were cut off, from one file each (a path, a pattern, or a list), with their file.

    Lines are known by their place in their file. A half-written last line is dropped; any
    other unreadable line, a line that is no trial, and a gap in the indexes are errors. A file is read
    as one row, since a run has some hundred lines; files are spread over tasks.
    """
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split("value", "\n").alias("lines"))
    some = F.filter(F.transform("lines", lambda text, k: F.struct((k + 1).alias("line"), text.alias("text"))), lambda x: F.trim(F.regexp_replace(x["text"], r"\s", " ")) != "")
    rows = files.select("file", some.alias("some")).select("file", F.size("some").alias("of"), F.posexplode("some").alias("n", "x"))
    read = F.from_json("x.text", f"{TRIAL}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = rows.select("file", "of", "n", "x.line", read.alias("t"))
    bad = F.col("t").isNull() | F.col("t._corrupt_record").isNotNull()
    where = F.concat(F.lit(" at line "), F.col("line").cast("string"), F.lit(" of "), F.col("file"))
    fault = (
        F.when(bad, F.concat(F.lit("an unreadable line that isn't the last"), where))
        .when(~F.coalesce(F.col("t.record_type") == "trial", F.lit(False)), F.concat(F.lit("a line that is no trial"), where))
        .when(~F.coalesce(F.col("t.index") == F.col("n"), F.lit(False)), F.concat(F.lit("a gap in the indexes"), where))
    )
    kept = rows.where(~(bad & (F.col("n") == F.col("of") - 1)))
    index = F.when(fault.isNull(), F.col("t.index")).otherwise(F.raise_error(fault).cast("int"))
    return kept.select("file", F.col("t").dropFields("_corrupt_record").withField("index", index).alias("t")).select("file", "t.*")


def resumed(schedule: DataFrame, saved: DataFrame) -> DataFrame:
    """The schedule with saved replies where there are some (their prompts must agree); the rest has `fetch`."""
    s = saved.select("index", F.col("prompt_sha256").alias("saved_sha"), "response_text", "stop_reason", "error")
    rows = schedule.join(s, "index", "left")
    same = F.col("saved_sha").isNull() | (F.col("saved_sha") == F.col("prompt_sha256"))
    sha = F.when(same, F.col("prompt_sha256")).otherwise(F.raise_error(F.lit("a saved reply answers another prompt")).cast("string"))
    return rows.withColumns({"prompt_sha256": sha, "fetch": F.col("saved_sha").isNull()}).drop("saved_sha")


def observations(spark: SparkSession, path: str) -> DataFrame:
    """A log of JSON lines; a missing log is an empty one."""
    try:
        return spark.read.schema(OBSERVATION).json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], OBSERVATION)


def runs_by_name(spark: SparkSession, folder: str) -> DataFrame:
    """date, protocol_id, model_id, replicate from folder names `<date>__<protocol>__<model>__r<N>`; other names are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    parts = F.split(F.element_at(F.split("path", "/"), -2), "__")
    rows = files.select(parts.alias("p")).where(F.size("p") >= 4).distinct()
    n = F.size("p")
    replicate = F.regexp_extract(F.get("p", n - 1), r"^r(\d+)$", 1)
    out = rows.select(F.try_to_date(F.get("p", F.lit(0)), "yyyy-MM-dd").alias("date"), F.array_join(F.slice("p", F.lit(2), n - 3), "__").alias("protocol_id"), F.get("p", n - 2).alias("model_id"), replicate.alias("r"))
    return out.where("date is not null and r <> ''").select("date", "protocol_id", "model_id", F.col("r").cast("int").alias("replicate"))


def cadence(spark: SparkSession, path: str) -> DataFrame:
    """job, interval_days of the lines whose value is a bare `<N>d` or `<N>h`; comments are dropped."""
    line = F.trim(F.regexp_replace("value", "#.*$", ""))
    found = spark.read.text(path).select(line.alias("line")).select(F.regexp_extract("line", r"^([^:]+):\s*(\d+)([dh])$", 1).alias("job"), F.regexp_extract("line", r"^([^:]+):\s*(\d+)([dh])$", 2).alias("n"), F.regexp_extract("line", r"^([^:]+):\s*(\d+)([dh])$", 3).alias("unit"))
    days = F.col("n").cast("double") / F.when(F.col("unit") == "h", 24.0).otherwise(1.0)
    return found.where("job <> ''").select(F.trim("job").alias("job"), days.alias("interval_days"))


GENERATION = "place int, series string, model_id string, model_family string, status string, declared_successor string"


def generations(text: str) -> list[tuple]:
    """Rows of GENERATION from an indented file: metadata, a few lines.

    Series are the keys right under the outermost one, whatever their names and whatever keys lie
    between them and their list of models; a `null` or missing value is none, and so is a model without an id.
    """
    out: list[dict] = []
    above: list[tuple[int, str]] = []  # the keys without a value that the line lies under
    for line in text.splitlines():
        bare = line.split("#", 1)[0].rstrip()
        if not bare.strip():
            continue
        depth = len(bare) - len(bare.lstrip())
        key, _, value = bare.strip().removeprefix("- ").partition(":")
        key, value = key.strip(), value.strip().strip("\"'")
        above = [h for h in above if h[0] < depth]
        if bare.lstrip().startswith("- model_id") and len(above) > 1:
            out.append({"series": above[1][1], "at": depth})
        if not value:
            above.append((depth, key))
        elif out and depth >= out[-1]["at"] and len(above) > 1 and above[1][1] == out[-1]["series"] and key in ("model_id", "model_family", "status", "declared_successor"):
            out[-1][key] = None if value == "null" else value
    known = [g for g in out if g.get("model_id")]
    return [(k, g["series"], g["model_id"], g.get("model_family"), g.get("status"), g.get("declared_successor")) for k, g in enumerate(known)]


def active_models(generations: DataFrame) -> DataFrame:
    """series -> the last generation with status active."""
    return generations.where("status = 'active'").groupBy("series").agg(F.max_by("model_id", "place").alias("model_id"))


def stamped_manifests(spark: SparkSession, folder: str, manifest_schema: str) -> DataFrame:
    """Entries of manifests whose content is proven by a sibling proof file (`<name>.ots`)."""
    files = spark.read.format("binaryFile").load(folder)
    digest = F.lower(F.hex(F.substring("content", DIGEST_AT, 32)))
    proofs = files.where(F.endswith("path", F.lit(".ots"))).select(F.regexp_replace("path", r"\.ots$", "").alias("path"), digest.alias("digest"))
    proven = files.join(proofs, "path").where(F.sha2("content", 256) == F.col("digest"))
    entries = proven.select(F.col("path").alias("manifest"), F.explode(F.from_json(F.decode("content", "UTF-8"), f"array<struct<{manifest_schema}>>")).alias("e"))
    return entries.select("e.*", "manifest").groupBy("protocol_id", "panel_sha256", "protocol_sha256").agg(F.min("manifest").alias("manifest"))


def pending_proofs(spark: SparkSession, folder: str, tag: str) -> DataFrame:
    """Proof files that lack an attestation tag (hex), looked for at whole bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ots").load(folder)
    bytes_ = F.regexp_replace(F.lower(F.hex("content")), "(..)", "$1 ")
    spaced = " ".join(tag[i : i + 2] for i in range(0, len(tag), 2)).lower()
    return files.where(~F.contains(bytes_, F.lit(spaced))).select("path")


def declassified(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a declassification list; one without protocol_id, date or reason is an error."""
    entry = "declassified array<struct<protocol_id:string,date:string,reason:string>>"
    rows = spark.read.schema(entry).option("multiLine", True).json(path).select(F.explode("declassified").alias("e")).select("e.*")
    whole = F.forall(F.array("protocol_id", "date", "reason"), lambda x: F.coalesce(x, F.lit("")) != "")
    return rows.withColumn("protocol_id", F.when(whole, F.col("protocol_id")).otherwise(F.raise_error(F.lit("an entry needs protocol_id, date and reason")).cast("string")))


def model_in_use(generations: DataFrame, series: str, override: str | None = None) -> str:
    """The model named outright, else the series' active one; none is an error."""
    if override:
        return override
    found = active_models(generations).where(F.col("series") == series).first()
    if found is None:
        raise LookupError(f"no active model in {series}")
    return found["model_id"]
