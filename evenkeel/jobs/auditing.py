"""Queries that audit stored results, and queries over pages and published rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.functions import grammar as G
from evenkeel.functions.pages import contents, markdown_sections, sections
from evenkeel.jobs import counting, publish, reading
from evenkeel.operators import audit as A
from evenkeel.operators import counts, gates
from evenkeel.operators import history as H
from evenkeel.sources.derived import history, observations, responses, trials, with_views
from evenkeel.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_STABLE = with_views("trials", counting._per("run_id", "c") + f", s AS (SELECT run_id, CAST(substr(run_id, 5) AS INTEGER) AS k, {counting._STABLE} AS stability_pct, {counting._pct('A', 'B')} AS gap_pct, v_A + v_B AS valid FROM c)")


@query(_STABLE + ", p AS (SELECT run_id, round(stability_pct, 3) + CASE WHEN k % 5 = 0 THEN 0.25 ELSE 0 END AS published, stability_pct AS recomputed FROM s) SELECT run_id, round(published, 6) AS published, recomputed, abs(published - recomputed) <= 0.001 AS agrees FROM p")
def op_recompute_matches(spark: SparkSession, folder: str) -> DataFrame:
    fresh = counts.tvd_stability(trials(spark, folder))
    k = F.substr("run_id", F.lit(5)).cast("int")
    stored = fresh.select("run_id", (F.round("stability_pct", 3) + F.when(k % 5 == 0, 0.25).otherwise(0.0)).alias("stability_pct"))
    return A.off_by(stored, fresh, "run_id", "stability_pct", 1e-3).withColumn("published", F.round("published", 6))


@query(_STABLE + """, f AS (SELECT s.run_id, s.k, s.stability_pct, c.v_A + c.v_B AS valid FROM s JOIN c ON c.run_id = s.run_id),
t AS (SELECT run_id, CASE WHEN k % 4 <> 1 THEN stability_pct END AS stability_pct, CASE WHEN k % 3 = 1 THEN valid + 1 ELSE valid END AS valid FROM f), g AS (SELECT * FROM f WHERE k <> 7)
SELECT t.run_id, CASE WHEN g.run_id IS NULL THEN 'not_rebuilt' ELSE concat_ws(',', CASE WHEN t.stability_pct IS DISTINCT FROM g.stability_pct THEN 'stability_pct' END, CASE WHEN t.valid IS DISTINCT FROM g.valid THEN 'valid' END) END AS differs FROM t LEFT JOIN g ON g.run_id = t.run_id""")
def op_field_diff(spark: SparkSession, folder: str) -> DataFrame:
    rows = counts.with_pairs(counts.tally(trials(spark, folder), ["run_id"]))
    fresh = rows.select("run_id", counts.stability().alias("stability_pct"), counts.percent(rows, "gap", "ab").alias("gap_pct"), (F.col("valid_A") + F.col("valid_B")).alias("valid"))
    k = F.substr("run_id", F.lit(5)).cast("int")
    stored = fresh.select("run_id", F.when(k % 4 == 1, F.lit(None).cast("double")).otherwise(F.col("stability_pct")).alias("stability_pct"), "gap_pct", F.when(k % 3 == 1, F.col("valid") + 1).otherwise(F.col("valid")).alias("valid"))
    return A.field_diff(stored, fresh.where(k != 7), ["run_id"]).withColumn("differs", F.array_join("differs", ","))


_READ_BY = [f"({with_views('responses', reading._read(version) + reading._READ)})" for version in (1, 2)]


@query(f""" SELECT a.conv_id % 10 AS lot, count(*) AS trials, count(*) FILTER (WHERE a.outcome IS DISTINCT FROM b.outcome OR a.token IS DISTINCT FROM b.token OR a.reason IS DISTINCT FROM b.reason) AS changed
FROM {_READ_BY[0]} a JOIN {_READ_BY[1]} b ON a.conv_id = b.conv_id AND a.turn = b.turn GROUP BY ALL""")
def op_reclassified(spark: SparkSession, folder: str) -> DataFrame:
    rows = responses(spark, folder)
    read = lambda version: G.extract(rows, ["A", "B"], version).select("conv_id", "turn", (F.col("conv_id") % 10).alias("lot"), "read.*")
    return A.reclassified(read(1), read(2), ["conv_id", "turn", "lot"], ["lot"])


@query(with_views("trials", """, o AS (SELECT run_id, version, scenario_id, row_number() OVER (PARTITION BY run_id ORDER BY place) - 1 AS p, place, scenario_id AS call FROM trials),
k AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY place) - 1 AS p, scenario_id AS call FROM trials WHERE place % 997 <> 0)
SELECT coalesce(o.run_id, k.run_id) AS run_id, count(o.call) AS scheduled, count(k.call) AS kept, coalesce(min(CASE WHEN o.call IS DISTINCT FROM k.call THEN coalesce(o.p, k.p) END), -1) AS parts_at FROM o FULL JOIN k ON o.run_id = k.run_id AND o.p = k.p GROUP BY ALL"""))
def op_trial_audit(spark: SparkSession, folder: str) -> DataFrame:
    rows = trials(spark, folder).select("run_id", "scenario_id", F.col("place").alias("at"))
    numbered = lambda t: A.numbered(t, "run_id", "at").select("run_id", "place", F.col("scenario_id").alias("call"))
    found = A.schedule_check(numbered(rows), numbered(rows.where("at % 997 <> 0")), ["run_id"])
    return found.withColumn("parts_at", F.coalesce("parts_at", F.lit(-1).cast("long")))


@query(with_views("history", f""", m AS (SELECT * FROM history WHERE model_id = 'model_0'), l AS (SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY protocol_id, series ORDER BY run_date DESC, run_id DESC) AS r FROM m) WHERE r = 1),
z AS (SELECT l.protocol_id, l.series, o.model_id, o.stability_pct AS x_s, o.ci_low_pct AS x_l, o.ci_high_pct AS x_h, o.bound_pct AS x_b, l.stability_pct AS y_s, l.ci_low_pct AS y_l, l.ci_high_pct AS y_h, l.bound_pct AS y_b
  FROM l JOIN history o ON o.protocol_id = l.protocol_id AND o.series = l.series AND o.model_id <> 'model_0' WHERE l.stability_pct IS NOT NULL AND o.stability_pct IS NOT NULL),
v AS (SELECT *, CASE WHEN abs(y_s - x_s) >= sqrt(((x_h - x_l) / 2) * ((x_h - x_l) / 2) + ((y_h - y_l) / 2) * ((y_h - y_l) / 2)) AND abs(y_s - x_s) > x_b + y_b THEN CASE WHEN y_s > x_s THEN 'improved' ELSE 'regressed' END ELSE 'flat' END AS verdict FROM z)
SELECT protocol_id, series, model_id, verdict, count(*) AS measurements FROM v GROUP BY ALL"""))
def op_same_protocol(spark: SparkSession, folder: str) -> DataFrame:
    rows = history(spark, folder)
    own = H.latest(rows.where("model_id = 'model_0'")).select("protocol_id", "series", F.struct(*H.FIGURES).alias("own"))
    other = rows.where("model_id <> 'model_0'").select("protocol_id", "series", "model_id", F.struct(*H.FIGURES).alias("other"))
    met = own.join(other, ["protocol_id", "series"]).withColumn("verdict", gates.compare("other", "own")).where("verdict is not null")
    return met.groupBy("protocol_id", "series", "model_id", "verdict").agg(F.count("*").alias("measurements"))


@query(with_views("observations", """, f AS (SELECT CAST(day AS VARCHAR) AS day, job || '_' || (place % 9) AS key, CASE WHEN place % 5 = 0 THEN 'b' ELSE 'a' END AS value, place FROM observations),
w AS (SELECT day AS owner, key, arg_min(value, place) AS v FROM f WHERE place % 2 = 0 GROUP BY ALL), h AS (SELECT day AS owner, key, arg_min(value, place) AS v FROM f WHERE place % 3 <> 0 GROUP BY ALL)
SELECT coalesce(w.owner, h.owner) AS owner, coalesce(w.key, h.key) AS key, CASE WHEN h.v IS NULL THEN 'missing' WHEN w.v IS NULL THEN 'unexpected' ELSE 'differs' END AS what FROM w FULL JOIN h ON w.owner = h.owner AND w.key = h.key WHERE w.v IS DISTINCT FROM h.v"""))
def op_fingerprint_diff(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("place")
    rows = observations(spark, folder).select(F.col("day").cast("string").alias("owner"), F.concat_ws("_", "job", (k % 9).cast("string")).alias("key"), F.when(k % 5 == 0, "b").otherwise("a").alias("value"), "place")
    side = lambda test: rows.where(test).groupBy("owner", "key").agg(F.min_by("value", "place").alias("value"))
    return gates.map_mismatches(side(k % 2 == 0), side(k % 3 != 0))


@query(with_views("observations", """, d AS (SELECT CAST(day AS VARCHAR) AS day, CASE WHEN count(*) % 3 <> 0 THEN count(*) FILTER (WHERE NOT ran) < 27 END AS fingerprint_ok, count(*) % 4 <> 1 AS margin_ok FROM observations GROUP BY ALL)
SELECT day, fingerprint_ok, margin_ok, CASE WHEN NOT (coalesce(fingerprint_ok, false) AND coalesce(margin_ok, false)) THEN 'instrument_suspect' END AS flag FROM d"""))
def op_day_status(spark: SparkSession, folder: str) -> DataFrame:
    days = observations(spark, folder).groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"), F.count_if(~F.col("ran")).alias("gaps"))
    return gates.day_status(days.select("day", F.when(F.col("n") % 3 != 0, F.col("gaps") < 27).alias("fingerprint_ok"), (F.col("n") % 4 != 1).alias("margin_ok")))


_TEXT = "trim(regexp_replace(" + "replace(replace(replace(replace(replace(replace(regexp_replace({0}, '<[^>]*>', '', 'gs'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')" + ", '[ \\t\\r\\n]+', ' ', 'g'))"


@query(f""" WITH s AS (SELECT page_id, list_prepend('', regexp_extract_all(html, '(<h[1-6][^>]*>.*?</h[1-6]>)', 1, 's')) AS heads, string_split_regex(html, '<h[1-6][^>]*>.*?</h[1-6]>', 's') AS bodies FROM pages),
x AS (SELECT page_id, unnest(range(len(bodies))) AS i, heads, bodies FROM s), y AS (SELECT page_id, CAST(i AS INTEGER) AS place, {_TEXT.format('heads[i + 1]')} AS heading, {_TEXT.format('bodies[i + 1]')} AS body FROM x)
SELECT page_id, place, heading, regexp_replace(regexp_replace(lower(heading), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS anchor, left(body, 220) AS snippet FROM y WHERE heading <> '' OR body <> ''""")
def op_html_sections(spark: SparkSession, folder: str) -> DataFrame:
    return sections(table(spark, folder, "pages").select("page_id", "html"))


@query(""" WITH l AS (SELECT doc_id AS page_id, CAST(unnest(range(len(string_split(text, chr(10))))) AS INTEGER) AS i, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
m AS (SELECT page_id, i * 9 + j AS n, j, CASE j WHEN 0 THEN '# Part ' || (i % 3) || ' of _' || page_id || '_' WHEN 2 THEN '```sql' WHEN 5 THEN '```' WHEN 6 THEN '### Detail' ELSE NULL END AS fixed, i, line FROM l, (SELECT unnest(range(9)) AS j)),
h AS (SELECT page_id, n, j, CASE WHEN j = 0 THEN 1 ELSE 3 END AS level, CASE WHEN j = 0 THEN 'Part ' || (i % 3) || ' of ' || page_id ELSE 'Detail' END AS heading, CASE WHEN j = 0 THEN 'part-' || (i % 3) || '-of-' || page_id ELSE 'detail' END AS slug,
  left(trim(regexp_replace(translate(CASE WHEN j = 0 THEN 'said: ' || line || ' # no heading in here' ELSE 'end of part ' || i END, '|`*_', ' '), '\\s+', ' ', 'g')), 220) AS snippet FROM m WHERE j IN (0, 6)),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY n) AS INTEGER) AS place, row_number() OVER (PARTITION BY page_id, slug ORDER BY n) AS nth FROM h)
SELECT page_id, place, level, heading, slug || CASE WHEN nth > 1 THEN '-' || nth ELSE '' END AS anchor, CASE WHEN level = 3 THEN place - 1 END AS parent, sha256(snippet) AS snippet_sha256 FROM p""")
def op_markdown_sections(spark: SparkSession, folder: str) -> DataFrame:
    return markdown_sections(_markdown(spark, folder)).select("page_id", "place", "level", "heading", "anchor", "parent", F.sha2("snippet", 256).alias("snippet_sha256"))


def _markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Each line of a document becomes two sections of a markdown page, with a fence that holds what looks like a heading."""
    line = lambda x, i: F.concat(F.lit("# Part "), (i % 3).cast("string"), F.lit(" of _"), F.col("doc_id").cast("string"), F.lit("_\nsaid: "), x, F.lit("\n```sql\n# no heading\n  in here\n```\n### Detail ###\n> end of part "), i.cast("string"), F.lit("\n"))
    lines = F.transform(F.split("text", "\n"), line)
    return table(spark, folder, "documents").select("doc_id", "text").select(F.col("doc_id").alias("page_id"), F.array_join(lines, "\n").alias("text"))


@query(f" SELECT page_id, place, level, heading, anchor, parent FROM ({SQL['op_markdown_sections']}) m WHERE level BETWEEN 2 AND 3")
def op_markdown_contents(spark: SparkSession, folder: str) -> DataFrame:
    return contents(markdown_sections(_markdown(spark, folder)))


@query(with_views("trials", counting._GATED + """ SELECT run_id, CASE WHEN len(flags) = 0 THEN '[]' ELSE '["' || array_to_string(flags, '", "') || '"]' END AS flags, CASE WHEN reading IS NULL THEN '' WHEN reading THEN 'True' ELSE 'False' END AS reading,
  CASE WHEN all_passed THEN 'True' ELSE 'False' END AS all_passed, '{"A": ' || v_A || ', "A_prime": ' || v_A_prime || ', "B": ' || v_B || ', "C": ' || v_C || '}' AS n_valid, coalesce(CAST(concentration_pct AS VARCHAR), '') AS concentration_pct FROM e"""))
def op_csv_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = counting.gated(spark, folder)
    valid = F.map_from_arrays(F.array(*map(F.lit, ("A", "A_prime", "B", "C"))), F.array("valid_A", "valid_A_prime", "valid_B", "valid_C"))
    return publish.csv_cells(rows.select("run_id", "flags", "reading", "all_passed", valid.alias("n_valid"), "concentration_pct"))


@query(with_views("protocols history", """, m AS (SELECT DISTINCT CAST(substr(protocol_id, 2) AS INTEGER) AS k, model_id FROM history), p AS (SELECT DISTINCT place % 97 AS k FROM protocols WHERE status = 'admitted')
SELECT (SELECT count(*) FROM p) AS admitted, (SELECT count(*) FROM p WHERE k IN (SELECT k FROM m WHERE model_id = 'model_0')) AS measured, (SELECT count(*) FROM p WHERE k IN (SELECT k FROM m) AND k NOT IN (SELECT k FROM m WHERE model_id = 'model_0')) AS earlier_only,
  (SELECT CAST(max(run_date) AS VARCHAR) FROM history) AS as_of"""))
def op_coverage_counts(spark: SparkSession, folder: str) -> DataFrame:
    from evenkeel.sources.derived import protocols

    p = protocols(spark, folder).where("status = 'admitted'").select((F.col("place") % 97).alias("k")).distinct()
    rows = history(spark, folder)
    m = rows.groupBy(F.substr("protocol_id", F.lit(2)).cast("long").alias("k")).agg(F.max(F.col("model_id") == "model_0").alias("now"), F.max("run_date").alias("last"))
    both = p.withColumn("admitted", F.lit(True)).join(m, "k", "full")
    return both.agg(F.count_if("admitted").alias("admitted"), F.count_if(F.col("admitted") & F.col("now")).alias("measured"), F.count_if(F.col("admitted") & ~F.col("now")).alias("earlier_only"), F.max("last").cast("string").alias("as_of"))


@query(with_views("history", """, l AS (SELECT protocol_id, series, model_id, arg_max(struct_pack(s := stability_pct, r := run_id), (run_date, run_id)) AS m FROM history GROUP BY ALL),
a AS (SELECT protocol_id, series, model_id, m.s + (CAST(substr(m.r, 2) AS BIGINT) % 4) * 0.02 AS quoted FROM l WHERE m.s IS NOT NULL)
SELECT a.protocol_id, a.series, a.model_id, round(a.quoted, 6) AS published, l.m.s AS recomputed, l.m.s IS NOT NULL AND abs(a.quoted - l.m.s) <= 0.05 AS agrees FROM a LEFT JOIN l ON l.protocol_id = a.protocol_id AND l.series = a.series AND l.model_id = a.model_id AND l.series = 'commercial'"""))
def op_quoted_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scores as others quote them, to within 0.05 of what is published; a series that isn't published agrees with nothing."""
    key = ["protocol_id", "series", "model_id"]
    now = H.latest(history(spark, folder)).select(*key, "run_id", "stability_pct")
    off = F.substr("run_id", F.lit(2)).cast("long") % 4 * 0.02
    quoted = now.where("stability_pct is not null").select(*key, (F.col("stability_pct") + off).alias("stability_pct"))
    found = A.off_by(quoted, now.where("series = 'commercial'"), key, "stability_pct", 0.05)
    return found.withColumns({"published": F.round("published", 6), "agrees": F.coalesce("agrees", F.lit(False))})
