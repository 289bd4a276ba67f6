"""Queries over replies, protocols, hashes and resampling. Each has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.functions import grammar as G
from evenkeel.functions import hashing as S
from evenkeel.functions.exact import published
from evenkeel.operators import admission, counts, protocols as P, resampling as R, rewording
from evenkeel.sources.derived import history, protocols, responses, trials, with_views
from evenkeel.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _read(version: int) -> str:
    bad = "WHEN len(tails) > len(known) THEN 'token_not_in_options' " if version == 1 else ""
    none = "tails" if version == 1 else "known"
    return f""", n AS (SELECT *, list_transform(string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e]'), lambda x: regexp_replace(trim(regexp_replace(translate(lower(nfc_normalize(x)), '*_`', ''), '\\s+', ' ', 'g')), '[.!;· ]+$', '')) AS ls FROM responses),
d AS (SELECT *, list_transform(list_filter(ls, lambda x: regexp_matches(x, '^decision ?[:：] ?')), lambda x: regexp_extract(x, '^decision ?[:：] ?(.*)$', 1)) AS tails FROM n),
k AS (SELECT *, list_filter(tails, lambda x: x IN ('a', 'b')) AS known FROM d),
r AS (SELECT *, CASE WHEN text IS NULL OR trim(text, ' ' || chr(10) || chr(9) || chr(13)) = '' THEN 'empty_response' WHEN len({none}) = 0 THEN 'no_decision_line' {bad}WHEN len(list_distinct(known)) > 1 THEN 'conflicting_decisions' END AS why FROM k)"""


_READ = " SELECT conv_id, turn, CASE WHEN why = 'empty_response' THEN 'empty' WHEN why IS NOT NULL THEN 'unparseable' ELSE 'valid' END AS outcome, CASE WHEN why IS NULL THEN upper(known[1]) END AS token, why AS reason FROM r"


def _graded(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return G.extract(responses(spark, folder), ["A", "B"], version).select("conv_id", "turn", "read.*")


@query(with_views("responses", _read(1) + _READ))
def op_grammar_v1(spark: SparkSession, folder: str) -> DataFrame:
    return _graded(spark, folder, 1)


@query(with_views("responses", _read(2) + _READ))
def op_grammar_v2(spark: SparkSession, folder: str) -> DataFrame:
    return _graded(spark, folder, 2)


@query(with_views("responses", _read(2) + """ SELECT conv_id, turn, CASE WHEN error IS NOT NULL THEN 'blocked_upstream' WHEN stop_reason = 'refusal' THEN 'refused' WHEN stop_reason = 'max_tokens' THEN 'truncated' WHEN text IS NULL THEN 'off_format'
  WHEN why = 'empty_response' THEN 'empty' WHEN why IS NOT NULL THEN 'unparseable' ELSE 'valid' END AS outcome,
  CASE WHEN error IS NULL AND stop_reason = 'end_turn' AND text IS NOT NULL AND why IS NULL THEN upper(known[1]) END AS token,
  CASE WHEN error IS NOT NULL THEN error WHEN stop_reason = 'refusal' THEN 'stop_reason=refusal' WHEN stop_reason = 'max_tokens' THEN 'stop_reason=max_tokens' WHEN text IS NULL THEN 'no_text_content' ELSE why END AS reason FROM r"""))
def op_classify(spark: SparkSession, folder: str) -> DataFrame:
    return G.classify(responses(spark, folder), ["A", "B"], 2).select("conv_id", "turn", "outcome", "token", "reason")


@query(" WITH s AS (SELECT conv_id, turn, regexp_replace(replace(replace(lower(text), 'ß', 'ss'), 'ς', 'σ'), '[^\\p{L}\\p{N}]+', '', 'g') AS bare FROM conversations) SELECT conv_id, turn, sha256(bare) AS skeleton_sha256, length(bare) AS n_chars FROM s")
def op_surface_skeleton(spark: SparkSession, folder: str) -> DataFrame:
    bare = G.surface_skeleton(F.col("text"))
    return table(spark, folder, "conversations").select("conv_id", "turn", F.sha2(bare, 256).alias("skeleton_sha256"), F.char_length(bare).cast("long").alias("n_chars"))


@query(" SELECT conv_id, turn, sha256('Read this. ' || text || chr(10) || 'State your decision.') AS prompt_sha256 FROM conversations")
def op_prompt_hashes(spark: SparkSession, folder: str) -> DataFrame:
    made = G.prompt(F.lit("Read this. {scenario}\nState your decision."), F.col("text"))
    return table(spark, folder, "conversations").select("conv_id", "turn", F.sha2(made, 256).alias("prompt_sha256"))


_SAID = ["Your CREDIT balance is too low to access the API", "You have reached your specified API usage limits", "Invalid billing address field", "rate limit exceeded", "Number of API usage limits reached", "try again", None]


@query(f""" WITH e AS (SELECT event_id, event_type, ([400, 401, 402, 403, 429, 500, NULL])[event_id % 7 + 1] AS status, ({_SAID!r})[user_id % {len(_SAID)} + 1] AS said FROM events)
SELECT event_id, event_type, coalesce(status IN (400, 402, 403, 429) AND (contains(lower(said), 'credit balance is too low') OR contains(lower(said), 'api usage limits') OR contains(lower(said), 'reached your specified')), false) AS funds_error FROM e""".replace("None", "NULL"))
def op_funds_errors(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select("event_id", "event_type", "user_id")
    status = F.element_at(F.array(*map(F.lit, (400, 401, 402, 403, 429, 500, None))), (F.col("event_id") % 7 + 1).cast("int"))
    message = F.element_at(F.array(*map(F.lit, _SAID)), (F.col("user_id") % len(_SAID) + 1).cast("int"))
    return e.select("event_id", "event_type", G.funds_error(status, message).alias("funds_error"))


@query(""" SELECT conv_id, count(*) FILTER (WHERE role = 'assistant') AS blocks, CAST(coalesce(length(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE role = 'assistant')), -1) AS BIGINT) AS n_chars FROM conversations GROUP BY conv_id""")
def op_text_blocks(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", F.struct("turn", F.when(F.col("role") == "assistant", "text").otherwise("other").alias("type"), "text").alias("b"))
    said = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("b")).alias("bs"))
    n = F.size(F.filter("bs", lambda b: b["type"] == "text")).cast("long")
    return said.select("conv_id", n.alias("blocks"), F.coalesce(F.char_length(G.text_blocks(F.col("bs"))), F.lit(-1)).cast("long").alias("n_chars"))


@query(with_views("protocols", " SELECT place, CASE WHEN regexp_matches(protocol_id, '^(.+)__v(\\d+)$') THEN regexp_extract(protocol_id, '^(.+)__v(\\d+)$', 1) ELSE protocol_id END AS prefix, CAST(regexp_extract(protocol_id, '^(.+)__v(\\d+)$', 2) AS INTEGER) AS version, split_part(protocol_id, '__', 1) AS family, split_part(protocol_id, '__', 2) AS type FROM protocols"))
def op_protocol_names(spark: SparkSession, folder: str) -> DataFrame:
    prefix, n = G.version_of(F.col("protocol_id"))
    part = lambda i: F.split_part("protocol_id", F.lit("__"), F.lit(i))
    return protocols(spark, folder).select("place", prefix.alias("prefix"), n.alias("version"), part(1).alias("family"), part(2).alias("type"))


@query(with_views("protocols", " SELECT place, sha256('{\"family\":\"' || family || '\",\"grammar_version\":' || grammar_version || ',\"lane\":' || coalesce('\"' || lane || '\"', 'null') || ',\"n\":' || n || ',\"protocol_id\":\"' || protocol_id || '\",\"status\":\"' || status || '\"}') AS sha256 FROM protocols"))
def op_canonical_hash(spark: SparkSession, folder: str) -> DataFrame:
    rows = protocols(spark, folder)
    return rows.select("place", S.row_sha256(rows.schema, "protocol_id", "family", "n", "status", "lane", "grammar_version").alias("sha256"))


@query(with_views("history", " SELECT run_id, CAST(run_date AS VARCHAR) || '__' || protocol_id || '__' || model_id || '__r' || (CAST(substr(run_id, 2) AS BIGINT) % 3) AS name FROM history"))
def op_run_ids(spark: SparkSession, folder: str) -> DataFrame:
    replicate = F.substr("run_id", F.lit(2)).cast("long") % 3
    return history(spark, folder).select("run_id", S.run_id(F.col("run_date"), F.col("protocol_id"), F.col("model_id"), replicate).alias("name"))


@query(" SELECT conv_id, sha256(string_agg(role || '/' || turn || chr(0) || text || chr(0), '' ORDER BY role || '/' || turn)) AS sha256 FROM conversations GROUP BY conv_id")
def op_files_hash(spark: SparkSession, folder: str) -> DataFrame:
    """Each conversation's turns as files named by role and turn."""
    file = F.struct(F.concat_ws("/", "role", F.col("turn").cast("string")).alias("path"), F.col("text").alias("content"))
    files = table(spark, folder, "conversations").groupBy("conv_id").agg(F.collect_list(file).alias("files"))
    return files.select("conv_id", S.files_sha256(F.col("files")).alias("sha256"))


@query(with_views("history", " SELECT run_id, CAST(CAST('0x' || substr(sha256(protocol_id || '‖' || CAST(run_date AS VARCHAR) || '‖' || model_id), 1, 16) AS UBIGINT) AS VARCHAR) AS seed FROM history"))
def op_seeds(spark: SparkSession, folder: str) -> DataFrame:
    return history(spark, folder).select("run_id", S.seed(F.col("protocol_id"), F.col("run_date").cast("string"), F.col("model_id")).alias("seed"))


@query(with_views("history", " SELECT run_id, h AS hash FROM (SELECT run_id, sha256('2026-01-31:' || run_id) AS h FROM history) ORDER BY h LIMIT 20"))
def op_hash_sample(spark: SparkSession, folder: str) -> DataFrame:
    return history(spark, folder).select("run_id", S.sample_order(F.lit("2026-01-31"), F.col("run_id")).alias("hash")).orderBy("hash").limit(20)


@query(""" WITH c AS (SELECT conv_id, turn, length(text) AS tin, turn * 37 AS tout, CASE conv_id % 4 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 15 END AS pin, CASE conv_id % 4 WHEN 0 THEN 15 WHEN 1 THEN 5 WHEN 2 THEN 75 END AS pout FROM conversations)
SELECT conv_id, turn, CAST((tin * pin + tout * pout + 99) // 100 AS DOUBLE) / 10000 AS cost FROM c""")
def op_token_costs(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("conv_id") % 4
    price = lambda a, b, c: F.when(k == 0, a).when(k == 1, b).when(k == 2, c)
    cost = S.token_cost(F.char_length("text"), F.col("turn") * 37, price(3, 1, 15), price(15, 5, 75))
    return table(spark, folder, "conversations").select("conv_id", "turn", cost.alias("cost"))


@query(with_views("protocols", """, p AS (SELECT place, protocol_id, CASE WHEN place % 41 = 0 THEN 'tone' ELSE rewording_type END AS rewording_type, CASE WHEN place % 43 = 0 THEN 'draft' ELSE status END AS status,
  CASE WHEN place % 27 = 0 THEN 'open' WHEN place % 47 = 0 THEN 'hidden' ELSE lane END AS lane, CASE WHEN place % 18 = 0 THEN place + 5 WHEN place % 53 = 0 THEN place ELSE twin END AS twin FROM protocols)
SELECT place, protocol_id, concat_ws(',', CASE WHEN rewording_type NOT IN ('wording', 'order', 'default', 'anchoring') THEN 'unknown_type' END, CASE WHEN status NOT IN ('candidate', 'admitted', 'retired') THEN 'unknown_status' END, CASE WHEN lane NOT IN ('open', 'guard', 'sealed') THEN 'unknown_lane' END,
  CASE WHEN status = 'candidate' AND lane IS NOT NULL THEN 'candidate_has_lane' END, CASE WHEN status = 'candidate' AND twin IS NOT NULL THEN 'candidate_has_twin' END, CASE WHEN status = 'admitted' AND lane = 'open' AND twin IS NULL THEN 'open_without_twin' END, CASE WHEN twin = place THEN 'own_twin' END) AS broken FROM p"""))
def op_lane_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Every rule is broken by some."""
    k, c = F.col("place"), F.col
    odd = {
        "rewording_type": F.when(k % 41 == 0, "tone").otherwise(c("rewording_type")), "status": F.when(k % 43 == 0, "draft").otherwise(c("status")),
        "lane": F.when(k % 27 == 0, "open").when(k % 47 == 0, "hidden").otherwise(c("lane")), "twin": F.when(k % 18 == 0, k + 5).when(k % 53 == 0, k).otherwise(c("twin")),
    }
    return P.lane_rules(protocols(spark, folder).withColumns(odd)).withColumn("broken", F.array_join("broken", ","))


@query(with_views("protocols", """ SELECT a.place, a.twin, concat_ws(',', CASE WHEN b.place IS NULL THEN 'no_such_twin' END, CASE WHEN b.place IS NOT NULL AND b.twin IS DISTINCT FROM a.place THEN 'not_mutual' END, CASE WHEN a.family <> b.family THEN 'other_family' END,
  CASE WHEN a.rewording_type = b.rewording_type THEN 'same_type' END, CASE WHEN b.place IS NOT NULL AND NOT coalesce((a.lane = 'open' AND b.lane = 'guard') OR (a.lane = 'guard' AND b.lane = 'open'), false) THEN 'lanes_not_crossed' END) AS broken
FROM protocols a LEFT JOIN protocols b ON b.place = a.twin WHERE a.twin IS NOT NULL"""))
def op_twin_rules(spark: SparkSession, folder: str) -> DataFrame:
    return P.twin_rules(protocols(spark, folder)).withColumn("broken", F.array_join("broken", ","))


_CURRENT = ", c AS (SELECT * EXCLUDE r FROM (SELECT *, regexp_extract(protocol_id, '^(.+)__v(\\d+)$', 1) AS prefix, row_number() OVER (PARTITION BY regexp_extract(protocol_id, '^(.+)__v(\\d+)$', 1) ORDER BY CAST(regexp_extract(protocol_id, '^(.+)__v(\\d+)$', 2) AS INTEGER) DESC, place) AS r FROM protocols WHERE status = 'admitted') WHERE r = 1)"


@query(with_views("protocols", _CURRENT + " SELECT place, prefix, protocol_id FROM c"))
def op_current_protocols(spark: SparkSession, folder: str) -> DataFrame:
    return P.current(protocols(spark, folder)).select("place", "prefix", "protocol_id")


@query(with_views("protocols", " SELECT family, rewording_type, arg_min(protocol_id, (protocol_id, place)) AS protocol_id, CAST(arg_min(n, (protocol_id, place)) AS BIGINT) * 4 AS calls FROM protocols WHERE status = 'admitted' GROUP BY ALL"))
def op_bridge_plan(spark: SparkSession, folder: str) -> DataFrame:
    return P.first_of_type(protocols(spark, folder).where("status = 'admitted'"), ["family"])


@query(with_views("protocols history", _CURRENT + """, g AS (SELECT protocol_id, row_number() OVER (ORDER BY protocol_id, place) - 1 AS turn FROM c WHERE lane = 'guard'), d AS (SELECT DISTINCT run_date AS day FROM history)
SELECT CAST(day AS VARCHAR) AS day, protocol_id FROM d JOIN g ON g.turn = ((date_diff('day', DATE '2026-01-01', day) % (SELECT count(*) FROM g)) + (SELECT count(*) FROM g)) % (SELECT count(*) FROM g)"""))
def op_guard_rotation(spark: SparkSession, folder: str) -> DataFrame:
    guards = P.current(protocols(spark, folder)).where("lane = 'guard'")
    days = history(spark, folder).select(F.col("run_date").alias("day")).distinct()
    return P.rotation(days, guards).withColumn("day", F.col("day").cast("string"))


_MANIFESTS = ", m AS (SELECT DISTINCT 'x' || l_partkey AS id, sha256('panel' || (l_partkey % 300)) AS panel, sha256('protocol' || l_partkey) AS protocol FROM lineitem WHERE l_returnflag = 'N' AND l_linenumber > 5)"


@query(with_views("protocols", _MANIFESTS + " SELECT place, protocol_id FROM protocols p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.panel = p.panel_sha256 AND m.protocol = p.protocol_sha256)"))
def op_prereg_anti(spark: SparkSession, folder: str) -> DataFrame:
    p = protocols(spark, folder)
    k = F.col("l_partkey")
    stamped = table(spark, folder, "lineitem").where("l_returnflag = 'N' and l_linenumber > 5").select(k.alias("place"), F.sha2(F.concat(F.lit("panel"), (k % 300).cast("string")), 256).alias("panel_sha256"), F.sha2(F.concat(F.lit("protocol"), k.cast("string")), 256).alias("protocol_sha256"))
    manifests = stamped.join(p.select("place", "protocol_id"), "place").drop("place")
    return P.not_preregistered(p, manifests).select("place", "protocol_id")


@query(with_views("protocols history", _CURRENT + """, l AS (SELECT place, twin FROM protocols WHERE twin IS NOT NULL UNION ALL SELECT twin, place FROM protocols WHERE twin IS NOT NULL),
s AS (SELECT place, panel_sha256 AS panel FROM protocols UNION SELECT l.place, p.panel_sha256 FROM l JOIN protocols p ON p.place = l.twin),
h AS (SELECT s.place, count(DISTINCT c.place) AS sharing FROM s JOIN c ON c.panel_sha256 = s.panel AND c.place <> s.place GROUP BY s.place),
u AS (SELECT DISTINCT p.place, p.panel_sha256 AS panel, m.model_id, m.run_date AS day FROM protocols p JOIN history m ON CAST(substr(m.protocol_id, 2) AS INTEGER) = p.place % 97 AND m.on_curve AND m.series = 'commercial'),
o AS (SELECT DISTINCT panel, model_id, day FROM u),
b AS (SELECT DISTINCT p.place FROM protocols p JOIN c n ON n.prefix = regexp_extract(p.protocol_id, '^(.+)__v(\\d+)$', 1) AND n.place <> p.place JOIN o ON o.panel = p.panel_sha256 JOIN u ON u.place = n.place AND u.model_id = o.model_id AND abs(date_diff('day', o.day, u.day)) <= 7)
SELECT p.place, concat_ws(',', CASE WHEN p.status <> 'admitted' THEN 'not_admitted' END, CASE WHEN p.status = 'admitted' AND k.place IS NOT NULL THEN 'still_current' END, CASE WHEN p.status = 'admitted' AND h.sharing IS NOT NULL THEN 'panel_in_use' END,
  CASE WHEN p.status = 'admitted' AND (n.place IS NULL OR n.place = p.place) THEN 'no_successor' END, CASE WHEN p.status = 'admitted' AND n.place <> p.place AND p.place NOT IN (SELECT place FROM b) THEN 'no_bridge' END) AS broken, coalesce(h.sharing, 0) AS sharing
FROM protocols p LEFT JOIN c k ON k.place = p.place LEFT JOIN h ON h.place = p.place LEFT JOIN c n ON n.prefix = regexp_extract(p.protocol_id, '^(.+)__v(\\d+)$', 1)"""))
def op_declassification(spark: SparkSession, folder: str) -> DataFrame:
    p = protocols(spark, folder)
    measured = history(spark, folder).where("on_curve and series = 'commercial'").select(F.substr("protocol_id", F.lit(2)).cast("long").alias("line"), "model_id", F.col("run_date").alias("day"))
    return P.declassification(p, measured, F.col("place") % 97).withColumn("broken", F.array_join("broken", ","))


@query(with_views("protocols history", _CURRENT + """, m AS (SELECT DISTINCT CAST(substr(protocol_id, 2) AS INTEGER) AS k, model_id FROM history WHERE series = 'commercial'), d AS (SELECT DISTINCT model_id FROM m)
SELECT d.model_id, count(*) AS total, count(m.k) AS measured FROM c CROSS JOIN d LEFT JOIN m ON m.k = c.place % 97 AND m.model_id = d.model_id GROUP BY d.model_id"""))
def op_round_progress(spark: SparkSession, folder: str) -> DataFrame:
    now = P.current(protocols(spark, folder)).select((F.col("place") % 97).alias("k"))
    wanted = now.groupBy("k").agg(F.count("*").alias("wanted"))
    total = now.count()
    done = history(spark, folder).where("series = 'commercial'").select(F.substr("protocol_id", F.lit(2)).cast("long").alias("k"), "model_id").distinct()
    rows = done.join(wanted, "k", "left").groupBy("model_id").agg(F.coalesce(F.sum("wanted"), F.lit(0)).alias("measured"))
    return rows.select("model_id", F.lit(total).cast("long").alias("total"), "measured")


def scenarios(spark: SparkSession, folder: str) -> DataFrame:
    """Three declared decision problems for each part, some of them broken."""
    p = table(spark, folder, "part").select(F.col("p_partkey").alias("place"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("scenario"))
    k = F.col("place") * 3 + F.col("scenario")
    base = 10 + k % 7
    out = lambda num, den, value: F.struct(F.lit(num).cast("long").alias("num"), F.lit(den).cast("long").alias("den"), (value if not isinstance(value, int) else F.lit(value)).cast("long").alias("value"))
    risky, sure = F.array(out(1, 2, base * 2), out(1, 2, 0)), F.array(out(1, 1, base))
    a = F.array(risky, sure)
    a_prime = F.when(k % 11 == 0, F.array(risky, F.array(out(1, 1, base + 1)))).otherwise(F.array(F.array(out(1, 2, 0), out(1, 2, base * 2)), sure))
    b = F.when(k % 13 == 0, F.array(F.array(out(1, 2, base * 2), out(1, 3, 0)), sure)).otherwise(a)
    c = F.when(k % 17 == 0, F.array(F.array(out(1, 1, base * 9)), F.array(out(1, 1, base)))).otherwise(F.array(F.array(out(1, 2, 1), out(1, 2, 2)), F.array(out(1, 1, base))))
    a = F.when(k % 19 == 0, F.array(F.array(out(1, 2, base * 2 + 1), out(1, 2, 0)), sure)).otherwise(a)
    one, two = F.lit(1), F.lit(2)
    return p.select("place", "scenario", a.alias("lots_A"), a_prime.alias("lots_A_prime"), b.alias("lots_B"), c.alias("lots_C"), one.alias("right_A"), one.alias("right_A_prime"), F.when(k % 23 == 0, two).otherwise(one).alias("right_B"), F.when(k % 29 == 0, one).otherwise(two).alias("right_C"))


def _structure_sql() -> str:
    """The rules over the lotteries themselves; masses and worths in sixths."""
    o = lambda num, den, value: f"{{'num': {num}, 'den': {den}, 'value': CAST({value} AS BIGINT)}}"
    risky, sure = f"[{o(1, 2, 'base * 2')}, {o(1, 2, 0)}]", f"[{o(1, 1, 'base')}]"
    mass = "list_sum(list_transform(lot, lambda o: o.num * 6 // o.den))"
    worth = "list_sum(list_transform(lot, lambda o: o.num * o.value * 6 // o.den))"
    ordered = lambda v: f"list_transform({v}, lambda lot: list_sort(lot))"
    return f""" WITH s AS (SELECT p_partkey AS place, j AS scenario, p_partkey * 3 + j AS k, 10 + (p_partkey * 3 + j) % 7 AS base FROM part CROSS JOIN (SELECT unnest([0, 1, 2]) AS j)),
d AS (SELECT place, CAST(scenario AS INTEGER) AS scenario, CASE WHEN k % 19 = 0 THEN [[{o(1, 2, 'base * 2 + 1')}, {o(1, 2, 0)}], {sure}] ELSE [{risky}, {sure}] END AS a,
  CASE WHEN k % 11 = 0 THEN [{risky}, [{o(1, 1, 'base + 1')}]] ELSE [[{o(1, 2, 0)}, {o(1, 2, 'base * 2')}], {sure}] END AS p,
  CASE WHEN k % 13 = 0 THEN [[{o(1, 2, 'base * 2')}, {o(1, 3, 0)}], {sure}] ELSE [{risky}, {sure}] END AS b,
  CASE WHEN k % 17 = 0 THEN [[{o(1, 1, 'base * 9')}], [{o(1, 1, 'base')}]] ELSE [[{o(1, 2, 1)}, {o(1, 2, 2)}], [{o(1, 1, 'base')}]] END AS c,
  1 AS ra, 1 AS rp, CASE WHEN k % 23 = 0 THEN 2 ELSE 1 END AS rb, CASE WHEN k % 29 = 0 THEN 1 ELSE 2 END AS rc FROM s),
m AS (SELECT *, len(list_filter(flatten([a, p, b, c]), lambda lot: {mass} <> 6)) > 0 AS off, list_min(list_transform(c[rc], lambda o: o.value)) AS least, list_max(list_transform(c[3 - rc], lambda o: o.value)) AS best_other,
  len(list_distinct(list_transform(a, lambda lot: {worth}))) > 1 AS uneven FROM d)
SELECT place, scenario, CASE WHEN off THEN 'mass_not_one' ELSE concat_ws(',', CASE WHEN {ordered('p')} <> {ordered('a')} THEN 'a_prime_differs' END, CASE WHEN {ordered('b')} <> {ordered('a')} THEN 'b_differs' END, CASE WHEN rp <> ra OR rb <> ra THEN 'answer_moved' END,
  CASE WHEN uneven THEN 'uneven_values' END, CASE WHEN rc = ra THEN 'answer_kept_in_c' END, CASE WHEN rc <> ra AND best_other >= least THEN 'no_dominance_in_c' END) END AS broken FROM m"""


@query(_structure_sql())
def op_structure_rules(spark: SparkSession, folder: str) -> DataFrame:
    return P.structure_rules(scenarios(spark, folder)).withColumn("broken", F.array_join("broken", ","))


# Pairs of texts that keep or break each rule; {k} is the part's number.
_REWORDINGS = [
    ("wording", "risky_choice_framing", "Case {k}.\nPlan A: keep 40 of 90.\nPlan B: a chance.", "Case {k}.\nPlan A: lose 50 of 90.\nPlan B: a chance."),
    ("wording", "risky_choice_framing", "Case {k}.\nPlan A: keep 40 of 90.\nPlan B: a chance.", "Item {k}.\nPlan A: lose 50 of 90.\nPlan B: a chance."),
    ("wording", "risky_choice_framing", "Case {k}.\nPlan A: keep 40 of 90.", "Case {k}.\nPlan A: keep 40 of 90."),
    ("wording", "risky_choice_framing", "Case {k}.\nPlan A: keep 40 of 90.", "Case {k}.\nPlan A: keep 40 of 90.\nPlan B: none."),
    ("wording", "sunk_cost_fallacy", "So far, €{k} has been spent.\nOption A: stop and save.\nOption B: go on.", "So far, €{k} has been spent.\nOption A: stop, giving up the €{k} already spent, and save.\nOption B: go on."),
    ("wording", "sunk_cost_fallacy", "So far, €{k} has been spent.\nOption A: stop and save.\nOption B: go on.", "So far, €{k} has been spent.\nOption A: stop, giving up the €9{k} already spent, and save.\nOption B: go on."),
    ("wording", "sunk_cost_fallacy", "So far {k} was spent.\nOption A: stop.", "So far {k} was spent.\nOption A: halt."),
    ("wording", "sunk_cost_fallacy", "So far, €{k} has been spent.\nOption A: stop.\nOption B: go.", "So far, €{k} has been spent.\nOption A: halt.\nOption B: run."),
    ("wording", "base_rate_neglect", "Test {k}.\n2% of the parts are faulty. It wrongly flags 50% of the rest.\nOption A: x", "Test {k}.\nOut of every 1,000 parts, 20 are faulty. It wrongly flags 490 of the rest.\nOption A: x"),
    ("wording", "base_rate_neglect", "Test {k}.\n2% of the parts are faulty. It wrongly flags 50% of the rest.\nOption A: x", "Test {k}.\nOut of every 1,000 parts, 20 are faulty. It wrongly flags 500 of the rest.\nOption A: x"),
    ("wording", "base_rate_neglect", "Test {k}.\n2% of the parts are faulty. It wrongly flags 50% of the rest.\nOption A: x", "Trial {k}.\nOut of every 1,000 parts, 20 are faulty. It wrongly flags many.\nOption A: y"),
    ("wording", "base_rate_neglect", "Test {k}.\nOption A: x", "Test {k}.\nOption A: x"),
    ("wording", "mental_accounting", "Test {k}.", "Trial {k}."),
    ("order", "any", "Case {k}.\nPlan A: one.\nPlan B: two.", "Case {k}.\nPlan B: two.\nPlan A: one."),
    ("order", "any", "Case {k}.\nPlan A: one.\nPlan B: two.", "Case {k}.\nPlan A: one.\nPlan B: two."),
    ("order", "any", "Case {k}.\nPlan A: one.\nPlan B: two.", "Case {k}.\nPlan B: three.\nPlan A: one."),
    ("order", "any", "Case {k}.\nNote.\nPlan A: one.\nPlan B: two.", "Note.\nCase {k}.\nPlan B: two.\nPlan A: one."),
    ("default", "any", "Case {k}.\nPlan A is chosen by default.\nPlan A: x.", "Case {k}.\nPlan B is chosen by default.\nPlan A: x."),
    ("default", "any", "Case {k}.\nPlan A is chosen by default.\nPlan A: x.", "Case {k}.\nPlan B is picked by default.\nPlan A: x."),
    ("default", "any", "Case {k}.\nPlan A is chosen by default.\nPlan A: x.", "Case {k}.\nPlan A is picked by default.\nPlan A: x."),
    ("default", "any", "Case {k}.\nPlan A is chosen.\nPlan A: x.", "Case {k}.\nPlan B is chosen.\nPlan A: x."),
    ("default", "any", "Case {k}.\nPlan A is chosen by default.", "Case {k}.\nPlan A is chosen by default."),
    ("anchoring", "any", "Someone said 5{k}, then left. Cost: 31 (about).", "Someone said 9{k}, then left. Cost: 31 (about)."),
    ("anchoring", "any", "Someone said 5{k}, then left. Cost: 31 (about).", "Someone said many, then left. Cost: 31 (about)."),
    ("anchoring", "any", "Someone said 500, then left. Cost {k}: (31%).", "Someone said 31, then left. Cost {k}: (31%)."),
    ("anchoring", "any", "Someone said 5{k} and left.", "Someone said 9{k} and went."),
    ("framing", "any", "Case {k}.", "Item {k}."),
]


def _rules_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    values = ", ".join(f"({i}, '{kind}', '{family}', {quoted(a)}, {quoted(b)})" for i, (kind, family, a, b) in enumerate(_REWORDINGS))
    option = "'^(Plan|Option) [AB]:'"
    return f""" WITH v(i, kind, family, a, b) AS (VALUES {values}),
t AS (SELECT p_partkey AS place, kind, family, replace(a, '{{k}}', CAST(p_partkey AS VARCHAR)) AS a, replace(b, '{{k}}', CAST(p_partkey AS VARCHAR)) AS b FROM part JOIN v ON v.i = p_partkey % {len(_REWORDINGS)}),
l AS (SELECT *, string_split(a, chr(10)) AS la, string_split(b, chr(10)) AS lb, string_split_regex(a, '\\s+') AS ta, string_split_regex(b, '\\s+') AS tb FROM t),
d AS (SELECT *, list_filter(range(1, len(la) + 1), lambda i: la[i] IS DISTINCT FROM lb[i]) AS dl, list_filter(range(1, len(ta) + 1), lambda i: ta[i] IS DISTINCT FROM tb[i]) AS dt,
  list_filter(la, lambda x: regexp_matches(x, {option})) AS oa, list_filter(lb, lambda x: regexp_matches(x, {option})) AS ob, list_filter(la, lambda x: NOT regexp_matches(x, {option})) AS ra, list_filter(lb, lambda x: NOT regexp_matches(x, {option})) AS rb FROM l),
s AS (SELECT *, len(la) = len(lb) AND len(dl) = 1 AS single, la[dl[1]] AS x, lb[dl[1]] AS y, len(ta) = len(tb) AND len(dt) = 1 AS one, rtrim(ta[dt[1]], '.,;') AS p, rtrim(tb[dt[1]], '.,;') AS q,
  list_transform(list_filter(ta, lambda w: w <> ta[dt[1]]), lambda w: trim(w, '.,;:€%()')) AS rest, regexp_extract(a, 'So far, €(\\d[\\d,]*) has been spent', 1) AS spent,
  try_cast(regexp_extract(a, '(\\d+)% of the .* are \\w+', 1) AS BIGINT) AS r1, try_cast(regexp_extract(a, 'wrongly flags (\\d+)%', 1) AS BIGINT) AS r2,
  try_cast(regexp_extract(b, 'Out of every 1,000 .*?, (\\d+) are ', 1) AS BIGINT) AS r3, try_cast(regexp_extract(b, 'wrongly flags (\\d+)', 1) AS BIGINT) AS r4 FROM d),
z AS (SELECT *, regexp_extract(x, '(Plan|Option) ([AB])\\b', 2) AS lx, regexp_extract(y, '(Plan|Option) ([AB])\\b', 2) AS ly, r1 IS NOT NULL AND r2 IS NOT NULL AND r3 IS NOT NULL AND r4 IS NOT NULL AS known FROM s)
SELECT place, CASE
  WHEN kind = 'order' THEN concat_ws(',', CASE WHEN ra <> rb THEN 'other_lines_changed' END, CASE WHEN list_sort(oa) <> list_sort(ob) THEN 'options_changed' END, CASE WHEN oa = ob THEN 'options_not_moved' END)
  WHEN kind = 'default' THEN concat_ws(',', CASE WHEN NOT single THEN 'not_one_line' END, CASE WHEN single AND NOT (contains(x, 'by default') AND contains(y, 'by default')) THEN 'no_default_sentence' END,
    CASE WHEN single AND (lx = '' OR ly = '' OR lx = ly) THEN 'not_switched' END, CASE WHEN single AND regexp_replace(x, '(Plan|Option) ([AB])\\b', '#', 'g') <> regexp_replace(y, '(Plan|Option) ([AB])\\b', '#', 'g') THEN 'more_than_the_letter' END)
  WHEN kind = 'anchoring' THEN concat_ws(',', CASE WHEN NOT one THEN 'not_one_token' END, CASE WHEN one AND NOT (regexp_full_match(p, '\\d[\\d,]*') AND regexp_full_match(q, '\\d[\\d,]*')) THEN 'not_a_number' END, CASE WHEN one AND (list_contains(rest, p) OR list_contains(rest, q)) THEN 'anchor_repeated' END)
  WHEN kind = 'wording' AND family = 'risky_choice_framing' THEN concat_ws(',', CASE WHEN la = lb THEN 'unchanged' END, CASE WHEN len(la) <> len(lb) THEN 'line_count' END, CASE WHEN len(la) = len(lb) AND len(list_filter(dl, lambda i: NOT regexp_matches(la[i], {option}))) > 0 THEN 'other_line_changed' END)
  WHEN kind = 'wording' AND family = 'sunk_cost_fallacy' THEN concat_ws(',', CASE WHEN NOT single THEN 'not_one_line' END, CASE WHEN spent = '' THEN 'no_amount' END, CASE WHEN single AND spent <> '' AND replace(y, ', giving up the €' || spent || ' already spent,', '') <> x THEN 'not_the_phrase' END)
  WHEN kind = 'wording' AND family = 'base_rate_neglect' THEN concat_ws(',', CASE WHEN a = b THEN 'unchanged' END, CASE WHEN oa <> ob THEN 'options_changed' END, CASE WHEN NOT known THEN 'no_rates' END, CASE WHEN known AND (r3 <> r1 * 10 OR r4 * 100 <> r2 * (1000 - r3)) THEN 'rates_differ' END, CASE WHEN la[1] <> lb[1] THEN 'opening_changed' END)
  ELSE 'no_rule' END AS broken FROM z"""


@query(_rules_sql())
def op_conformance(spark: SparkSession, folder: str) -> DataFrame:
    cases = spark.createDataFrame([(i, *case) for i, case in enumerate(_REWORDINGS)], "i int, kind string, family string, a string, b string")
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("place"), (F.col("p_partkey") % len(_REWORDINGS)).cast("int").alias("i"))
    filled = lambda c: F.replace(F.col(c), F.lit("{k}"), F.col("place").cast("string"))
    broken = rewording.broken_rules(F.col("kind"), F.col("family"), filled("a"), filled("b"))
    return parts.join(F.broadcast(cases), "i").select("place", F.array_join(broken, ",").alias("broken"))


_VERSIONS = ("A", "A_prime", "B", "C")


def declared_protocols(spark: SparkSession, folder: str) -> DataFrame:
    """A protocol for each part, of three scenarios, most of them sound; hashes are right before the flaws are put in."""
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("place"), F.col("p_name").alias("name"), F.col("p_size").cast("long").alias("size"))
    k = F.col("place")

    def scenario(i: int):
        text = F.concat(F.lit(f"Case {i}: "), F.col("name"), F.lit(". Plan A or Plan B?"))
        prime = F.when(k % 37 == i, F.concat(text, F.lit(" Now."))).when(k % 41 == i, text).otherwise(F.concat(F.replace(text, F.lit(". "), F.lit(" -\n")), F.lit("!")))
        texts = {"A": text, "A_prime": prime, "B": F.upper(text), "C": F.when(k % 43 == i, F.lit(" \n")).otherwise(F.reverse(text))}
        broken = F.when(k % 47 == i, F.lit(None).cast("array<string>")).when(k % 53 == i, F.array(F.lit("uneven_values"))).otherwise(F.array().cast("array<string>"))
        options = F.when(k % 59 == i, F.array(F.lit("A"), F.lit("C"))).otherwise(F.col("options"))
        name = F.when(k % 61 == i, F.lit("s0")).otherwise(F.lit(f"s{i}"))
        versions = F.when(k % 67 == i, F.lit(None)).otherwise(F.struct(*(texts[v].alias(v) for v in _VERSIONS)))
        return F.struct(name.alias("scenario_id"), options.alias("options"), versions.alias("versions"), broken.alias("broken"))

    rows = parts.withColumn("options", F.when(k % 71 == 3, F.array(F.lit("A"), F.lit("*a*."))).when(k % 71 == 4, F.array(F.lit("STRASSE"), F.lit("Straße"))).when(k % 71 == 5, F.array(F.lit("é"), F.lit("E\u0301"))).when(k % 71 == 6, F.array(F.lit("ß"), F.lit("s"))).otherwise(F.array(F.lit("A"), F.lit("B"))))
    rows = rows.withColumns({
        "protocol_id": F.concat(F.lit("p"), k.cast("string")), "family": F.concat(F.lit("family_"), F.col("size").cast("string")),
        "rewording_type": F.when(k % 73 == 5, "tone").when(k % 2 == 0, "order").otherwise("wording"), "status": F.when(k % 9 == 0, "candidate").otherwise("admitted"),
        "lane": F.when((k % 9 != 0) | (k % 27 == 0), F.when(k % 2 == 0, "open").when(k % 79 == 5, "hidden").otherwise("guard")), "twin_id": F.when(k % 5 != 0, F.concat(F.lit("p"), (k + k % 7).cast("string"))),
        "n": (F.col("size") * F.when(k % 83 == 7, 4).otherwise(3)).cast("long"), "n_per_scenario": F.col("size"), "effort": F.when(k % 89 == 2, "high").otherwise("disabled"), "grammar_version": (k % 31 % 3 + 1).cast("long"),
        "prompt_template": F.when(k % 97 == 4, "Read this.").when(k % 101 == 4, F.lit(None)).otherwise('Read "this": {scenario}'), "theta_positive_pct": F.when(k % 13 != 9, 10).cast("long"), "scenario_dominated_share_pct": F.when(k % 11 != 8, 50.5),
        "scenarios": F.array(*map(scenario, range(3))),
    })
    panel = admission.panel_sha256(F.col("scenarios"))
    rows = rows.withColumn("panel_sha256", F.when(k % 103 == 6, F.sha2(F.lit("other"), 256)).otherwise(panel))
    return rows.withColumn("protocol_sha256", F.when(k % 107 == 8, F.lit("0")).otherwise(admission.protocol_sha256(rows.schema)))


def _admission_sql() -> str:
    def scenario(i: int) -> str:
        text = f"'Case {i}: ' || name || '. Plan A or Plan B?'"
        prime = f"CASE WHEN k % 37 = {i} THEN {text} || ' Now.' WHEN k % 41 = {i} THEN {text} ELSE replace({text}, '. ', ' -' || chr(10)) || '!' END"
        versions = f"CASE WHEN k % 67 = {i} THEN NULL ELSE {{'A': {text}, 'A_prime': {prime}, 'B': upper({text}), 'C': CASE WHEN k % 43 = {i} THEN ' ' || chr(10) ELSE reverse({text}) END}} END"
        name = f"CASE WHEN k % 61 = {i} THEN 's0' ELSE 's{i}' END"
        options = f"CASE WHEN k % 59 = {i} THEN ['A', 'C'] ELSE options END"
        broken = f"CASE WHEN k % 47 = {i} THEN NULL WHEN k % 53 = {i} THEN ['uneven_values'] ELSE [] END"
        return f"{{'options': {options}, 'scenario_id': {name}, 'versions': {versions}, 'broken': {broken}}}"

    skeleton = lambda x: f"regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
    whole = "s.versions IS NOT NULL"
    tests = {
        "other_options": "s.options <> options", "versions_missing": f"NOT ({whole})",
        "empty_version": f"{whole} AND len(list_filter([s.versions.A, s.versions.A_prime, s.versions.B, s.versions.C], lambda t: trim(t, ' ' || chr(10)) = '')) > 0",
        "null_change_too_large": f"{whole} AND {skeleton('s.versions.A')} <> {skeleton('s.versions.A_prime')}", "null_change_missing": f"{whole} AND s.versions.A = s.versions.A_prime", "no_structure": f"{whole} AND s.broken IS NULL",
    }
    faults = ", ".join(f"list_transform(list_filter(scenarios, lambda s: {test}), lambda s: '{name}:' || s.scenario_id)" for name, test in tests.items())
    rules = {
        "unknown_type": "rewording_type NOT IN ('wording', 'order', 'default', 'anchoring')", "unknown_lane": "lane NOT IN ('open', 'guard', 'sealed')", "candidate_has_lane": "status = 'candidate' AND lane IS NOT NULL",
        "candidate_has_twin": "status = 'candidate' AND twin_id IS NOT NULL", "open_without_twin": "status = 'admitted' AND lane = 'open' AND twin_id IS NULL", "own_twin": "twin_id = protocol_id", "unknown_grammar": "grammar_version NOT IN (1, 2)",
        "effort_not_disabled": "effort <> 'disabled'", "no_placeholder": "NOT contains(prompt_template, '{scenario}')", "options_collide": "len(list_distinct(list_transform(options, lambda o: rtrim(replace(lower(nfc_normalize(replace(o, '*', ''))), 'ß', 'ss'), '.')))) <> len(options)",
        "duplicate_scenario": "len(list_distinct(list_transform(scenarios, lambda s: s.scenario_id))) <> len(scenarios)", "wrong_n": "n <> n_per_scenario * len(scenarios)", "panel_hash": "panel_sha256 <> panel", "protocol_hash": "protocol_sha256 <> protocol",
    }
    broken = ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in rules.items())
    return f""" WITH r AS (SELECT p_partkey AS k, p_name AS name, CAST(p_size AS BIGINT) AS size, CASE p_partkey % 71 WHEN 3 THEN ['A', '*a*.'] WHEN 4 THEN ['STRASSE', 'Straße'] WHEN 5 THEN ['é', 'E\u0301'] WHEN 6 THEN ['ß', 's'] ELSE ['A', 'B'] END AS options FROM part),
q AS (SELECT *, 'p' || k AS protocol_id, 'family_' || size AS family, CASE WHEN k % 73 = 5 THEN 'tone' WHEN k % 2 = 0 THEN 'order' ELSE 'wording' END AS rewording_type, CASE WHEN k % 9 = 0 THEN 'candidate' ELSE 'admitted' END AS status,
  CASE WHEN k % 9 <> 0 OR k % 27 = 0 THEN CASE WHEN k % 2 = 0 THEN 'open' WHEN k % 79 = 5 THEN 'hidden' ELSE 'guard' END END AS lane, CASE WHEN k % 5 <> 0 THEN 'p' || (k + k % 7) END AS twin_id,
  size * CASE WHEN k % 83 = 7 THEN 4 ELSE 3 END AS n, size AS n_per_scenario, CASE WHEN k % 89 = 2 THEN 'high' ELSE 'disabled' END AS effort, k % 31 % 3 + 1 AS grammar_version,
  CASE WHEN k % 97 = 4 THEN 'Read this.' WHEN k % 101 = 4 THEN NULL ELSE 'Read "this": {{scenario}}' END AS prompt_template, [{", ".join(map(scenario, range(3)))}] AS scenarios FROM r),
h AS (SELECT *, sha256(to_json(list_transform(scenarios, lambda s: {{'options': s.options, 'scenario_id': s.scenario_id, 'versions': s.versions}}))) AS panel FROM q),
g AS (SELECT *, CASE WHEN k % 103 = 6 THEN sha256('other') ELSE panel END AS panel_sha256 FROM h),
j AS (SELECT *, sha256(to_json({{'effort': effort, 'family': family, 'grammar_version': grammar_version, 'n': n, 'n_per_scenario': n_per_scenario, 'options': options, 'panel_sha256': panel_sha256, 'prompt_template': prompt_template, 'rewording_type': rewording_type, 'scenario_dominated_share_pct': CASE WHEN k % 11 <> 8 THEN 50.5::DOUBLE END, 'theta_positive_pct': CASE WHEN k % 13 <> 9 THEN 10 END}})) AS protocol FROM g),
f AS (SELECT *, CASE WHEN k % 107 = 8 THEN '0' ELSE protocol END AS protocol_sha256 FROM j)
SELECT k AS place, CASE WHEN prompt_template IS NULL THEN 'missing prompt_template' ELSE concat_ws(',', {broken}) END AS broken,
  CASE WHEN prompt_template IS NULL THEN '' ELSE array_to_string(list_sort(flatten([{faults}, flatten(list_transform(scenarios, lambda s: list_transform(coalesce(s.broken, []), lambda b: b || ':' || s.scenario_id)))])), ',') END AS scenario_faults FROM f"""


@query(_admission_sql())
def op_admission(spark: SparkSession, folder: str) -> DataFrame:
    found = admission.broken_rules(declared_protocols(spark, folder))
    return found.select("place", F.array_join("broken", ",").alias("broken"), F.array_join("scenario_faults", ",").alias("scenario_faults"))


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    """run_id, cx, cy, seed of every run of the trials."""
    rows = counts.tally(trials(spark, folder), ["run_id"])
    return rows.select("run_id", F.col("c_A").alias("cx"), F.col("c_B").alias("cy"), S.seed(F.col("run_id"), F.lit("2026-01-31"), F.lit("model")).alias("seed"))


_MIX = "xor({z}, {z} >> 31)"


@query(with_views("trials", """, c AS (SELECT run_id, count(*) FILTER (WHERE version = 'A' AND token = 'A') AS xa, count(*) FILTER (WHERE version = 'A' AND token = 'B') AS xb,
  count(*) FILTER (WHERE version = 'B' AND token = 'A') AS ya, count(*) FILTER (WHERE version = 'B' AND token = 'B') AS yb FROM trials GROUP BY run_id),
s AS (SELECT *, CAST('0x' || substr(sha256(run_id || '‖2026-01-31‖model'), 1, 16) AS UBIGINT)::UHUGEINT AS seed, xa + xb AS nx, ya + yb AS ny FROM c),
d AS (SELECT run_id, xa, ya, nx, ny, seed, b, k FROM s, LATERAL (SELECT unnest(range(0, 10000)) AS b), LATERAL (SELECT unnest(range(0, s.nx + s.ny)) AS k)),
z0 AS (SELECT *, (seed + (b * (nx + ny) + k + 1)::UHUGEINT * 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT AS z FROM d),
z1 AS (SELECT * REPLACE ((xor(z, z >> 30) * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT AS z) FROM z0),
z2 AS (SELECT * REPLACE ((xor(z, z >> 27) * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT AS z) FROM z1),
z3 AS (SELECT * REPLACE (xor(z, z >> 31) AS z) FROM z2),
g AS (SELECT run_id, b, any_value(nx) AS nx, any_value(ny) AS ny, count(*) FILTER (WHERE k < nx AND z % nx::UHUGEINT < xa::UHUGEINT) AS sa, count(*) FILTER (WHERE k >= nx AND z % ny::UHUGEINT < ya::UHUGEINT) AS ta FROM z3 GROUP BY run_id, b),
n AS (SELECT run_id, 2 * nx * ny AS den, abs(sa * ny - ta * nx) + abs((nx - sa) * ny - (ny - ta) * nx) AS num FROM g)
SELECT run_id, CAST(quantile_disc(num, 0.025) AS BIGINT) AS low_num, CAST(quantile_disc(num, 0.975) AS BIGINT) AS high_num, CAST(any_value(den) AS BIGINT) AS den FROM n GROUP BY run_id"""))
def op_bootstrap_ci(spark: SparkSession, folder: str) -> DataFrame:
    return R.bootstrap(_runs(spark, folder))


@query()
def op_null_floor(spark: SparkSession, folder: str) -> DataFrame:
    found = R.null_floor(_runs(spark, folder), after_bootstrap=R.ITERATIONS)
    return found.select("run_id", published(F.col("floor_num") * 100, F.col("floor_den")).alias("null_floor_pct"))


@query()
def op_call_order(spark: SparkSession, folder: str) -> DataFrame:
    p = P.current(protocols(spark, folder))
    return R.call_orders(p.select("protocol_id", (F.col("n") * 4).alias("n_calls"), S.seed(F.col("protocol_id"), F.lit("2026-01-31"), F.lit("model"), F.lit("order")).alias("seed")))
