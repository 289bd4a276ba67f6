"""The pipeline's stages, each against a plain version on its own input."""

import pytest

import corpus_pipeline as pipeline
from evenkeel.llm import mixing, quality_rules, sharding
from evenkeel.sources.tables import materialize, table
from tests.llm.test_operators import DOC, brute_classes, brute_leaks, brute_statistics, made_docs


@pytest.fixture(scope="module")
def steps(spark, data):
    docs, out = table(spark, data, "documents"), []
    for name, stage in pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, data), "step")
        out.append((name, before, docs))
    return out


def test_order_and_columns(spark, data, steps):
    assert [name for name, *_ in steps] == ["quality rules", "near-duplicates", "benchmark decontamination", "mixing to target weights", "sharding"]
    columns = table(spark, data, "documents").columns
    assert all(after.columns == columns for _, _, after in steps[:-1])
    sizes = [before.count() for _, before, _ in steps] + [steps[-1][2].count()]
    assert sizes == sorted(sizes, reverse=True) and 0 < sizes[-1] < sizes[0]


def test_quality_keeps_what_the_rules_keep(spark, data, steps):
    _, before, after = steps[0]
    stats = quality_rules.statistics(before, ["doc_id"])
    rules = quality_rules.fit(stats, table(spark, data, "labels"))
    assert {r.doc_id for r in quality_rules.judge(stats, rules).where("kept").collect()} == {r.doc_id for r in after.collect()}
    for r in after.collect():
        s = brute_statistics(r.text)
        assert s[0] >= 50 and 100 * s[4] <= 50 * s[0]


def test_one_document_of_each_class_stays(steps):
    _, before, after = steps[1]
    want, _ = brute_classes([(r.doc_id, r.text) for r in before.collect()])
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(want.values()))


def test_no_benchmark_window_is_left(spark, data, steps):
    _, before, after = steps[2]
    items = [(r.item_id, r.text) for r in table(spark, data, "benchmark").collect()]
    hit = {doc_id for doc_id, _, n, _ in brute_leaks([(r.doc_id, r.text) for r in before.collect()], items) if n}
    assert {r.doc_id for r in before.collect()} - hit == {r.doc_id for r in after.collect()}


def test_mixing_draws_by_probability(steps):
    _, before, after = steps[3]
    assert {r.doc_id for r in mixing.weigh(before).where("kept").collect()} == {r.doc_id for r in after.collect()}


def test_sharding_keeps_every_row(steps):
    _, before, after = steps[4]
    assert after.count() == before.count() and after.agg({"n_bytes": "max"}).first()[0] <= sharding.LIMIT


def test_run_is_its_stages(spark, data, steps):
    whole = pipeline.run(spark, data)
    assert sorted(map(tuple, whole.select("doc_id", "shard").collect())) == sorted(map(tuple, steps[-1][2].select("doc_id", "shard").collect()))


def test_empty_and_odd_tables(spark, tmp_path):
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", None, "s", 0)] + made_docs(5, 20)[:9], DOC)
    for name, df in (("documents", odd), ("labels", spark.createDataFrame([], "doc_id long, quality int, toxic int")), ("benchmark", spark.createDataFrame([], "item_id long, text string"))):
        df.write.parquet(f"{tmp_path}/a/{name}.parquet")
        df.limit(0).write.parquet(f"{tmp_path}/b/{name}.parquet")
    assert pipeline.run(spark, f"{tmp_path}/b").count() == 0
    # without labels the base rules alone decide, and nothing is left to compare with
    found = {r.doc_id for r in pipeline.run(spark, f"{tmp_path}/a").collect()}
    long_enough = {r.doc_id for r in odd.collect() if (s := brute_statistics(r.text))[0] >= 50 and 100 * s[4] <= 50 * s[0]}
    assert found <= long_enough and None not in found
