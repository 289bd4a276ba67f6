"""Each operator against a plain brute-force version, and its defined edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from evenkeel.llm import chat_format, decontamination, line_dedup, minhash_dedup, mixing, quality_rules, queries, sharding, substring_dedup, toxicity, url_filter
from evenkeel.llm import words as W
from tests.compare import connection, same

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})
DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t ", "one", "é ü\u2003ñ", "x" * 300, "a b\x0bc\r\nd", "\ud7ff ok \U0001F600 z", "<turn a>\n</turn>\n\\b"]


def words(text):
    return WORD.findall(text or "")


def made_docs(seed=3, n=60):
    """Documents with copies, near copies, shared passages and odd texts."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdeé"), rng.integers(1, 6)))
    passage = " ".join(word() for _ in range(30))
    texts = [t for t in ODD]
    while len(texts) < n:
        kind = rng.integers(0, 6)
        fresh = [word() for _ in range(rng.integers(5, 120))]
        if kind == 0 and len(texts) > 12:
            texts.append(texts[rng.integers(len(ODD), len(texts))])
        elif kind == 1 and len(texts) > 12:
            near = words(texts[rng.integers(len(ODD), len(texts))])
            if near:
                near[rng.integers(0, len(near))] = "changed"
            texts.append(" ".join(near))
        elif kind == 2:
            at = rng.integers(0, len(fresh))
            texts.append(" ".join(fresh[:at]) + "\n" + passage + " " + " ".join(fresh[at:]))
        else:
            texts.append("\n".join(" ".join(fresh[k : k + 9]) for k in range(0, len(fresh), 9)))
    order = rng.permutation(len(texts))
    return [(int(i) * 3, texts[k], "en" if k % 3 else None, f"s{k % 4}" if k % 7 else None, len(texts[k] or "")) for i, k in enumerate(order)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made_docs(), DOC)


def with_extras(df):
    """Columns whose names operators use inside."""
    return df.withColumns({c: F.lit(1) for c in ("id", "key", "print", "bytes", "h", "shard", "words", "rep", "kept", "tokens", "topic", "probability", "STATS", "_of", "_print", "of", "of_print", "_source", "_lang", "_topic", "_chance", "chance", "cell_source", "class", "keys", "step", "depth", "p", "q", "masked", "line", "leaf")})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\t\x0b\x0cX", max_size=30), min_size=1, max_size=5))
def test_words_and_joining(texts):
    import pyarrow as pa

    found = W.cut(*W.texts(pa.array(texts, pa.string())))
    got = [bytes(found.data[s:e]).decode() for s, e in zip(found.start, found.end)]
    assert got == [w for t in texts for w in words(t)] and found.counts.tolist() == [len(words(t)) for t in texts]
    keep = np.arange(len(got)) % 3 != 1
    out, cuts = W.joined(found, keep)
    at = iter(keep)
    want = [" ".join(w for w in words(t) if next(at)) for t in texts]
    assert [bytes(out[a:b]).decode() for a, b in zip(cuts, cuts[1:])] == want


def brute_statistics(text):
    ws, text = words(text), text or ""
    triples = Counter(zip(ws, ws[1:], ws[2:]))
    covered = {k + j for k in range(len(ws) - 2) if triples[tuple(ws[k : k + 3])] > 1 for j in range(3)}
    lines = [line for line in text.split("\n") if words(line)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(spark, docs):
    rows = quality_rules.statistics(docs, ["doc_id", "text"]).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert tuple(r.stats)[:5] == brute_statistics(r.text)


def test_quality_rules_learn_and_apply(spark):
    rng = np.random.default_rng(1)
    x = {"a": rng.random(600), "b": rng.random(600), "c": rng.random(600)}
    bad = ((x["a"] > 0.8) & (x["b"] <= 0.5)) | (x["c"] > 0.95)
    rules = quality_rules.learn(x, bad)
    assert 1 < len(rules) <= 12
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(x["a"], x["b"], x["c"])], "a double, b double, c double")
    kept = [r.k for r in df.select(quality_rules.verdict(rules, {k: F.col(k) for k in "abc"}).alias("k")).collect()]
    assert np.mean(np.array(kept) == ~bad) > 0.97
    text = df.select(quality_rules.verdict(rules, {k: F.col(k) for k in "abc"}).alias("k"))._jdf.queryExecution().toString()
    assert "CASE WHEN" in text


def test_quality_filter_keeps_columns_and_works_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = quality_rules.filter_documents(with_extras(docs), none)
    assert kept.columns == with_extras(docs).columns
    want = {r.doc_id for r in docs.collect() if (s := brute_statistics(r.text))[0] >= 50 and 100 * s[4] <= 50 * s[0]}
    assert {r.doc_id for r in kept.collect()} == want
    assert quality_rules.filter_documents(docs.limit(0), none).count() == 0


def brute_repeats(rows, n=20):
    first, out = {}, {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        ws, gone = words(text), set()
        for k in range(len(ws) - n + 1):
            if first.setdefault(tuple(ws[k : k + n]), (doc_id, k)) != (doc_id, k):
                gone.update(range(k, k + n))
        kept = " ".join(w for k, w in enumerate(ws) if k not in gone)
        out[doc_id] = (len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_substring_dedup(spark, seed):
    rows = [(r[0], r[1]) for r in made_docs(seed)] + [(None, "a b c"), (10_000, "q r " * 60), (10_001, "r q " * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in substring_dedup.remove_repeats(df).collect()}
    assert got == brute_repeats(rows)
    assert any(v[1] for v in got.values())


def test_substring_dedup_of_repeated_rows_and_nothing(spark):
    text = " ".join(f"w{k}" for k in range(40))
    df = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in substring_dedup.remove_repeats(with_extras(df)).collect()) == [(1, 0), (1, 0), (2, 40)]
    assert substring_dedup.remove_repeats(df.limit(0)).count() == 0


def test_substring_dedup_of_rows_without_an_id_of_their_own(spark):
    span = lambda c, n: [f"{c}{k}" for k in range(n)]
    shared, texts = span("s", 30), []
    for k in range(6):  # the same place in two texts, other places in the others, and texts without the passage
        texts.append(span(f"a{k}_", 45) if k % 3 == 2 else span(f"a{k}_", 10 * (k // 2)) + shared + span(f"b{k}_", 25))
    rows = [(i, " ".join(t)) for i in (None, 7) for t in texts]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.n_words) for r in got) == sorted((i is None, len(words(t))) for i, t in rows)
    kept = Counter((r.doc_id, r.kept_text) for r in got)
    # without an id all are later than 7: their words go, as copies of those of 7
    assert kept[(None, "")] == 6
    mine = [r for r in got if r.doc_id == 7]
    assert sorted(r.n_removed for r in mine) == [0, 0, 0, 30, 30, 30]
    alone = substring_dedup.remove_repeats(spark.createDataFrame([r for r in rows if r[0] is None], "doc_id long, text string")).collect()
    assert sorted(r.n_removed for r in alone) == [0, 0, 0, 30, 30, 30]
    for t in texts:
        own = " ".join(w for w in t if w not in shared)
        assert sum(r.kept_text in (" ".join(t), own) for r in alone) == sum(r.kept_text in (" ".join(t), own) for r in mine) == 1


@pytest.mark.parametrize("name", ["op2_substring_dedup", "op8_decontamination"])
def test_whole_tables_equal_their_sql(spark, data, name):
    same(queries.QUERIES[name](spark, data), connection(data), queries.ORACLE_SQL[name])


def test_long_spans_join_adjoining_repeats(spark):
    text = " ".join(f"w{k}" for k in range(100))
    df = spark.createDataFrame([(1, text), (2, "head " + text + " tail")], "doc_id long, text string")
    spans = [tuple(r) for r in substring_dedup.long_spans(substring_dedup.repeats(df)).select("id", "source_id", "at", "length", "source_at").collect()]
    assert spans == [(2, 1, 1, 100, 0)]


def test_chat_format_equals_its_sql(spark, data):
    same(queries.op3_chat_format(spark, data), connection(data), chat_format.SQL)


def test_chat_format_of_odd_rows(spark):
    rows = [(1, 0, "user", t) for t in ODD] + [(1, 1, "assistant", t) for t in ODD] + [(2, None, None, "x"), (None, 3, "we<i>rd\nrole", "y"), (3, 0, "assistant", "dup"), (3, 0, "assistant", "dup")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = chat_format.read_back(chat_format.render(chat_format.fold(chat_format.log_of(df))))
    found = {r.conv_id: r for r in back.collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())
    for conv in (1, 2, 3, None):
        mine = sorted((r for r in rows if r[0] == conv), key=key)
        assert [(t.role, t.text) for t in found[conv].turns] == [(r[2] or "", r[3] or "") for r in mine]
        assert found[conv].loss_text == "".join(r[3] or "" for r in mine if r[2] == "assistant")
    assert chat_format.digest(df.limit(0)).count() == 0


def test_folding_edits_and_regenerations(spark):
    log = [(0, "open", "assistant"), (1, "delta", "no"), (2, "regenerate", None), (3, "delta", "a"), (4, "delta", "b"), (5, "edit", "c"), (6, "delta", "d"), (7, "delta", None)]
    df = spark.createDataFrame([(1, 0, 0, s, k, t) for s, k, t in reversed(log)] + [(1, 1, 1, 0, "delta", "lone")], "conv_id long, turn long, message long, seq int, kind string, text string")
    assert [(r.role, r.text) for r in chat_format.fold(df).orderBy("turn").collect()] == [("assistant", "cd"), ("", "lone")]


def test_mixing_equals_its_sql(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    # the rare cells of the smallest tables converge slowly: both take the same rounds
    found = mixing.weigh(docs, rounds=mixing.SQL_ROUNDS).withColumn("probability", F.round("probability", 6))
    same(found, connection(data), queries.ORACLE_SQL["op4_mixing"])


def spread_docs(spark, n=400):
    """Documents of very unequal sources, languages and topics, so that rare cells fill."""
    rng = np.random.default_rng(5)
    pick = lambda names, p: str(rng.choice(names, p=p))
    rows = [(k, " ".join(["w"] * int(rng.integers(5, 60))) + pick(["", " License", " | x"], [0.9, 0.08, 0.02]), pick(["en", "de"], [0.92, 0.08]), pick(list("abcd"), [0.8, 0.12, 0.05, 0.03]), 0) for k in range(n)]
    return spark.createDataFrame(rows, DOC)


def test_mixing_keeps_budget_and_marginals_when_cells_fill(spark):
    with pytest.warns(UserWarning, match="kept whole"):
        rows = mixing.weigh(spread_docs(spark)).toPandas()
    rows["expected"] = rows["tokens"] * rows["probability"]
    total = rows["tokens"].sum()
    assert (rows["probability"] == 1).any() and rows["probability"].between(0, 1).all()
    assert abs(rows["expected"].sum() - mixing.BUDGET * total) < 1e-6 * total
    unmet = 0
    for d in mixing.DIMENSIONS:
        have = rows.groupby(d)["tokens"].sum()
        goal = have**mixing.TEMPER / (have**mixing.TEMPER).sum() * mixing.BUDGET * total
        low, high = 0.0, 1e6  # bisection: goals of at most what there is that add up to the budget
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if np.minimum(have, mid * goal).sum() < mixing.BUDGET * total else (low, mid)
        assert np.allclose(rows.groupby(d)["expected"].sum(), np.minimum(have, high * goal), rtol=0, atol=1e-6 * total)
        unmet += int((have < goal).sum())
    table = mixing.marginals(spread_docs(spark)).toPandas()
    assert unmet == (table["attainable"] < table["goal"] * (1 - 1e-9)).sum() > 0
    assert np.allclose(table["expected"], table["attainable"], rtol=0, atol=1e-6 * total)


def test_mixing_tells_when_no_sample_meets_all_marginals(spark):
    cells = spark.createDataFrame([("a", "x", "t", 100), ("b", "y", "t", 100)], "source string, lang string, topic string, tokens long")
    goal = lambda d, *shares: spark.createDataFrame(list(shares), f"{d} string, target double")
    goals = {"source": goal("source", ("a", 0.3), ("b", 0.7)), "lang": goal("lang", ("x", 0.6), ("y", 0.4)), "topic": goal("topic", ("t", 1.0))}
    found, gap = mixing.rake(cells, mixing.attainable(cells, goals, 0.5), 0.5, rounds=20)
    assert gap > 0.1 and np.allclose([r.expected for r in found.orderBy("source").collect()], [60, 40])


def test_mixing_edge_cases(spark, docs):
    twice = docs.unionByName(docs)
    kept = mixing.weigh(with_extras(twice)).groupBy("doc_id").agg(F.count_distinct("kept").alias("n"), F.count("*").alias("rows"))
    assert kept.where("n <> 1 or rows <> 2").count() == 0
    assert mixing.sample(with_extras(docs)).columns == with_extras(docs).columns
    weighed = {r.doc_id for r in mixing.weigh(docs).where("kept").collect()}
    assert {r.doc_id for r in mixing.sample(docs).collect()} == weighed
    assert mixing.weigh(docs.limit(0)).count() == 0 and mixing.sample(docs.limit(0)).count() == 0


def test_url_filter_equals_its_sql(spark, data):
    same(queries.op5_url_filter(spark, data), connection(data), url_filter.SQL)


URLS = [
    ("http://a.NET/x", "a.net", "/x", "net/", "block"), ("https://x.example.net/en/1?q", "x.example.net", "/en/1", "example.net/en/", "allow"), ("https://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
    ("https://badexample.com/de/", "badexample.com", "/de/", None, "allow"), ("http://w.org/fr/a#t", "w.org", "/fr/a", "org/fr/", "allow"), ("http://a.net", "a.net", "", None, "allow"), ("http://a.net?x=/", "a.net", "", None, "allow"),
    (None, "", "", None, "allow"), ("no scheme.net/", "", "", None, "allow"), ("", "", "", None, "allow"), ("x://u://v/p", "u:", "//v/p", None, "allow"), ("http://Listed.de/a.html", "listed.de", "/a.html", None, "block"), ("https://www.listed.de/a/?r", "www.listed.de", "/a/", None, "block"), ("http://ÉA.de/É", "Éa.de", "/É", None, "allow"),
]


@pytest.mark.parametrize("most_blocks", [1 << 16, 0])
def test_url_rules_and_lists(spark, most_blocks):
    pages = spark.createDataFrame([(i, u[0], "h") for i, u in enumerate(URLS)] * 2, "page_id long, url string, html string")
    listed = spark.createDataFrame([("listed.de/a",), ("other.de",)], "listed string")
    got = url_filter.judge(pages, listed, most_blocks=most_blocks).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == URLS[r.page_id][1:]
    assert url_filter.judge(pages, listed.limit(0)).where("listed").count() == 0
    assert url_filter.judge(pages.limit(0), listed).count() == 0


def test_a_page_is_listed_for_what_its_other_addresses_show(spark):
    noisy, plain = "<p>### $$$ %%% words</p>", "<p>plain words of a page</p>"
    rows = [(1, "http://www.a.de/x.html", noisy), (2, "https://a.de/x/?q=1", plain), (3, "http://m.a.de/x", plain), (4, "http://a.de/y", plain), (5, "http://b.adult-x.de/", plain), (6, None, noisy), (7, "http://c.net/z", noisy), (8, "http://d.de/", None)]
    pages = with_extras(spark.createDataFrame(rows, "page_id long, url string, html string"))
    listed = url_filter.listed_urls(pages, ("adult-x",))
    assert {r.listed for r in listed.collect()} == {"a.de/x", "b.adult-x.de", "c.net/z"}
    got = {r.page_id: (r.listed, r.verdict) for r in url_filter.judge(pages, listed).collect()}
    assert got == {1: (True, "block"), 2: (True, "block"), 3: (True, "block"), 4: (False, "allow"), 5: (True, "block"), 6: (False, "allow"), 7: (True, "block"), 8: (False, "allow")}
    assert url_filter.listed_urls(pages.limit(0), ()).count() == 0


def test_bloom_filter_misses_nothing_and_passes_little(spark):
    listed = spark.range(2000).select(F.concat(F.lit("h.de/"), F.col("id").cast("string")).alias("listed"))
    blocks = url_filter.n_blocks(2000)
    urls = spark.range(6000).select("id", F.concat(F.lit("h.de/"), F.col("id").cast("string")).alias("canonical"))
    found = url_filter.possible(urls, url_filter.bloom(listed, blocks), blocks)
    assert found.where("id < 2000 and not maybe").count() == 0
    assert found.where("id >= 2000 and maybe").count() < 120


def toxic_rows(n=900):
    rng = np.random.default_rng(0)
    texts, labels = [], []
    for i in range(n):
        ws = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(40)]
        toxic = i % 6 == 0
        if toxic:
            for at in rng.integers(0, 40, 3):
                ws[at] = rng.choice(["idiot", "zorkling", "zorkles", "Zorked!", "grubnak"])
        texts.append((i, " ".join(ws)))
        labels.append((i, 1, int(toxic)))
    return texts, labels


def test_toxicity_holds_out(spark):
    texts, labels = toxic_rows()
    docs = spark.createDataFrame(texts + [(None, "x idiot"), (5000, None), (5001, "")], "doc_id long, text string")
    known = spark.createDataFrame(labels + [(None, 1, 1), (7, 1, None), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.score(with_extras(docs), toxicity.fit(docs, known)).collect()
    assert len(rows) == len(texts) + 3 and all(0 <= r.score <= 1 for r in rows)
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    unseen = [r for r in rows if r.held_out and r.doc_id < 900]
    assert np.mean([r.predicted == (r.doc_id % 6 == 0) for r in unseen]) > 0.97


def plain_cells(text):
    """The cells of a text and its number of words, one word at a time in plain integers."""
    hashed = lambda b: int(W.spans_hash(W._BYTE_KEYS[np.frombuffer(b, np.uint8)], np.array([0]), np.array([len(b)]), W._BYTE_BASE)[0])
    cell = lambda h: (int(W.mix(np.array([h], dtype=np.uint64))[0]) >> 8) % toxicity.CELLS
    found, many = set(), re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    for word in many:
        word = word.lower()  # of bytes: A-Z alone
        for _ in range(3):
            word = word[1:] if len(word) > 1 and word[:1] in b"\"'()[]{}.,;:!?*_-" else word
            word = word[:-1] if len(word) > 1 and word[-1:] in b"\"'()[]{}.,;:!?*_-" else word
        found.add(cell(hashed(word)))
        found |= {cell(hashed(word[:n]) ^ n) for n in (4, 5, 6, 7) if len(word) > n}
    return found, len(many)


def test_toxicity_equals_brute_force(spark):
    texts, labels = toxic_rows(300)
    texts += [(5000, None), (5001, ""), (5002, "«Zorkling» (idiot), über-zorked")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    known = dict((i, t) for i, _, t in labels if zlib.crc32(str(i).encode()) % 4 != 2)
    cells = {i: plain_cells(t) for i, t in texts}
    # counts of the training rows, the lexicon by likelihood ratio, then votes, label model and classifier row by row
    n_toxic = sum(known.values())
    counts = {True: Counter(), False: Counter()}
    for i, t in known.items():
        counts[bool(t)].update(cells[i][0])
    worth = {}
    for c, t in counts[True].items():
        k, n = counts[False][c], len(known)
        rate_t, rate_c, both = (t + 0.5) / (n_toxic + 1), (k + 0.5) / (n - n_toxic + 1), (t + k + 1) / (n + 2)
        ratio = 2 * (t * math.log(rate_t / both) + k * math.log(rate_c / both))
        if t >= 3 and rate_t > 4 * rate_c and ratio > 15:
            worth[c] = ratio, rate_t / rate_c
    first = sorted(worth.values(), key=lambda w: -w[0])[:10]
    worth = {c: w for c, (w, lift) in worth.items() if lift > math.sqrt(np.median([x for _, x in first]))}
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert set(np.flatnonzero(model.place >= 0)) == set(worth) and len(worth) > 3
    order = sorted(worth, key=lambda c: (-round(worth[c], 9), c))
    assert sorted(model.place[order]) == list(range(len(order)))
    weight = {c: model.weights[model.place[c]] for c in order}
    want = {i: 1 / (1 + math.exp(-(model.bias + sum(weight.get(c, 0.0) for c in mine)))) for i, (mine, _) in cells.items()}
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)
    # the classifier itself: on the same posteriors a plain loop arrives at the same weights
    items = [np.array(sorted(model.place[list(cells[i][0] & set(order))]), dtype=np.int64) for i in sorted(known)]
    target = np.linspace(0, 1, len(items))
    w, bias = toxicity.train(items, target, len(order), rounds=5)
    v, m1, m2 = [0.0] * (len(order) + 1), [0.0] * (len(order) + 1), [0.0] * (len(order) + 1)
    for t in range(1, 6):
        g = [0.0] * len(v)
        for mine, goal in zip(items, target):
            miss = (1 / (1 + math.exp(-(v[-1] + sum(v[k] for k in mine)))) - goal) / len(items)
            for k in [*mine, -1]:
                g[k] += miss
        for k in range(len(v)):
            g[k] += 1e-4 * v[k] / len(v) if k < len(order) else 0.0
            m1[k], m2[k] = 0.9 * m1[k] + 0.1 * g[k], 0.999 * m2[k] + 0.001 * g[k] ** 2
            v[k] -= 0.1 * (m1[k] / (1 - 0.9**t)) / (math.sqrt(m2[k] / (1 - 0.999**t)) + 1e-8)
    assert np.allclose([*w, bias], v, atol=1e-9)


def test_toxicity_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert len({r.score for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()}) == 1
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), none)).count() == 0


def test_label_model_finds_accuracies_and_shares_weight():
    """From votes alone; three voters are one voter three times over."""
    rng = np.random.default_rng(2)
    y = rng.random(6000) < 0.3
    voter = lambda accuracy: np.where(rng.random(6000) < accuracy, y, ~y)
    good, fair, other, weak = (voter(a) for a in (0.9, 0.85, 0.8, 0.65))
    vote = np.stack([good, fair, other, weak, weak, weak], axis=1) * 2 - 1
    posterior, accuracy, correlation = toxicity.label_model(vote.astype(np.int8))
    assert np.all(np.abs(accuracy[:3] - [0.9, 0.85, 0.8]) < 0.06) and accuracy[3] < 0.75 and correlation[3, 4] > 0.9
    alone = np.mean((posterior > 0.5) == y)
    assert alone > 0.91 and alone > max(np.mean(v == y) for v in (good, fair, other, weak))


def test_toxicity_withstands_wrong_labels(spark):
    """A quarter of the labels is wrong: the posteriors train a better classifier than those labels do."""
    rng = np.random.default_rng(4)
    texts, labels = toxic_rows(2400)
    wrong = [(i, q, int(t != (rng.random() < 0.25))) for i, q, t in labels]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(wrong, "doc_id long, quality int, toxic int"))
    place = model.place
    seen = [i for i, _ in texts if zlib.crc32(str(i).encode()) % 4 != 2]
    items = {i: np.unique([place[c] for c in plain_cells(t)[0] if place[c] >= 0]).astype(np.int64) for i, t in texts}
    w, bias = toxicity.train([items[i] for i in seen], np.array([dict((k, t) for k, _, t in wrong)[i] for i in seen], dtype=float), len(model.weights))
    unseen = [i for i, _ in texts if i not in set(seen)]
    truth = np.array([i % 6 == 0 for i in unseen])
    loss = lambda w, b: np.mean((1 / (1 + np.exp(-np.array([w[items[i]].sum() + b for i in unseen]))) - truth) ** 2)
    assert loss(model.weights, model.bias) < 0.5 * loss(w, bias)
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()}
    assert np.mean([got[i] for i in unseen] == truth) > 0.97


def test_a_sample_is_bounded_whatever_repeats(spark):
    docs = spark.range(40_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("idiot").alias("text"))
    assert 700 < toxicity.sample_rows(docs, 1000).count() < 1300
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    stats = quality_rules.statistics(docs.withColumn("text", F.lit("a b c d e " * 20)), ["doc_id"])
    assert quality_rules.training_rows(stats, labels).count() <= 1


def test_line_dedup_equals_its_sql(spark, data):
    same(queries.op7_line_dedup(spark, data), connection(data), line_dedup.sql())


def test_line_dedup_generalises_fields(spark):
    rows = [(i, f"own text number{'x' * i} of this page alone\nServed user {i * 7} in {i} ms by node alpha{chr(97 + i)} ok now then\n\nlast") for i in range(12)] + [(100, None), (101, ""), (102, "\n \n"), (103, "solo")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.drop_lines(with_extras(df)).collect()}
    assert all(got[i].kept_text == rows[i][1].split("\n")[0] + "\n" for i in range(12))
    assert (got[100].n_lines, got[100].kept_text, got[102].n_lines, got[103].n_dropped) == (0, None, 0, 0)
    few = line_dedup.drop_lines(df.where("doc_id < 9")).agg(F.sum("n_dropped")).first()[0]
    assert few == 0 and line_dedup.drop_lines(df.limit(0)).count() == 0


def brute_leaks(rows, items, n=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    wins = defaultdict(set)
    for item, text in items:
        ws = cut(text)
        for k in range(max(len(ws) - n + 1, 1) if ws else 0):
            wins[tuple(ws[k : k + n])].add(item)
    out = []
    for doc_id, text in rows:
        ws, hit, found = cut(text), set(), set()
        for size in {len(w) for w in wins}:
            for k in range(len(ws) - size + 1):
                if (w := tuple(ws[k : k + size])) in wins:
                    hit.update(range(k, k + size))
                    found |= wins[w]
        out.append((doc_id, len(ws), len(hit), sorted(map(str, found - {None}))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most_broadcast", [decontamination.MOST_BROADCAST, 0])
def test_decontamination(spark, most_broadcast):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{k}" for k in range(40)] + ["É1", "don't", "x-y"]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(k, text(25)) for k in range(6)] + [(6, "two words"), (7, None), (8, "!!"), (9, "w1"), (None, text(12)), (0, text(14))]
    rows = [(k, text(30) + " " + (items[k % 6][1][3:90].upper() if k % 3 == 0 else "")) for k in range(30)]
    rows += [(40, "Two  WORDS!"), (41, None), (42, ""), (None, items[1][1]), (1, rows[0][1]), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.inspect(with_extras(df), known, most_broadcast=most_broadcast).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in found), key=repr) == brute_leaks(rows, items)
    assert all(r.contaminated == (r.n_hit > 0) for r in found)
    clean = decontamination.drop_contaminated(with_extras(df), known, most_broadcast=most_broadcast)
    assert clean.columns == with_extras(df).columns and clean.count() == sum(not r.contaminated for r in found)


def test_decontamination_of_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.inspect(docs, none).where("contaminated").count() == 0
    assert decontamination.inspect(docs.limit(0), none).count() == 0


@pytest.mark.parametrize("limit", [sharding.LIMIT, 40_000, 2_000])
def test_sharding_equals_its_sql(spark, data, limit):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    same(sharding.shard_documents(docs, limit).select("doc_id", "shard", "n_bytes", "n_rows"), connection(data), sharding.sql(limit))


@pytest.mark.parametrize("most_broadcast", [sharding.MOST_BROADCAST, 0])
def test_shards_fit_even_for_repeated_rows(spark, docs, most_broadcast):
    many = docs.unionByName(spark.range(500).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same text").alias("text"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(9).cast("long").alias("n_chars")))
    out = sharding.assign(sharding.keys(many), sharding.directory(sharding.keys(many), 1_500), most_broadcast)
    rows = out.select("shard", "bytes", "n_bytes", "n_rows").toPandas()
    assert len(rows) == many.count()
    sizes = rows.groupby("shard")["bytes"].agg(["sum", "count"])
    assert ((sizes["sum"] <= 1_500) | (sizes["count"] == 1)).all()
    names = sorted(sizes.index)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))


def test_repeats_of_a_large_row_are_all_sharded(spark):
    many = spark.range(0, 300, 1, 3).select(F.lit(1).cast("long").alias("doc_id"), F.repeat(F.lit("x "), F.lit(50)).alias("text"))
    out = sharding.shard_documents(many, limit=2_000).groupBy("shard").agg(F.count("*").alias("n"), F.max("n_rows").alias("n_rows"), F.max("n_bytes").alias("n_bytes")).collect()
    assert sum(r.n for r in out) == 300 and all(r.n == r.n_rows and r.n_bytes <= 2_000 for r in out)


def test_sharding_passes_columns_through(spark, docs):
    out = sharding.shard_documents(with_extras(docs))
    assert set(with_extras(docs).columns) - {"shard"} <= set(out.columns) and "own_shard" in out.columns
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_sharding_renames_clashing_columns_to_free_names(spark, docs, tmp_path):
    odd = docs.withColumns({c: F.lit(1) for c in ("H", "own_h", "own_own_H", "shard", "OWN_SHARD", "entry")})
    out = sharding.shard_documents(odd)
    assert len({c.lower() for c in out.columns}) == len(out.columns) and {"H", "own_h", "own_own_H", "OWN_SHARD", "entry"} <= set(out.columns)
    out.write.parquet(f"{tmp_path}/shards")


def brute_classes(rows, n=5, limit=0.8):
    """Classes by exact weighted Jaccard of all pairs, with the operator's own weights."""
    texts = {i: words((t or "").translate(LOWER)) for i, t in rows if i is not None}
    grams = {i: Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else Counter([tuple(w)] if w else []) for i, w in texts.items()}
    df = Counter(g for c in grams.values() for g in c)
    total = sum(1 for c in grams.values() if c)
    rare = lambda g: df[g] <= minhash_dedup.COMMON * total
    weight = lambda g: 1 + minhash_dedup.DAMPING * (1 if rare(g) else math.log(total / df[g]) / -math.log(minhash_dedup.COMMON))
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = {}
    ids = sorted(texts)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            keys = grams[a].keys() | grams[b].keys()
            if grams[a] and grams[b]:
                up = sum(weight(g) * min(grams[a][g], grams[b][g]) for g in keys)
                down = sum(weight(g) * max(grams[a][g], grams[b][g]) for g in keys)
                pairs[a, b] = up / down
                if up / down >= limit:
                    p, q = sorted((find(a), find(b)))
                    root[q] = p
    return {i: find(i) for i in texts}, pairs


@pytest.mark.parametrize("seed", [3, 11])
def test_near_duplicate_classes(spark, seed):
    rows = [(r[0], r[1]) for r in made_docs(seed, 80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in minhash_dedup.classes(with_extras(df)).collect()}
    want, _ = brute_classes(rows)
    assert got == want and len(set(want.values())) < len(rows) - 5
    kept = minhash_dedup.drop_near_duplicates(with_extras(df))
    assert kept.columns == with_extras(df).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_near_duplicates_of_rows_that_share_an_id_or_have_none(spark):
    text = lambda c, n=40: " ".join(f"{c}{k}" for k in range(n))
    near = text("a") + " more"
    rows = [(1, text("a")), (1, text("b")), (2, text("c")), (2, near), (3, text("c")), (None, text("d")), (None, text("e")), (None, text("b")), (4, text("f")), (4, text("f")), (None, None)]
    df = with_extras(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(((r.doc_id, r.class_id) for r in minhash_dedup.classes(df).collect()), key=repr)
    # the copy of a under 2 joins 1, the other text of 2 keeps its own class, and so do the unnamed d and e
    assert got == sorted([(1, 1), (1, 1), (2, 2), (2, 1), (3, 2), (None, None), (None, None), (None, 1), (4, 4), (4, 4), (None, None)], key=repr)
    kept = sorted(((r.doc_id, r.text) for r in minhash_dedup.drop_near_duplicates(df).collect()), key=repr)
    assert kept == sorted([rows[0], rows[1], rows[2], rows[5], rows[6], rows[8], rows[9], rows[10]], key=repr)


def test_weights_fall_with_the_share_of_documents_alone(spark):
    """Doubling a corpus (under other ids) changes no weight."""
    rows = [(i, f"all of these words stand everywhere and then u{i} v{i} w{i} x{i} y{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = (minhash_dedup.fit_weights(x, 5, 1 << 12, 0.25, 0.01) for x in (df, df.unionByName(df)))
    assert len(one.keys) and (one.keys == two.keys).all() and np.allclose(one.factor, two.factor) and one.rare == two.rare == 1.25
    assert np.allclose(one.factor, 1) and len(one.keys) == 4


def rows_sent(spark, monkeypatch):
    """The numbers of rows of each later collect, toPandas and toArrow."""
    kind, sent = type(spark.range(0)), []
    for name in ("collect", "toPandas", "toArrow"):

        def counting(self, *a, f=getattr(kind, name), **b):
            out = f(self, *a, **b)
            sent.append(len(out))
            return out

        monkeypatch.setattr(kind, name, counting)
    return sent


@pytest.mark.parametrize("cells", [1 << 12, 1000])
def test_minhash_sketch_reaches_the_driver_as_bits(spark, monkeypatch, cells):
    texts = [f"{i} " + " ".join(f"w{(i * 7 + k) % 900}" for k in range(60)) + " a very common tail of words" * (i % 3 == 0) for i in range(400)] + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    load, held = Counter(), Counter()
    for t in texts:
        doc, keys, _ = minhash_dedup.counted(*minhash_dedup.shingles(W.cut(*W.texts(pa.array([t or ""])), lower=True), 5))
        load.update(minhash_dedup._cell(keys, cells).tolist())
        held.update(keys.tolist())
    least = 0.25 * 400
    sent = rows_sent(spark, monkeypatch)
    crowded, seen = minhash_dedup._sketch(df, cells, 5, 0.25)
    assert seen == 400 and crowded.shape == (cells,)
    assert set(np.flatnonzero(crowded).tolist()) == {c for c, n in load.items() if n > least} != set()
    found = minhash_dedup.fit_weights(df, 5, cells, 0.25, 0.25)
    assert found.keys.tolist() == sorted(k for k, n in held.items() if n > least) != []
    assert len(load) > 2 * (cells // 64 + 1) and max(sent) <= cells // 64 + 1
    # no text, no crowded cell
    crowded, seen = minhash_dedup._sketch(df.limit(0), cells, 5, 0.25)
    assert seen == 0 and not crowded.any() and crowded.shape == (cells,)
    assert len(minhash_dedup.fit_weights(df.limit(0), 5, cells, 0.25, 0.25).keys) == 0


def test_large_groups_of_near_copies_join(spark):
    rng = np.random.default_rng(9)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(150):
        text = list(base)
        for at in rng.integers(0, 150, 2):
            text[at] = f"c{i}"
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, " ".join(f"u{i}x{k}" for k in range(60))) for i in range(40)]
    got = {r.doc_id: r.class_id for r in minhash_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len({got[i] for i in range(150)}) == 1
    assert all(got[1000 + i] == 1000 + i for i in range(40))


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert minhash_dedup.classes(df).count() == 0
    df = spark.createDataFrame([(1, None), (2, ""), (3, " ")], "doc_id long, text string")
    assert {tuple(r) for r in minhash_dedup.classes(df).collect()} == {(1, 1), (2, 2), (3, 3)}


def test_weighted_samples_agree_as_often_as_texts_are_similar():
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 2**63, 300, dtype=np.uint64)
    weights = rng.uniform(0.5, 3, 300)
    doc = np.concatenate([np.zeros(200, dtype=int), np.ones(200, dtype=int)])
    both = np.concatenate([keys[:200], keys[100:]])
    other = np.concatenate([weights[:200], weights[100:] * np.where(np.arange(200) < 50, 1.5, 1.0)])
    found = minhash_dedup.band_keys(doc, both, other, 2, bands=2000, rows=1)
    a, b = np.zeros(300), np.zeros(300)
    a[:200], b[100:] = other[:200], other[200:]
    assert abs(np.mean(found[0] == found[1]) - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


def test_components_of_long_paths(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (101, 102), (7, 7)], "a long, b long")
    found = {r.node: r["class"] for r in minhash_dedup.components(links).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_registry(spark):
    assert set(queries.QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES) == list(range(1, 14))
    duckdb.sql("SELECT 1")


def test_blocks_find_what_pivots_leave(spark, monkeypatch):
    """A loose group, most of whose members match only some of the others."""
    monkeypatch.setattr(minhash_dedup, "BLOCK_BYTES", 4_000)
    rng = np.random.default_rng(12)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(90):
        text = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 7)):
            text[at] = f"c{i}x{at}"
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tried = []
    blocks = minhash_dedup._in_blocks
    monkeypatch.setattr(minhash_dedup, "_in_blocks", lambda *of: tried.append(blocks(*of)) or tried[-1])
    got = {r.doc_id: r.class_id for r in minhash_dedup.classes(df, bands=24, rows=2).collect()}
    want, _ = brute_classes(rows)
    assert got == want and 1 < len(set(want.values())) < 90
    assert tried and tried[0].count() > 0
