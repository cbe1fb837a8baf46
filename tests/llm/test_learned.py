"""Operators with models: held-out quality, gradients, guarantees, and the pipeline."""

import math
import random
import re

import numpy as np
import odd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codeloom.llm import jaccard, language, mixing, pii, quality, rules, secrets
from codeloom.llm.queries import QUERIES, fold

SF = "/root/testdata/sf0.01"


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def test_quality_held_out(spark):
    got = QUERIES["op2_neighbour_quality"].plan(spark, SF).join(table(spark, "labels"), "doc_id").where("held_out")
    right = got.agg(F.avg((F.col("quality") == F.col("predicted")).cast("double"))).first()[0]
    assert right > 0.95


@pytest.mark.parametrize("letters, gap", [("abcdefghijklmnop", " "), ("абвгдежзиклмноп", " "), ([chr(0x4E00 + i) for i in range(600)], "")])
def test_quality_sees_wording(spark, letters, gap):
    """Good and bad documents of one layout differ in some of their words only."""
    rng = random.Random(5)
    common, good, bad = ([[*rng.choices(letters, k=rng.randint(2, 7))] for _ in range(n)] for n in (300, 150, 150))
    rows = []
    for i in range(800):
        words = [rng.choice(common if rng.random() < 0.7 else good if i % 2 else bad) for _ in range(rng.randint(30, 150))]
        rows.append((i, gap.join("".join(w) for w in words), i % 2))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    held = quality.classify(docs, docs.select("doc_id", "quality"), fold(5, 0)).where("held_out").collect()
    assert len(held) > 100 and sum(r.predicted == r.doc_id % 2 for r in held) > 0.95 * len(held)


def test_language_held_out(spark):
    got = QUERIES["op3_hierarchical_language"].plan(spark, SF).join(table(spark, "documents").select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97


def test_odd_documents(spark, odd_docs, labels):
    n = odd_docs.count()
    q = quality.classify(odd_docs, labels, fold(5, 0)).collect()
    assert len(q) == n and all(0 <= r.score <= 1 and r.predicted == (r.score >= quality.CUT) for r in q)
    lang = language.identify(odd_docs, fold(4, 2), per_language=5).collect()
    assert len(lang) == n and all(0 <= r.score <= 1 for r in lang)
    letterless = {i for i, t in enumerate(odd.texts()) if not any(c.isalpha() for c in t or "")}
    assert {r.doc_id for r in lang if r.lang_pred == "und"} == letterless
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r.score for r in quality.classify(odd_docs, none, fold(5, 0)).collect()} == {0.5}
    blank = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(blank, fold(4, 2)).collect()} == {"und"}
    for df in (quality.classify(odd.empty(spark), labels, fold(5, 0)), language.identify(odd.empty(spark), fold(4, 2)),
               quality.keep_good(odd.empty(spark), labels, fold(5, 0)), pii.report(odd.empty(spark)), pii.mask(odd.empty(spark))):
        assert df.count() == 0
    assert quality.keep_good(odd_docs, labels, fold(5, 0)).columns == odd_docs.columns


def test_gradients():
    t = pii.Tagger(5)
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}
    r = np.random.default_rng(0)
    ids, tags = r.integers(0, 99, (3, 9)), r.integers(0, pii.TAGS, (3, 9))
    _, g = t.loss(ids, tags)
    for k in t.p:
        flat, grad = t.p[k].reshape(-1), np.asarray(g[k]).reshape(-1)
        j = int(np.abs(grad).argmax())
        was, out = flat[j], []
        for e in (1e-3, -1e-3):
            flat[j] = was + e
            out.append(t.loss(ids, tags)[0])
        flat[j] = was
        assert abs((out[0] - out[1]) / 2e-3 - grad[j]) < 1e-4 + 1e-3 * abs(grad[j]), k


def test_tagger_finds_what_it_learned(spark, odd_docs):
    docs = table(spark, "documents")
    tagger = pii.learn(docs)
    hit = total = 0
    for r in docs.where("text rlike '[0-9@]'").collect():
        base = set(pii.base_spans(r.text))
        hit += len(base & set(pii.add_spans(tagger, [r.text], [[]])[0]))
        total += len(base)
    assert total > 50 and hit / total > 0.9
    masked = {r.doc_id: r for r in pii.mask(odd_docs).where("doc_id = 15").collect()}[15]
    assert masked.text.startswith("mail me: [email], [phone] or [ip], card [card].") and masked.n_chars == len(masked.text)
    assert pii.mask(odd_docs).columns == odd_docs.columns


def test_windows_cover_every_hint_and_edges_agree():
    text = "a" * 1000 + "1" + "b" * 70 + "@" + "c" * 3
    starts = pii.window_starts(text)
    for p in (1000, 1071):
        assert any(s <= p < s + pii.LENGTH for s in starts)
    assert pii.read_spans({5: 1, 6: 2, 7: 2, 8: 3, 9: 0, 12: 2}) == [(0, 5, 8), (1, 8, 9), (0, 12, 13)]


def test_binomial_tail(spark):
    def exact(k, n, p):
        return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))

    cases = [(0, 40, 0.05), (1, 100, 0.05), (7, 400, 0.05), (40, 2000, 0.05)]
    for k, n, p in cases:
        got = spark.range(1).select(rules.tail_probability(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
        assert abs(got - exact(k, n, p)) < 1e-9


def test_rules_bound_false_rejection(spark):
    """Good documents with small shares, bad ones with large: bad ones go, and few good ones do."""
    good = [(i, " ".join(f"w{i}x{j}" for j in range(60)), "en", 1) for i in range(1500)]
    bad = [(5000 + i, " ".join(f"w{i}x{j}***" for j in range(60)), "en", 0) for i in range(100)]
    rows = spark.createDataFrame(good + bad, "doc_id bigint, text string, lang string, quality int").repartition(4)
    got = rules.judge(rows, rows.select("doc_id", "quality")).join(rows.select("doc_id", "quality"), "doc_id")
    kept = {r.quality: r.kept for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert kept[0] == 0 and kept[1] >= 1 - rules.RISK


def test_markov_tells_random_from_words(spark):
    docs = table(spark, "documents")
    more = spark.createDataFrame(
        [(10**6, "key q9XvT2mLr8ZkW4pB7nYs end", "en", "s", 1), (10**6 + 1, "internationalization_of_the_thing here", "en", "s", 1)], docs.schema)
    got = {r.doc_id: r for r in secrets.scan(docs.union(more)).where("n_random > 0 or doc_id >= 1000000").collect()}
    assert got[10**6].spans == "random:4:24" and got[10**6 + 1].spans == ""
    assert len(got) < 12


def test_secrets_against_a_plain_scan(spark):
    """Every span of crowded and of long texts, random ones included, as a plain loop finds them."""
    rng = random.Random(4)

    def token(n=40):
        return "".join(rng.choice("abcdefXYZ0189_-=+/") for _ in range(rng.randint(10, n)))

    def crowd(n):
        return "".join(rng.choice([token(), " ", "\n", f'password = "{token()}"', "AKIA" + token().upper(), "0123456789abcdef" * 2, "é日"]) for _ in range(n))

    texts = [crowd(rng.randint(1, 200)) for _ in range(40)] + [crowd(9000), "aB3x" * 50_000, None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(4)
    ratios = [float(f"{x:.6f}") for x in secrets.learn(docs)]
    size = len(secrets.ALPHABET)
    found = 0
    for r in secrets.scan(docs).collect():
        t = texts[r.doc_id] or ""
        base = odd.secret_spans(t)
        held = [tuple(map(int, x.split(":")[1:])) for x in base]
        taken = {p for s, e in held for p in range(s, e)}
        spans = [(int(x.split(":")[1]), secrets.KINDS.index(x.split(":")[0]), x) for x in base]
        for m in re.finditer(secrets.TOKEN, t):
            at = [secrets.ALPHABET.index(c) for c in m.group()]
            score = sum(ratios[x * size + y] for x, y in zip(at, at[1:]))
            if score >= secrets.MIN_RATIO and score >= secrets.MIN_STEP * (len(at) - 1) and taken.isdisjoint(range(*m.span())):
                spans.append((m.start(), 3, f"random:{m.start()}:{m.end()}"))
                found += 1
        assert r.spans == ",".join(x[2] for x in sorted(spans)), r.doc_id
        assert r.n_random == sum(x[1] == 3 for x in spans)
    assert found > 20


def test_mixing_meets_its_targets(spark, odd_docs):
    rows = [(i, "w " * 50, "en", "big" if i < 900 else f"small{i % 4}", 1) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    plan = mixing.schedule(docs, max_repeats=4.0, entropy=0.8).cache()
    share = {r.source: r.t for r in plan.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    weight = {r.source: r.weight for r in plan.select("source", "weight").distinct().collect()}
    total = 50_000
    sources = {r.source: r.t for r in mixing.count_tokens(docs).groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    assert abs(sum(weight.values()) - 1) < 1e-9
    for s, w in weight.items():
        assert share[s] <= w * total + 1 and share[s] >= w * total - 50  # whole rows only
        assert share[s] <= 4 * sources[s]
    spread = -sum(w * math.log(w) for w in weight.values()) / math.log(5)
    assert spread >= 0.8 - 1e-6 or max(share[s] / sources[s] for s in sources) > 3.9
    assert plan.groupBy("doc_id", "epoch").count().where("count > 1").count() == 0
    # passes before the last are whole
    whole = plan.groupBy("source", "epoch").count().groupBy("source").agg(F.max("epoch").alias("last")).collect()
    assert all(plan.where((F.col("source") == r.source) & (F.col("epoch") < r["last"])).count() % (900 if r.source == "big" else 25) == 0 for r in whole)
    mixed = mixing.mixed_documents(odd_docs)
    assert set(odd_docs.columns) < set(mixed.columns)
    assert mixing.schedule(odd.empty(spark)).count() == 0


def test_mixing_counts_equal_rows_and_null_sources(spark):
    """Fifty copies each of twenty rows, and a null source beside an empty one."""
    rows = [(i % 20, f"w{i % 20} " * 10, "en", "big", 1) for i in range(1000)]
    rows += [(2000 + i, "v " * 10, "en", None if i % 2 else "", 1) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    plan = mixing.schedule(docs, max_repeats=4.0, entropy=0.9)
    taken = {(r.doc_id, r.source): r["count"] for r in plan.groupBy("doc_id", "source").count().collect()}
    per_source = {r.source: r for r in plan.groupBy("source").agg(F.sum("tokens").alias("t"), F.first("weight").alias("w")).collect()}
    assert set(per_source) == {"big", None, ""}
    for s, r in per_source.items():
        quota = min(r.w * 10_200, 4 * sum(10 for x in rows if x[3] == s))
        assert quota - 10 <= r.t <= quota + 1e-6
    # every copy of a pass is taken once
    again = plan.groupBy("k1", "k2", "copy", "epoch").count().where("count > 1")
    assert again.count() == 0
    mixed = mixing.mixed_documents(docs, max_repeats=4.0, entropy=0.9)
    of_source = {r.source: r["count"] for r in mixed.groupBy("source").count().collect()}
    for s, r in per_source.items():
        assert abs(of_source[s] - r.t // 10) <= 1  # rows of ten tokens; hashes of whole rows cut elsewhere
    assert sum(taken.values()) == plan.count()
    # rows that differ only in another column are rows of their own
    two = spark.createDataFrame([(1, "a b", "en", "s", 1), (1, "a b", "de", "s", 1), (1, "a b", "de", "s", 1)], docs.schema)
    assert sorted(r.lang for r in mixing.mixed_documents(two).collect()) == ["de", "de", "en"]


def test_mixing_deals_many_copies(spark, monkeypatch):
    """Copies beyond a run are dealt in several; nothing is lost or taken twice."""
    monkeypatch.setattr(mixing, "RUN", 7)
    rows = [(1, "a b c", "en", "s", 1)] * 100 + [(2, "x y", "en", "t", 1)] * 7 + [(3, "z", "en", "t", 1)] * 8
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {(r.doc_id, r.copy) for r in mixing.count_tokens(docs).collect()}
    assert got == {(1, i) for i in range(100)} | {(2, i) for i in range(7)} | {(3, i) for i in range(8)}


def test_pipeline_against_its_parts(spark, tmp_path):
    """Every stage takes what the one before kept, and decides as a plain version does."""
    sf = "/root/testdata/sf0.001"
    docs = table(spark, "documents", sf)
    names = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        before, now = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.text for r in after.collect()}
        assert set(now) <= set(before)
        if i < 4:
            assert after.columns == names
        if name == "quality":
            scores = quality.classify(docs, table(spark, "labels", sf), fold(5, 0))
            assert set(now) == {r.doc_id for r in scores.where("predicted = 1").collect()}
        if name == "near_duplicates":
            assert set(now) == {c for _, _, c in odd.components(sorted(before.items()))}
        if name == "decontamination":
            items = [tuple(r) for r in table(spark, "benchmark", sf).select("item_id", "text").collect()]
            assert set(now) == {r[0] for r in odd.contamination(before.items(), items) if r[2] == 0}
        if name == "personal_data":
            assert set(now) == set(before) and not any(pii.base_spans(t) for t in now.values())
            assert all(now[d] == t for d, t in before.items() if not any(c in "0123456789@" for c in t))
        if name == "mixture":
            assert set(after.columns) == {*names, "mix_epoch", "mix_block", "mix_place"}
        docs = after
    got = corpus_pipeline.run(spark, sf)
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in docs.collect())
