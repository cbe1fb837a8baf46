"""Operators with exact results: SQL twins on the tables, plain versions on odd documents."""

import hashlib
import random

import odd
import pytest
from compare import compare, duck
from pyspark.sql import functions as F

from codeloom.llm import chat, decontaminate, jaccard, pii, rules, secrets, suffix_levels
from codeloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_twin(spark, name):
    verdict, _, _, detail = compare(spark, duck(SF), name, QUERIES[name].plan, QUERIES[name].sql, SF)
    assert verdict == "same", detail


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def by_key(rows):
    return sorted(map(str, rows))


def test_decontamination(spark, odd_docs):
    texts = odd.texts()
    items = [(1, " ".join(odd.plain_words(texts[12])[3:18])), (2, "Two words"), (3, "one"), (4, None), (5, "..."), (None, texts[8]),
             (6, texts[13]), (7, texts[13]), (1, "a a a a a a a a a a a a")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = [tuple(r)[:5] for r in decontaminate.report(odd_docs, bench).collect()]
    want = odd.contamination(pairs(odd_docs), [x for x in items if x[0] is not None])
    assert by_key(got) == by_key(want)
    kept = decontaminate.remove_contaminated(odd_docs, bench)
    assert kept.columns == odd_docs.columns
    assert kept.count() == sum(w[2] == 0 for w in want)


def test_decontamination_of_nothing(spark, odd_docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.report(odd.empty(spark), none).count() == 0
    assert decontaminate.report(odd_docs, none).where("contaminated").count() == 0
    assert decontaminate.remove_contaminated(odd_docs, none).count() == odd_docs.count()


def near_copies(spark):
    """A group of forty near copies, where links form chains, and texts that share a passage only."""
    import random

    rng = random.Random(11)
    base = odd.words_of(rng, 200, 9000).split(" ")
    out = []
    for i in range(40):
        base = [*base]
        base[rng.randrange(200)] = f"edit{i}"
        out.append(" ".join(base))
    passage = odd.words_of(rng, 30, 9000)
    out += [passage + " " + odd.words_of(rng, n, 9000) for n in (5, 6, 7, 8, 40, 41, 400)]
    return odd.documents(spark, out)


@pytest.mark.parametrize("block", [400_000, 300])
def test_jaccard(spark, monkeypatch, block):
    """With small blocks, groups are split into tiles."""
    monkeypatch.setattr(jaccard, "ARRAY_BLOCK", block)
    monkeypatch.setattr(jaccard, "SIGNED_BLOCK", block)
    docs = near_copies(spark)
    want = odd.components(pairs(docs))
    assert by_key(tuple(r) for r in jaccard.report(docs).collect()) == by_key(want)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(rows) == len(set(rows))
    assert {i for i, _ in rows if i is not None} == {c for i, _, c in want if i is not None}


def test_one_of_each_group_stays(spark):
    """Also where a group has no id at all, or several alike texts under the id that names it."""
    rng = random.Random(21)

    def group():
        w = odd.words_of(rng, 120, 9000).split(" ")
        return [" ".join([*w[:20 * i], f"edit{i}", *w[20 * i:]]) for i in range(5)]

    lost, named, mixed, lone = group(), group(), group(), odd.words_of(rng, 60, 9000)
    rows = [(None, t) for t in [*lost, lost[0]]] + [(3, t) for t in [*named, lone]] + [(4, named[0])]
    rows += [(None, mixed[0]), (8, mixed[1]), (9, mixed[2]), (9, None), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = [tuple(r) for r in jaccard.keep_one(docs).collect()]
    assert sum(t in lost for _, t in kept) == 1
    assert [i for i, t in kept if t in named] == [3] and (3, lone) in kept
    assert [i for i, t in kept if t in mixed] == [8]
    assert (None, None) in kept and (None, "") in kept and len(kept) == 6
    assert all(r in rows for r in kept)
    without = docs.where("doc_id is null")
    assert sum(r.text in lost for r in jaccard.keep_one(without).collect()) == 1


def test_jaccard_of_nothing(spark):
    assert jaccard.report(odd.empty(spark)).count() == 0
    assert jaccard.keep_one(odd.empty(spark)).count() == 0


@pytest.mark.parametrize("crowd", [20_000, 1])
def test_repeats(spark, monkeypatch, crowd):
    """With a crowd of one, the ends of passages are compared as rows."""
    monkeypatch.setattr(suffix_levels, "CROWD", crowd)
    t = odd.texts()
    extra = [t[7][500:3000] + "!" + t[7][100:900], "y" + t[7][500:3000], t[7][600:705], t[7][600:699], t[12][:100], "ab" * 300 + t[9][10:200]]
    docs = odd.documents(spark, extra)
    unique = [r for r in pairs(docs) if r[0] is not None and r != (7, "another text of an id that is there already")]
    got = [tuple(r) for r in suffix_levels.report(docs, batches=3).collect()]
    assert len(got) == docs.count()
    want = odd.repeats(sorted(unique, key=lambda r: r[0]))
    assert not set(map(str, want)) - set(map(str, got))


@pytest.mark.parametrize("crowd", [20_000, 1])
def test_repeats_under_one_id(spark, monkeypatch, crowd):
    """Texts without id and of one id whose hashes agree in their low 17 bits keep their own ranges."""
    monkeypatch.setattr(suffix_levels, "CROWD", crowd)
    passage = odd.words_of(random.Random(4), 40, 9000)
    made = [" ".join([f"n{i}", odd.words_of(random.Random(i), 8 + i % 5 * 30, 9000), *[passage[i % 9:]] * (i % 3)]) for i in range(1500)]
    rows = spark.createDataFrame([(t,) for t in made], "text string").select("text", F.xxhash64("text").alias("h")).collect()
    tags = {}
    for r in rows:
        tags.setdefault(r.h & (1 << 17) - 1, []).append(r)
    clash = [r for same in tags.values() if len(same) > 1 for r in same]
    assert len(clash) > 8
    kept = [(i, r.text, r.h) for i in (None, 5, -(1 << 63)) for r in clash] + [(2, odd.texts()[12], 0), (9, passage, 0), (None, None, 42)]
    docs = spark.createDataFrame([k[:2] for k in kept] + [(5, clash[0].text), (None, clash[1].text)], "doc_id bigint, text string")
    assert docs.count() == len(kept) + 2
    # the smallest id ties with rows without one, where equal texts are one document
    want = odd.repeats([(i, t) for i, t, _ in sorted(kept, key=lambda k: (-(1 << 63) if k[0] is None else k[0], k[2])) if i != -(1 << 63)])
    got = [tuple(r) for r in suffix_levels.report(docs, batches=3).collect()]
    assert len(got) == docs.count()
    assert set(map(str, got)) == set(map(str, want)) | {str((-(1 << 63), *w[1:])) for w in want if w[0] is None and w[1]}


def test_repeats_of_nothing(spark):
    assert suffix_levels.report(odd.empty(spark)).count() == 0


def test_chat_reads_back(spark):
    rows = [(1, 0, "system", "be <|kind|>"), (1, 1, "ann", "a\\<|end|>\n"), (1, 2, "bob", None), (1, 3, None, "x"), (1, 3, "ann", "é🙂"),
            (2, None, "ann", "first"), (2, 0, "ann", "second"), (2, 0, "ann", "second"), (None, 0, "ann", "lost"), (3, 0, "system", "alone")]
    conv = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id bigint, turn bigint, role string, text string, speaker string")
    for segment in (256, 2):
        got = chat.rotate(conv, segment=segment).orderBy("conv_id", "speaker", "segment").collect()
        speakers = {(r.conv_id, r.speaker) for r in got}
        assert speakers == {(1, "ann"), (1, "bob"), (1, "unknown"), (2, "ann")}
        for c, who in speakers:
            parts = [r for r in got if (r.conv_id, r.speaker) == (c, who)]
            said = []
            for r in parts:
                for m in filter(None, r.mask.split(",")):
                    a, b = map(int, m.split(":"))
                    assert r.text[a:b].endswith("<|end|>\n") and r.text[:a].endswith("<|assistant|>\n")
                    body = r.text[a:b - len("<|end|>\n")]
                    said.append(body.replace("<\\|", "<|").replace("\\\\", "\\"))
            want = [(t if t is not None else -1, x or "") for q, t, role, x in rows if q == c and (role or "unknown") == who]
            assert said == [x for _, x in sorted(want)]
            assert sum(r.n_turns for r in parts) == sum(q == c for q, *_ in rows)
    assert chat.rotate(conv.limit(0)).count() == 0


def test_rule_counts(odd_docs, labels, spark):
    got = rules.judge(odd_docs, labels).collect()
    assert by_key((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == by_key(
        (i, *odd.rule_counts(t)) for i, t in pairs(odd_docs))
    assert all(r.kept == (not r.base_failed) for r in got)  # too few labels to reject more
    assert rules.judge(odd.empty(spark), labels.limit(0)).count() == 0


def test_secret_spans(odd_docs, spark):
    got = secrets.scan(odd_docs).collect()
    want = [(i, odd.secret_spans(t)) for i, t in pairs(odd_docs)]
    assert by_key((r.doc_id, r.base_sha256) for r in got) == by_key((i, hashlib.sha256(",".join(s).encode()).hexdigest()) for i, s in want)
    for r in got:
        assert r.n_assign + r.n_access + r.n_hex + r.n_random == len([x for x in r.spans.split(",") if x])
    assert secrets.scan(odd.empty(spark)).count() == 0


def test_base_patterns():
    import random
    import re

    plain = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
             r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]

    def slow(t):
        for k, p in enumerate(plain):
            for m in re.finditer(p, t):
                digits = re.sub("[^0-9]", "", m.group())
                if k == 0 or (k == 1 and all(int(x) <= 255 for x in m.group().split("."))) or (
                        k == 2 and 13 <= len(digits) <= 19 and pii._luhn(digits)) or (k == 3 and 9 <= len(digits) <= 15):
                    yield k, m.start(), m.end()

    rng = random.Random(2)
    for _ in range(20_000):
        t = "".join(rng.choice("014a.@+- (é\n") for _ in range(rng.randint(0, 40)))
        assert list(slow(t)) == pii.base_spans(t), t
    assert pii.base_spans("x" * 200_000 + "@" + "9" * 200_000) == []  # linear, however odd
