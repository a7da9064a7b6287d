"""Quality, language and toxicity: held-out accuracy, and parts of them against plain versions."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from memspool.llm import op01_quality as Q
from memspool.llm import op05_language as L
from memspool.llm import op06_toxicity as X

from .conftest import prose

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def medium(spark):
    return {t: spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels")}


def test_quality_on_held_out_rows(medium):
    got = Q.classify_quality(medium["documents"], medium["labels"])
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(medium["labels"], "doc_id").where("held_out").select("quality", "predicted", "score").collect()
    assert len(rows) > 60 and sum(r["quality"] == r["predicted"] for r in rows) >= 0.94 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_ftrl_equals_a_plain_version():
    rng, p = np.random.default_rng(0), Q.QualityParams(buckets=16, epochs=2, l1=0.01)
    rows = [(np.sort(rng.choice(16, 5, replace=False)).astype(np.int32), rng.random(5).astype(np.float32), int(rng.integers(2))) for _ in range(40)]
    z, n, w = [0.0] * 17, [0.0] * 17, [0.0] * 17

    def weight(i):
        return 0.0 if abs(z[i]) <= p.l1 else -(z[i] - np.sign(z[i]) * p.l1) / ((p.beta + n[i] ** 0.5) / p.alpha + p.l2)

    for k, v, y in rows * p.epochs:
        at, x = [*k.tolist(), 16], [*v.tolist(), 1.0]
        w = [weight(i) for i in at]
        err = 1 / (1 + np.exp(-sum(a * b for a, b in zip(w, x)))) - y
        for i, xi, wi in zip(at, x, w):
            g = err * xi
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / p.alpha * wi
            n[i] += g * g
    m = Q.fit_ftrl(rows, p)
    assert np.allclose(m.dense(), [weight(i) for i in range(16)], atol=1e-4) and abs(m.bias - weight(16)) < 1e-4


def test_quality_defined_cases(nasty, nothing, labels):
    got = Q.classify_quality(nasty, labels).collect()
    assert len(got) == nasty.count()
    blank = {r["score"] for r in got if r["doc_id"] in (1, 2, 3)}
    assert len(blank) == 1
    assert {r["held_out"] for r in got if r["doc_id"] == 4} == {zlib.crc32(b"4") % 4 == 2}
    assert {r["score"] for r in Q.classify_quality(nasty, labels.limit(0)).collect()} == {0.5}
    assert Q.classify_quality(nothing, labels).count() == 0


def test_language_on_held_out_rows(medium):
    docs = medium["documents"]
    p = L.LanguageParams(steps=150)
    got = L.identify_languages(docs, p).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 200 and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.96 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_gru_gradients_equal_differences():
    rng = np.random.default_rng(1)
    d = L.Direction(rng.normal(0, 0.5, (6, 256)), rng.normal(0, 0.5, (6, 2)))
    codes, target = rng.integers(0, 4, (5, 3)).astype(np.uint8), rng.normal(size=(5, 2, 3))

    def loss(table, recurrent):
        """Step by step, for one window at a time."""
        total = 0.0
        for b in range(3):
            h = np.zeros(2)
            for t in range(5):
                x, r = table[:, codes[t, b]], recurrent @ h
                s = 1 / (1 + np.exp(-(x[:4] + r[:4])))
                c = np.tanh(x[4:] + s[2:] * r[4:])
                h = (1 - s[:2]) * c + s[:2] * h
                total += float(h @ target[t, :, b])
        return total

    kept = []
    out = L.forward(d, codes, kept)
    assert abs(float((out * target).sum()) - loss(d.table, d.recurrent)) < 1e-5
    g_table, g_recurrent = L.backward(d, codes, kept, target)
    for array, grad, which in ((d.table, g_table, 0), (d.recurrent, g_recurrent, 1)):
        for i, j in itertools.product(range(array.shape[0]), range(min(4, array.shape[1]))):
            more, less = array.copy(), array.copy()
            more[i, j] += 1e-5
            less[i, j] -= 1e-5
            args = lambda x: (x, d.recurrent) if which == 0 else (d.table, x)
            assert abs((loss(*args(more)) - loss(*args(less))) / 2e-5 - grad[i, j]) < 1e-3


def test_language_pools_whole_texts():
    rng = random.Random(0)
    texts = {"aa": ["".join(rng.choice("abc ") for _ in range(200)) for _ in range(30)], "zz": ["".join(rng.choice("xyz ") for _ in range(200)) for _ in range(30)]}
    p = L.LanguageParams(hidden=4, steps=60, batch=32, slab=3)
    m = L.fit([t.encode() for v in texts.values() for t in v], [k for k, v in texts.items() for _ in v], p)
    long = ("abc " * 16 * 3 + "xyz " * 16).encode()  # three windows to one
    got, votes = m.pooled([long, b"ab", b""])
    each = m.positions(np.frombuffer(long, np.uint8).reshape(4, 64).T.copy())
    assert np.allclose(got[0], each.sum((0, 2)) / len(long), atol=1e-5) and got[0].argmax() == 0 and abs(votes[0, 0] - 0.75) < 0.1
    assert got[1].argmax() == 0 and got[2].sum() == 0


def test_language_defined_cases(nasty, nothing):
    got = L.identify_languages(nasty, L.LanguageParams(steps=5)).collect()
    assert len(got) == nasty.count()
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3, 8)} == {"und"} and all(r["lang_pred"] != "und" for r in got if r["doc_id"] in (4, 7, 9))
    assert {r["lang_pred"] for r in L.identify_languages(nasty.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert L.identify_languages(nothing).count() == 0


def test_toxicity_on_held_out_rows(spark):
    d = {t: spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels")}
    docs = d["documents"].join(d["labels"].select("doc_id"), "doc_id", "left_semi")
    rows = X.classify_toxicity(docs, d["labels"]).join(d["labels"], "doc_id").where("held_out").collect()
    bad = [r for r in rows if r["toxic"]]
    assert sum(r["predicted"] for r in bad) >= 0.85 * len(bad)
    assert sum(r["predicted"] for r in rows if not r["toxic"]) <= 0.01 * len(rows)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, above = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(3)
    terms = [X.Term("abcab", False, 3.0, 1), X.Term("bcabcabca", False, 2.0, 2), X.Term("cc", False, 1.5, 0), X.Term("acb", True, 1.0), X.Term("bbacb", True, 0.9, 1)]
    automaton = X.LexiconAutomaton(terms)
    for _ in range(6000):
        w = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 12)))
        hits = [(edits(w, t.text), -t.weight, k) for k, t in enumerate(terms) if not t.stem and edits(w, t.text) <= t.edits]
        # of stems, by edits and then the one that ends last
        begun = [(e, -n, -t.weight, k) for k, t in enumerate(terms) if t.stem for n in range(len(w)) if (e := edits(w[:n], t.text)) <= t.edits]
        ranks = [(min(hits)[0], 0, min(hits)[2])] if hits else []
        ranks += [(min(begun)[0], 1, min(begun)[3])] if begun else []
        # exact term, exact stem, misspelled term, misspelled stem
        best = min(ranks, key=lambda r: ((0, r[1]) if r[0] == 0 else (1, r[1])), default=None)
        assert automaton.match(w) == (best and (best[2], best[0])), w


def test_spans_hold_their_places_where_lower_case_is_longer():
    m = X.fit([(prose(i, 30) + (" you are a blockhead" if i % 2 else " you are a friend"), i % 2) for i in range(80)])
    s = X.ToxicityScorer(m)
    text = "İİİ Blockhead İ BLOCKHEAD"
    assert [text[a:b] for a, b, *_ in s.spans(text)] == ["Blockhead", "BLOCKHEAD"] and s.strength(text) == s.strength("blockhead")


def test_samples_take_all_rows_up_to_their_bound(spark):
    from memspool.llm.common import training_sample

    rows = spark.range(3000).selectExpr("id", "case when id % 10 = 0 then 'rare' else 'often' end g").repartition(7)
    got = training_sample(rows, "g", "id", 400, ["id", "g"]).collect()
    assert sum(r["g"] == "rare" for r in got) == 300 and sum(r["g"] == "often" for r in got) == 400
    assert sorted(got) == sorted(training_sample(rows.coalesce(1), "g", "id", 400, ["id", "g"]).collect())
    h = {r["id"]: r["h"] & (1 << 64) - 1 for r in rows.selectExpr("id", "xxhash64('sample', id) h").collect()}
    often = sorted((h[i], i) for i in range(3000) if i % 10)
    assert {r["id"] for r in got if r["g"] == "often"} == {i for _, i in often[:400]}
    assert training_sample(rows.limit(0), "g", "id", 5, ["id"]).count() == 0
    assert training_sample(rows.withColumn("id", rows["id"] % 3), "g", "id", 400, ["g", "id"]).count() <= 700


def test_context_tells_quotation_from_abuse():
    rows = [(prose(i, 30) + (" you are a blockhead" if i % 2 else " you are a friend"), i % 2) for i in range(80)]
    m = X.fit(rows)
    assert [t.text for t in m.terms] == ["blockhead"] and m.terms[0].edits == 2
    s = X.ToxicityScorer(m)
    plain, misspelled = s.score("what a blockhead that is"), s.score("what a blokchead that is")
    quoted, reported, none = s.score('she wrote "blockhead" there'), s.score("the word blockhead is old"), s.score("nothing here")
    assert plain > misspelled > reported > none and plain > quoted > none and misspelled >= 0.5 > quoted
    assert s.spans("a Blockhead!")[0][:3] == (2, 11, 0)


@pytest.mark.parametrize("marks", ['""', "“”", "„“", "„”", "«»", "»«"])
def test_quotations_of_any_length(marks):
    a, b = marks
    long = prose(9, 60)
    assert X.quotations(f"x {a}{long}{b} y {a}z{b}.") == [(2, 4 + len(long)), (7 + len(long), 10 + len(long))]
    assert X.quotations(f"x {a}{long}\n\n{long} {a}z{b}") == [(6 + 2 * len(long), 9 + 2 * len(long))]
    assert X.quotations(f"x {a}{long}") == []
    rows = [(prose(i, 30) + (" you are a blockhead" if i % 2 else " you are a friend"), i % 2) for i in range(80)]
    s = X.ToxicityScorer(X.fit(rows))
    full, less = s.spans("a blockhead")[0][4], s.spans(f"a {a}blockhead{b}")[0][4]
    assert less < full
    # inside of a long quotation; behind a long one, with another one following
    assert s.spans(f"He went: {a}{long} blockhead {long}{b} and on")[0][4] == less
    assert s.spans(f"He went: {a}{long}{b} you blockhead and {a}so on{b} too")[0][4] == full


def test_straight_marks_that_stand_alone():
    assert X.quotations('a 5" pipe and a 6" one') == []
    assert X.quotations('he said "one and "two" more') == [(17, 22)]
    assert X.quotations('("in brackets"), "b"') == [(1, 14), (17, 20)]


def test_toxicity_defined_cases(nasty, nothing, labels):
    got = X.classify_toxicity(nasty, labels).collect()
    assert len(got) == nasty.count() and len({r["score"] for r in got if r["doc_id"] in (1, 2, 3)}) == 1
    assert all(r["predicted"] == 0 for r in X.classify_toxicity(nasty, labels.limit(0)).collect())
    assert X.classify_toxicity(nothing, labels).count() == 0
    kept = X.drop_toxic(nasty, labels.limit(0))
    assert kept.columns == nasty.columns and kept.count() == nasty.count()
