"""The pipeline's stages in turn, each against what its operator says of its own input."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from memspool.llm import op06_toxicity, op07_simhash, op09_mix, op10_decontam

from .test_exact import plain_tokens, texts


def near_groups(rows):
    """The smallest id of each document's group, from all pairs of sets of five-word shingles."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    at = [i for i, _ in rows]
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if at[i] != at[j] and len(x & y) >= 0.8 * len(x | y):
                a, b = sorted((at[i], at[j]))
                at = [a if v == b else v for v in at]
    return {i: g for (i, _), g in zip(rows, at)}


def test_stages(spark, sf_dir, tables, tmp_path):
    names = tables["documents"].columns
    docs, at = tables["documents"], {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        at[name] = docs
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == names
            at[name + "_out"] = docs

    def ids(df):
        return Counter(r["doc_id"] for r in df.select("doc_id").collect())

    scores = op06_toxicity.classify_toxicity(at["toxicity"], tables["labels"])
    assert ids(at["toxicity_out"]) == ids(scores.where("predicted = 0"))
    # five words at a similarity of 0.8: of each group by brute force the smallest id
    groups = near_groups(texts(at["near_dedup"]))
    assert ids(at["near_dedup_out"]) == Counter(dict.fromkeys(groups.values(), 1)) and len(set(groups.values())) < len(groups)
    same = op07_simhash.near_duplicates(at["near_dedup"], words=5, similarity=0.8)
    assert {r["doc_id"]: r["component_id"] for r in same.collect()} == groups
    leaks = op10_decontam.find_leaks(at["decontaminate"], tables["benchmark"]).select("doc_id").distinct()
    assert ids(at["decontaminate_out"]) == ids(at["decontaminate"].join(leaks, "doc_id", "left_anti")) and leaks.count() > 0
    taken = op09_mix.mix_report(at["mix"]).where("copies > 0").collect()
    assert ids(at["mix_out"]) == Counter({r["doc_id"]: r["copies"] for r in taken})
    want = Counter((i, len(plain_tokens([(i, t)])[i, t])) for i, t in texts(at["tokens"]))
    assert Counter((r["doc_id"], r["n_tokens"]) for r in docs.collect()) == want
    again = corpus_pipeline.run(spark, sf_dir)
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, docs.collect()))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_documents(spark, sf_dir, nasty, nothing, name):
    """Nulls, empty and very long texts, repeated rows and ids, clashing columns, no rows."""
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, nasty, sf_dir)
    rows = texts(nasty)
    if name == "tokens":
        assert Counter((r["doc_id"], r["n_tokens"]) for r in got.collect()) == Counter((i, len(plain_tokens([(i, t)])[i, t])) for i, t in rows)
    else:
        assert got.columns == nasty.columns
        kept = Counter(texts(got))
        if name in ("toxicity", "decontaminate"):  # none of them is toxic or holds an item
            assert kept == Counter(rows)
        elif name == "near_dedup":
            groups = {}
            for k, (i, t) in enumerate(rows):
                groups.setdefault(near_groups([(n, x) for n, (_, x) in enumerate(rows)])[k], []).append((i, t))
            assert len(kept) == kept.total() == len(groups)
            for members in groups.values():
                least = min((i for i, _ in members if i is not None), default=None)
                assert sum(x in kept for x in set(members)) == 1 and any((least, t) in kept for _, t in members)
        else:
            assert all(n <= 2 * Counter(rows)[x] for x, n in kept.items()) and kept.total() > 0
    assert stage(spark, nothing, sf_dir).count() == 0
