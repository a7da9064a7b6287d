"""Work that was once cut short by a cap or a threshold."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from memspool.llm import near_copies
from memspool.llm import op04_lines as N
from memspool.llm.common import batches_of, map_batches
from memspool.llm.op07_simhash import majority_bits, shingles

from .conftest import DOCS, doc_rows, prose
from .test_exact import plain_lines, texts


def test_a_hot_template_is_whole_at_every_size(spark):
    """More distinct lines in one leaf than a task groups at once, which differ early and late."""
    rows = [(i, f"Posted here by {prose(i, 1)}{chr(97 + i % 26)} among all of the old {prose(5000 + i, 1)} at the house", "en", "s") for i in range(2600)]
    lines = {r[1] for r in rows}
    assert len(lines) > 2000
    got = N.drop_recurring(spark.createDataFrame(doc_rows(rows), DOCS), counts=True)
    assert got.where("n_dropped = 1").count() == len(rows) - 1


@pytest.mark.parametrize("block", [3, 20])
def test_leaves_in_rounds_equal_plain_templates(spark, block):
    rng = random.Random(block)
    rows = []
    for i in range(60):
        lines = [" ".join(["Same", "first", "words"] + [rng.choice(["p", "q", "7"]) for _ in range(7)]) for _ in range(3)]
        rows.append((i, "\n".join(lines), "en", "s"))
    docs = spark.createDataFrame(doc_rows(rows), DOCS)
    p = N.TemplateParams(block=block)
    want = plain_lines(texts(docs), p)
    got = Counter((r["doc_id"], r["was"], r["text"]) for r in N.drop_recurring(docs.withColumn("was", F.col("text")), p).collect())
    assert got == Counter({(i, t, x): 1 for (i, t), x in want.items()})
    assert any(t != x for (_, t), x in want.items())


def test_long_lines_of_two_documents_go_from_the_second(spark):
    shared = prose(77, 60)
    rows = [(i, prose(i, 40) + "\n" + (shared if i in (3, 8) else prose(100 + i, 60)), "en", "s") for i in range(12)]
    got = N.drop_recurring(spark.createDataFrame(doc_rows(rows), DOCS), counts=True).where("n_dropped > 0").collect()
    assert [(r["doc_id"], r["n_dropped"], r["text"]) for r in got] == [(8, 1, prose(8, 40))]


def jaccard(a, b, k=5):
    x, y = ({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if (w := (t or "").lower().split()) else set() for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def near_rows():
    """Copies with one to eight words of 200 changed, a chain, a large group, and prose."""
    rows = [(i, prose(i, 200), "en", "s") for i in range(20)]
    for i in range(20):
        w = prose(i, 200).split()
        for n in range(i % 8 + 1):
            w[20 + 22 * n] = "edited"
        rows.append((100 + i, " ".join(w), "en", "s"))
    base = prose(50, 150).split()
    rows += [(200 + k, " ".join(["Other"] * k + base[k:]), "en", "s") for k in range(0, 90, 6)]
    rng = random.Random(3)
    hot = prose(60, 100).split()
    for k in range(60):
        w = list(hot)
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(100)] = f"x{k}"
        rows.append((300 + k, " ".join(w), "en", "s"))
    return rows


@pytest.mark.parametrize(("source", "few", "block"), [("near", 1024, 1 << 18), ("near", 4, 400), ("documents", 1024, 1 << 18), ("nasty", 1024, 1 << 18)])
def test_near_copies_equal_brute_force(request, tables, spark, source, few, block):
    if source == "near":
        docs = spark.createDataFrame(doc_rows(near_rows()), DOCS)
    else:
        docs = tables["documents"] if source == "documents" else request.getfixturevalue("nasty")
    rows = texts(docs)
    group = {t: t for _, t in rows}
    names = list(group)
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := re.findall(r"[^\x20\x09-\x0D]+", plain_lower(t or ""))) else set() for t in names]
    at = list(range(len(names)))
    for i in range(len(names)):
        for j in range(i):
            both = len(sets[i] | sets[j])
            if at[i] != at[j] and (not both or len(sets[i] & sets[j]) >= 0.8 * both):
                at = [at[j] if x == at[i] else x for x in at]
    group = dict(zip(names, at))
    least = {}
    for i, t in rows:
        if i is not None:
            least[group[t]] = min(least.get(group[t], i), i)
    got = Counter((r["doc_id"], r["component_id"]) for r in near_copies.near_copies(docs, few=few, block=block).collect())
    assert got == Counter((i, least.get(group[t])) for i, t in rows)


@pytest.mark.parametrize(("most", "few"), [(4096, 1024), (8, 1024), (8, 2)])
def test_near_copies_come_from_the_popcount_grid(spark, most, few):
    """Without MinHash, sets are linked that the grid pairs: a half of a fingerprint within distance 1, up to 12 bits; in dense cells at least those within 3 bits."""
    rows = near_rows()
    sets = [np.unique(shingles(t.encode(), 5)) for _, t, _, _ in rows]
    codes = np.array([near_copies.prints(s) for s in sets], np.int64).view(np.uint64)
    assert codes.shape == (len(rows), 4) and (codes[:, 0].view(np.int64) == [majority_bits(s) for s in sets]).all() and all(len({*c}) == 4 for c in codes.tolist())
    counts = np.unpackbits(codes.view(np.uint8).reshape(len(rows), 4, 8), axis=2, bitorder="little").reshape(len(rows), 4, 2, 16, 2).sum(4).astype(int)
    wide, close, links = set(), set(), set()
    for i, x in enumerate(rows):
        for j, y in enumerate(rows[:i]):
            bits = np.bitwise_count(codes[i] ^ codes[j])
            half = np.abs(counts[i] - counts[j]).sum(2).min(1)
            assert not ((bits <= 3) & (half > 1)).any()
            if ((half <= 1) & (bits <= 12)).any():
                wide.add((j, i))
            if (bits <= 3).any():
                close.add((j, i))
            if jaccard(x[1], y[1]) >= 0.8:
                links.add((j, i))

    def groups(pairs):
        at = list(range(len(rows)))
        for i, j in pairs:
            if at[i] != at[j]:
                at = [min(at[i], at[j]) if x in (at[i], at[j]) else x for x in at]
        return {x[0]: min(rows[k][0] for k in range(len(rows)) if at[k] == at[i]) for i, x in enumerate(rows)}

    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(spark.createDataFrame(doc_rows(rows), DOCS), few=few, most=most, minhash=False).collect()}
    assert len(close & links) > 3 and len(set(groups(wide & links).values())) < len(set(groups(close & links).values())) < len(rows)
    if most > 1000:
        assert got == groups(wide & links)
    # what is close in any fingerprint hangs together, and nothing does without a link
    of = {i: got[r[0]] for i, r in enumerate(rows)}
    assert all(of[i] == of[j] for i, j in close & links)
    whole = groups(links)
    assert all(whole[i] == whole[g] for i, g in got.items())


def test_grid_of_near_copies_has_dense_cells(spark):
    """Each pair within 3 bits is listed or shares a dense cell."""
    sets = [np.unique(shingles(t.encode(), 5)) for _, t, _, _ in near_rows()]
    codes = [near_copies.prints(s) for s in sets]
    fps = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "fp long, prints array<long>")
    rows, dense = near_copies.grid_rows(fps, 8)
    pairs = near_copies.grid_pairs(rows, spark.createDataFrame([], "node long, component long"))
    cells = {}
    for r in dense.collect():
        cells.setdefault(r["fp"], set()).add(r["cell"])
    found = {(r["a"], r["b"]) for r in pairs.collect()}
    close = {(j, i) for i in range(len(codes)) for j in range(i) if any(((x ^ y) & (1 << 64) - 1).bit_count() <= 3 for x, y in zip(codes[i], codes[j]))}
    assert all((a, b) in found or cells[a] & cells[b] for a, b in close)
    assert any((a, b) not in found for a, b in close) and found


def test_strangers_in_cells_are_not_joined_to_what_is_known_of_sets(spark, monkeypatch):
    """Some forty sets in each cell: a table that is joined to facts of sets has a row for each set, not for each of its cells."""

    def strangers(hashes):
        h = int(hashes.min())
        low = (0, 0x55555555, 0xFFFFFFFF)[h % 3]
        return np.array([(h * (2 * i + 3) >> 16 & 0xFFFFFFFF) << 32 | low for i in range(4)], np.uint64).view(np.int64).tolist()

    seen = {}

    def noted(df, table, f=near_copies.materialize):
        out = f(df, table)
        if "Join LeftOuter" in df._jdf.queryExecution().optimizedPlan().toString():
            seen[table] = max(seen.get(table, 0), out.count())
        return out

    rows = [(i, prose(1000 + i, 60), "en", "s") for i in range(120)]
    rows += [(500 + i, rows[i][1] + " added", "en", "s") for i in range(10)]
    codes = [(i, strangers(np.unique(shingles(t.encode(), 5)))) for i, t, _, _ in rows]
    shared, dense = near_copies.grid_rows(spark.createDataFrame(codes, "fp long, prints array<long>"))
    assert dense is None and shared.count() >= 4 * len(rows)
    monkeypatch.setattr(near_copies, "prints", strangers)
    monkeypatch.setattr(near_copies, "materialize", noted)
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(spark.createDataFrame(doc_rows(rows), DOCS)).collect()}
    assert got == {i: i - 500 if i >= 500 else i for i, _, _, _ in rows}
    assert seen and max(seen.values()) <= len(rows)


def test_grid_leaves_pairs_that_share_a_known_key_to_the_keys(spark):
    fps = [(1, [5, 6], [70, 80]), (2, [5, 6], [80]), (3, [5, 6], None), (4, [5, 6], [90])]
    rows, dense = near_copies.grid_rows(spark.createDataFrame(fps, "fp long, prints array<long>, known array<long>"))
    pairs = near_copies.grid_pairs(rows)
    assert dense is None and sorted((r["a"], r["b"]) for r in pairs.collect()) == [(1, 3), (1, 4), (2, 3), (2, 4), (3, 4)]
    groups = spark.createDataFrame([(3, 1), (1, 1)], "node long, component long")
    assert sorted((r["a"], r["b"]) for r in near_copies.grid_pairs(rows, groups).collect()) == [(1, 4), (2, 3), (2, 4), (3, 4)]
    busy = spark.createDataFrame([(c, 1, c) for c in range(10, 16)] + [(10, 2, 10)], "cell long, fp long, n long")
    assert {r["fp"]: list(r["known"]) for r in near_copies.known_keys(busy).collect()} == {1: [15, 14, 13, 12], 2: [10]}


def plain_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def test_pipeline_drops_edited_near_copies(spark, sf_dir):
    """Two changed words of 200: Jaccard over 0.9 on five words, more than 3 bits of a SimHash apart."""
    rows = near_rows()[:40]
    near = [i for i in range(20) if jaccard(rows[i][1], rows[20 + i][1]) >= 0.8]
    assert len(near) > 5
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(doc_rows(rows), DOCS), sf_dir).collect()}
    assert kept == {r[0] for r in rows} - {100 + i for i in near}


def test_keys_of_similar_sets_meet():
    """At 0.8, sets of every size around the border share a key, by functions or by bins; unrelated ones don't."""
    rng, missed = np.random.default_rng(4), 0
    for n in [9, 60, 500, 511, 512, 560, 639, 640, 641, 700, 3000] * 20:
        x = rng.integers(0, 1 << 63, n + n // 8, np.uint64)
        a, b = np.unique(x[:n]), np.unique(x[n // 8 :])  # n - n // 8 of n + n // 8 are common: 0.78 and more
        missed += not set(near_copies.band_keys(a)) & set(near_copies.band_keys(b))
        assert not set(near_copies.band_keys(a)) & set(near_copies.band_keys(rng.integers(0, 1 << 63, n, np.uint64)))
    assert missed <= 1


def test_pairs_are_verified_without_batches_of_sets(spark):
    """A task holds one pair at a time, none of them in Python; at exactly 0.8 a pair is linked, just below it isn't."""
    rng = np.random.default_rng(7)
    hashes = rng.integers(-(1 << 63), 1 << 63, 60_000, np.int64)
    sets = {1: hashes[:9], 2: hashes[1:10], 3: hashes[2:11], 4: hashes[:20_000], 5: hashes[2_222:22_222], 6: hashes[2_223:22_223], 7: hashes[40_000:], 8: hashes[:1]}
    table = spark.createDataFrame([(k, np.sort(v).tolist()) for k, v in sets.items()], "fp long, items array<long>")
    pairs = [(a, b) for a in sets for b in sets if a < b]
    got = near_copies.verified(spark.createDataFrame(pairs, "a long, b long"), table, 0.8)
    want = {(a, b) for a, b in pairs if (n := len(set(sets[a]) & set(sets[b]))) >= 0.8 * (len(sets[a]) + len(sets[b]) - n)}
    assert want == {(1, 2), (2, 3), (4, 5), (5, 6)}
    assert sorted((r["a"], r["b"]) for r in got.collect()) == sorted(want)
    assert not re.search("Python|Arrow|Pandas", got._jdf.queryExecution().executedPlan().toString())


def test_texts_of_near_copies_come_in_small_batches(spark, nasty, monkeypatch):
    """By bytes, not by rows alone; the session's own setting is there again after."""
    name, seen = "spark.sql.execution.arrow.maxBytesPerBatch", {}
    before = spark.conf.get(name)

    def noted(df, table, f=near_copies.materialize):
        seen[table] = spark.conf.get(name)
        return f(df, table)

    monkeypatch.setattr(near_copies, "materialize", noted)
    near_copies.near_copies(nasty)
    assert {seen["near-docs"], seen["near-sets"]} == {str(near_copies.BATCH)} and spark.conf.get(name) == before
    rows = spark.range(3000, numPartitions=1).selectExpr("id", "repeat('word ', 200) AS t")

    def sizes(size):
        with batches_of(spark, size):
            sized = map_batches(rows, lambda b: pa.RecordBatch.from_arrays([pa.array([b.nbytes] * b.num_rows)], ["n"]), "n long")
            return [r["n"] for r in sized.collect()]

    assert len(sizes(64_000)) == len(sizes(1 << 30)) == 3000 and max(sizes(64_000)) < 130_000 < max(sizes(1 << 30))


def test_near_copies_of_nothing(nothing):
    assert near_copies.deduplicate(nothing).count() == 0


def test_short_lines_recur_too(spark):
    rows = [(i, f"{prose(i, 40)}\nRead more\n\nLes.\n{i} {i}\n{i}", "en", "s") for i in range(6)]
    got = {r["doc_id"]: r["text"] for r in N.drop_recurring(spark.createDataFrame(doc_rows(rows), DOCS)).collect()}
    assert got == {0: rows[0][1]} | {i: f"{prose(i, 40)}\n\n{i} {i}\n{i}" for i in range(1, 6)}
