"""Operators with one right answer, against brute force."""

import html
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from memspool.llm import op02_rules as R
from memspool.llm import op03_tokens as T
from memspool.llm import op04_lines as N
from memspool.llm import op07_simhash as S
from memspool.llm import op08_html as H
from memspool.llm import op09_mix as M
from memspool.llm import op10_decontam as D
from memspool.llm import queries

from .conftest import DOCS, doc_rows, prose

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# --- 2 ----------------------------------------------------------------------------------------------------------------


def plain_rules(t):
    w = WORDS.findall(t or "")
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    repeated = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)}
    lines = [x for x in (t or "").split("\n") if WORDS.search(x)]
    symbols = len(re.findall(r"[#*$%&|<>]", t or ""))
    failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(repeated), failed


@pytest.mark.parametrize("source", ["nasty", "documents"])
def test_rules_equal_plain_statistics(request, tables, source):
    docs = tables["documents"] if source == "documents" else request.getfixturevalue("nasty")
    got = sorted((repr(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in R.quality_rules(docs).collect())
    assert got == sorted((repr(i), *plain_rules(t)) for i, t in texts(docs))


def test_bands(nasty, nothing, spark):
    rng = random.Random(0)
    rows = [(0, prose(5, 400), "", ""), (1, "same words again " * 200, "", ""), (2, " ".join("%064x" % rng.getrandbits(256) for _ in range(100)), "", ""), (3, prose(6, 900) + " ab" * 4000, "", "")]
    got = {r["doc_id"]: r for r in R.quality_rules(spark.createDataFrame(doc_rows(rows), DOCS)).collect()}
    assert got[0]["kept"] and not got[1]["kept"] and not got[3]["kept"]
    raw = rows[0][1].encode()
    assert got[0]["ratio"] == len(zstandard.ZstdCompressor(level=3, write_content_size=False).compress(raw)) / len(raw)
    tight = R.Bands(high=(0.1,) * 6)
    assert not any(r["kept"] for r in R.quality_rules(nasty, tight).collect())
    assert R.quality_rules(nothing).count() == 0


def test_every_byte_is_in_a_chunk(spark):
    """A repetitive tail, and a text a little longer than a chunk; by compressing each chunk."""
    good = prose(21, 2000)
    rows = [(0, good[: 3 * 2048], "", ""), (1, good[: 3 * 2048] + "same " * 400, "", ""), (2, good[:2048], "", ""), (3, good[:2049], "", ""), (4, good[:1900] + "again " * 100, "", "")]
    got = {r["doc_id"]: r for r in R.quality_rules(spark.createDataFrame(doc_rows(rows), DOCS)).collect()}
    b, c = R.Bands(), zstandard.ZstdCompressor(level=3, write_content_size=False)
    for i, t, *_ in rows:
        raw, size = t.encode(), b.chunk_bytes
        parts = [raw[k : k + size] for k in range(0, len(raw), size)]
        parts[-1] = raw[-size:]
        ratios = [len(c.compress(x)) / size for x in parts] if len(raw) > size else []
        assert (got[i]["n_chunks"], got[i]["n_bad_chunks"]) == (len(ratios), sum(not b.chunk_low <= x <= b.chunk_high for x in ratios))
    assert [got[i]["n_chunks"] for i in range(5)] == [3, 4, 0, 2, 2] and got[1]["n_bad_chunks"] == 1 and got[0]["kept"]


# --- 3 ----------------------------------------------------------------------------------------------------------------

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_tokens(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return {(i, x): t.encode(x or "", add_special_tokens=False).ids + [2] for i, x in rows}


@pytest.mark.parametrize("source", ["nasty", "documents"])
def test_tokens_round_trip(request, tables, source):
    docs = tables["documents"] if source == "documents" else request.getfixturevalue("nasty")
    p = T.TokenParams(shard_tokens=5000, least_count=4, rounds=5, rules_per_round=50)
    got = sorted(T.encode_corpus(docs, PATH, p).collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    want = Counter((i, len(v), zlib.crc32(np.array(v, "<u4").tobytes())) for i, x in texts(docs) for v in [plain_tokens([(i, x)])[i, x]])
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]


def test_words_with_marks_and_odd_characters():
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(PATH), T.Encoder(PATH, "<u2", 50)
    rng = random.Random(2)
    letters = "abzAZéÉßÿİŉſσΣ漢０1９_'’.,!*#-|<>́  ퟿🙂 \t\n" + "it's WE'LL can't"
    for _ in range(400):
        x = "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
        assert list(np.frombuffer(e(x.encode()), "<u2")) == t.encode(x, add_special_tokens=False).ids, x
    x = "a<|endoftext|>b <|startoftext|>"
    assert list(np.frombuffer(e(x.encode()), "<u2")) == t.encode(x, add_special_tokens=False).ids


def test_grammar_never_crosses_documents_and_reads_one():
    rng = np.random.default_rng(0)
    docs = [np.concatenate([rng.choice([1, 2, 3, 7], rng.integers(0, 60)), [2]]).astype("<u2") for _ in range(200)]
    counts = np.array([len(d) for d in docs])
    p = T.TokenParams(rounds=6, rules_per_round=5, least_count=3)
    data = T.pack_shard(list(range(200)), counts, np.concatenate(docs), 10, p)
    s = T.Shard(data)
    assert len(s.left) > 10 and len(s.symbols) < 0.6 * counts.sum()
    assert all((s.document(i) == d).all() for i, d in enumerate(docs)) and all((a == d).all() for a, d in zip(s.documents(50), docs))
    assert s.lengths.tolist() == T.expansion_lengths(s.left.astype(int), s.right.astype(int), 10).tolist()
    # by position, without expanding the grammar
    lone = T.Shard(data)
    for i, d in enumerate(docs[:40]):
        for a, b in [(0, len(d)), (3, 9), (len(d) - 1, len(d)), (5, 5), (-2, 10_000), *(sorted(rng.integers(0, len(d) + 1, 2).tolist()) for _ in range(5))]:
            assert lone.slice(i, a, b).tolist() == d[max(0, a) : b].tolist()
    assert "_expansions" not in vars(lone)
    wide = T.Shard(T.pack_shard([None, 5], np.array([2, 3]), np.array([70_000, 2, 70_000, 2, 2], "<u4"), 80_000, T.TokenParams(least_count=2)))
    assert wide.ids == [None, 5] and wide.document(1).tolist() == [70_000, 2, 2]


def test_first_rules_are_the_most_frequent_pairs():
    x = np.array([1, 2, 1, 2, 1, 2, 3, 3, 3, 3, 9], "<u2")
    left, right, rest, firsts = T.compress(x, np.array([0, len(x)]), 10, T.TokenParams(rounds=1, rules_per_round=2, least_count=2))
    assert (left.tolist(), right.tolist(), rest.tolist(), firsts.tolist()) == ([1, 3], [2, 3], [10, 10, 10, 11, 11, 9], [0, 6])


def frequent_pairs(symbols, firsts, least):
    """Pairs within documents that occur ``least`` times, by counting them one by one."""
    n = Counter(p for a, b in zip(firsts, firsts[1:]) for p in zip(symbols[a:b].tolist(), symbols[a + 1 : b].tolist()))
    return {p: k for p, k in n.items() if k >= least}


@pytest.mark.parametrize(("seed", "least", "dtype"), [(0, 2, "<u2"), (1, 3, "<u4"), (2, 24, "<u2"), (3, 5, "<u2")])
def test_grammar_ends_where_no_pair_is_frequent(seed, least, dtype):
    rng = np.random.default_rng(seed)
    docs = [np.concatenate([rng.choice(12, rng.integers(0, 300), p=[0.5, *[0.5 / 11] * 11]), [2]]).astype(dtype) for _ in range(40)] + [np.full(700, 1, dtype), np.zeros(0, dtype)]
    firsts = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    p = T.TokenParams(least_count=least)
    left, right, rest, at = T.compress(np.concatenate(docs), firsts, 65_500 if dtype == "<u2" else 12, p)
    assert len(left) > 20 and not frequent_pairs(rest, at, least)
    assert len(set(zip(left.tolist(), right.tolist()))) == len(left)
    if dtype == "<u2" and least == 2:
        assert rest.dtype == np.dtype("<u4")  # more symbols than two bytes hold
    s = T.Shard(T.pack_shard(list(range(len(docs))), np.diff(firsts), np.concatenate(docs), 65_500 if dtype == "<u2" else 12, p))
    assert all((s.document(i) == d).all() for i, d in enumerate(docs))


def test_where_pairs_overlap_the_more_frequent_goes_first():
    x = np.array([5, 1, 2] * 4 + [1, 2] * 3 + [9], "<u2")  # (1, 2) seven times, (5, 1) four times
    left, right, rest, _ = T.compress(x, np.array([0, len(x)]), 10, T.TokenParams(least_count=4, rounds=1))
    assert (left.tolist(), right.tolist(), rest.tolist()) == ([1], [2], [5, 10] * 4 + [10] * 3 + [9])
    where, rank = np.array([3, 4, 5, 6, 10, 11, 12, 20]), np.array([2, 1, 0, 3, 4, 4, 4, 1])
    got = T._disjoint(where, rank)
    assert (got[0].tolist(), got[1].tolist()) == ([3, 5, 10, 12, 20], [2, 0, 4, 4, 1])


def test_tokens_of_nothing(nothing):
    assert T.encode_corpus(nothing, PATH).count() == 0


# --- 4 ----------------------------------------------------------------------------------------------------------------


def plain_lines(rows, p):
    """Templates by comparing a leaf's lines in order; then counts of documents."""
    rows = [(i, t) for i, t in {(i, t) for i, t in rows}]
    leaves = {}
    for _, t in rows:
        for line in (t or "").encode().split(b"\n"):
            m = tuple(b"<*>" if re.search(rb"[0-9]", w) else w for w in line.split())
            if len(m) >= p.min_tokens:
                leaves.setdefault((len(m), m[: p.depth]), set()).add(m)
    leader = {}
    for members in leaves.values():
        left = sorted(members, key=lambda m: b" ".join(m).decode())
        while left:
            head = left[0]
            same = [m for m in left if m == head or len(head) > p.depth and sum(a == b for a, b in zip(m, head)) / len(head) >= p.similarity]
            leader |= dict.fromkeys(same, head)
            left = [m for m in left if m not in same]

    def template(line):
        return leader.get(tuple(b"<*>" if re.search(rb"[0-9]", w) else w for w in line.encode().split()))

    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if (k := template(line)) is not None:
                holders.setdefault(k, set()).add((i, t))
    out = {}
    for i, t in rows:
        kept = []
        for line in (t or "").split("\n"):
            k = template(line)
            owners = holders.get(k, set())
            least = min(((o if o is not None else 1 << 62) for o, _ in owners), default=None)
            mine = i if i is not None else 1 << 62
            if k is None or len(owners) < p.min_docs or mine == least:
                kept.append(line)
        out[i, t] = None if t is None else "\n".join(kept)
    return out


def line_docs(spark):
    rng = random.Random(4)
    shared = ["All rights reserved here now", "Call 555 1234 for more today please", "Copyright 2019 by the same people of old", "one two", prose(9, 60)]
    rows = []
    for i in range(40):
        lines = [prose(100 + i * 7 + k, rng.randrange(1, 30)) for k in range(4)]
        for s in shared:
            if rng.random() < 0.4:
                lines.insert(rng.randrange(len(lines)), re.sub(r"\d+", lambda m: str(rng.randrange(1000)), s).replace("people", rng.choice(["people", "persons"])))
        rows.append((i, "\n".join(lines), "en", "s"))
    return spark.createDataFrame(doc_rows(rows), DOCS)


@pytest.mark.parametrize("source", ["nasty", "documents", "made"])
def test_lines_equal_plain_templates(request, tables, spark, source):
    docs = {"documents": tables["documents"], "made": line_docs(spark)}[source] if source != "nasty" else request.getfixturevalue("nasty")
    p = N.TemplateParams()
    before, after = Counter(texts(docs)), N.drop_recurring(docs.withColumn("was", F.col("text")), p)
    assert after.columns == [*docs.columns, "was"]
    got = Counter((r["doc_id"], r["was"], r["text"]) for r in after.collect())
    want = plain_lines(list(before), p)
    assert got == Counter({(i, t, want[i, t]): n for (i, t), n in before.items()})


def test_leaves_of_any_size_give_the_same_lines(spark):
    """One template of thirty lines that differ early, and unrelated lines in the same leaf."""
    rows = [(i, "same start of line " + prose(i, 6) + " end" * 26, "en", "s") for i in range(30)]
    rows += [(100 + i, "same start of line " + prose(500 + i, 32), "en", "s") for i in range(40)]
    docs = spark.createDataFrame(doc_rows(rows), DOCS)
    for block in (2, 10, 2000):
        got = N.drop_recurring(docs, N.TemplateParams(block=block), counts=True).where("n_dropped = 1").collect()
        assert sorted(r["doc_id"] for r in got) == list(range(1, 30))


def test_parts_of_a_leaf_hold_all_variants(spark):
    """Lines that agree in enough positions are in one part, at every number of tokens."""
    rng = random.Random(12)
    for n in (4, 5, 6, 9, 10, 15, 23):
        lines = sorted({" ".join(["a", "b", "c"] + [rng.choice("pqrst") for _ in range(n - 3)]) for _ in range(60)})
        df = spark.createDataFrame([(7, x, i, i) for i, x in enumerate(lines)], "leaf long, s string, h1 long, h2 long")
        part = {r["h1"]: (r["g"], r["k"]) for r in N.divided(df, N.TemplateParams()).collect()}
        assert len(part) == len(lines) and Counter(g for g, _ in part.values()) == dict(part.values())
        for i, x in enumerate(lines):
            for j, y in enumerate(lines):
                if sum(a == b for a, b in zip(x.split(), y.split())) / n >= 0.8:
                    assert part[i] == part[j]


def test_lines_of_nothing(nothing):
    assert N.drop_recurring(nothing).count() == 0


# --- 7 ----------------------------------------------------------------------------------------------------------------


def plain_fingerprint(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = WORDS.findall(low)
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, bits=3):
    group = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= bits and group[b] < group[a]:
                    group[a], changed = group[b], True
    return group


@pytest.mark.parametrize("source", ["nasty", "documents", "near"])
def test_components_equal_brute_force(request, tables, spark, source):
    if source == "near":
        base = prose(11, 300).split()
        rows = [(100 - k, " ".join(base[:k] + ["Other"] * (k > 0) + base[k + 1 :]), "", "") for k in range(0, 90, 3)] + [(200 + k, prose(50 + k, 30), "", "") for k in range(20)]
        docs = spark.createDataFrame(doc_rows(rows), DOCS)
    else:
        docs = tables["documents"] if source == "documents" else request.getfixturevalue("nasty")
    rows = texts(docs)
    fp = {t: plain_fingerprint(t) for _, t in rows}
    group = plain_components(sorted(set(fp.values())))
    least = {}
    for i, t in rows:
        if i is not None:
            g = group[fp[t]]
            least[g] = min(least.get(g, i), i)
    want = Counter((i, fp[t], least.get(group[fp[t]])) for i, t in rows)
    got = Counter((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in S.near_duplicates(docs).collect())
    assert got == want
    kept = S.deduplicate(docs).collect()
    assert len(kept) == len({group[f] for f in fp.values()})
    assert all(r["doc_id"] == least.get(group[fp[r["text"]]]) for r in kept)


@pytest.mark.parametrize(("most", "block"), [(4096, 1024), (4, 5)])
def test_links_find_all_near_pairs(spark, most, block):
    """Dense groups too, whose cells are dealt into blocks."""
    rng = random.Random(7)
    fps = {rng.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1}
    for c in list(fps)[:6]:
        for _ in range(40):
            x = c
            for _ in range(rng.randrange(1, 4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    df = spark.createDataFrame([(v,) for v in signed.values()], "fp long")
    found = S.links(df, 3, most, block).collect()
    assert all(((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= 3 and r["a"] != r["b"] for r in found)
    parts = {r["node"]: r["component"] for r in S.connected_components(spark.createDataFrame([(r["a"], r["b"]) for r in found], "a long, b long")).collect()}
    want = plain_components(sorted(fps))
    mine = {f: parts.get(v, v) for f, v in signed.items()}
    assert len(set(mine.values())) == len(set(want.values())) == len({(mine[f], want[f]) for f in fps})
    with pytest.raises(ValueError, match="3"):
        S.links(df, 4)


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in S.connected_components(chain).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_rows_equal_in_id_and_text_leave_one_by_their_other_columns(spark):
    rows = doc_rows([(3, prose(1, 30), lang, None) for lang in ("en", None, "de", "en")])
    kept = {S.deduplicate(spark.createDataFrame(rows[k:] + rows[:k], DOCS).repartition(3)).collect()[0]["lang"] for k in range(4)}
    assert len(kept) == 1


def test_simhash_of_nothing(nothing):
    assert S.near_duplicates(nothing).count() == 0 and S.deduplicate(nothing).count() == 0


# --- 8 ----------------------------------------------------------------------------------------------------------------


def test_pages_give_their_articles(tables):
    got = {r["page_id"]: r for r in H.extract_pages(tables["pages"]).collect()}
    for r in tables["pages"].collect():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert got[r["page_id"]]["text"] == "\n".join(x for x in parts if x)
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


def share(text):
    words = re.findall(r"\w+", text.lower())
    return len([w for w in words if w in H.STOP_WORDS]) / (len(words) or 1)


def plain_sections(found, labels, rules, judge):
    """The second pass over blocks that nothing marks, by its definition."""
    n = len(found)
    starts = [i for i in range(n) if i == 0 or "bad" in (labels[i], labels[i - 1]) or (found[i].heading and not found[i - 1].heading)]
    # headings in a row begin one section only where no text came before them in it
    sections = [list(range(a, b)) for a, b in zip(starts, [*starts[1:], n])]
    text = [sum(len(found[i].text) for i in s if not found[i].heading) for s in sections]
    now = ["bad" if labels[s[0]] == "bad" else "good" if any(labels[i] == "good" for i in s) else None for s in sections]
    if judge:
        for k, s in enumerate(sections):
            if now[k] is None and text[k] >= (rules.short_chars if found[s[0]].heading else rules.long_chars) and share(" ".join(found[i].text for i in s)) >= rules.stop_low:
                now[k] = "good"
        if "good" not in now:
            headed = [k for k, s in enumerate(sections) if now[k] is None and found[s[0]].heading and text[k]]
            if headed:
                now[max(headed, key=lambda k: text[k])] = "good"
    out = list(now)
    for k in reversed(range(len(sections))):
        if now[k] is not None:
            continue
        if not text[k]:
            out[k] = out[k + 1] if k + 1 < len(sections) and now[k + 1] is not None else "good" if any(x == "good" for x in now[k + 1 :] if x)  and next(x for x in now[k + 1 :] if x) == "good" else "bad"
            continue
        above = [(sum(len(sections[m]) for m in range(j + 1, k)), now[j]) for j in range(k) if now[j]]
        below = [(0, now[k + 1])] if k + 1 < len(sections) and not found[sections[k + 1][0]].heading and now[k + 1] else []
        near = sorted(above)[:1] + below
        out[k] = min(near, key=lambda x: x[0])[1] if near else "bad"
    return [out[k] for k, s in enumerate(sections) for _ in s]


def plain_labels(found, rules):
    """Both passes by their definition: each ambiguous block looks at all blocks of its section."""

    def alone(b, kind):
        n, stops = len(b.text), share(b.text)
        if b.link_chars > rules.max_link_density * n or ("©" in b.text and n < rules.long_chars and kind != H.ARTICLE):
            return "bad"
        long = n >= rules.long_chars and stops >= rules.stop_low
        label = "good" if not b.heading and (long or (n >= 2 * rules.short_chars and stops >= rules.stop_high)) else "unknown"
        down = kind in (H.BY_ELEMENT, H.BY_NAME) or (kind == H.PERHAPS and n < rules.long_chars)
        return {"good": "unknown", "unknown": "bad", "bad": "bad"}[label] if down else label

    kinds = [b.kind if rules.hints else H.PLAIN for b in found]
    labels = [alone(b, k) for b, k in zip(found, kinds)]
    if "good" not in labels and H.ARTICLE not in kinds:
        wrong = {b.section for b in found if rules.hints and b.kind == H.BY_NAME and len(b.text) >= rules.long_chars and alone(b, H.PLAIN) == "good"}
        kinds = [H.PLAIN if b.section in wrong else k for b, k in zip(found, kinds)]
        labels = [alone(b, k) for b, k in zip(found, kinds)]
    size = Counter()
    for b, k, x in zip(found, kinds, labels):
        size[k == H.ARTICLE] += len(b.text) * (x == "good")
    if size[True] > size[False]:
        labels = ["unknown" if x == "good" and k != H.ARTICLE else x for x, k in zip(labels, kinds)]
    where = [0 if k == H.PLAIN else b.section for b, k in zip(found, kinds)]
    out = []
    for i, (b, k, x) in enumerate(zip(found, kinds, labels)):
        if x == "unknown":
            near = sorted((abs(j - i), labels[j]) for j in range(len(found)) if where[j] == where[i] and labels[j] != "unknown")
            least = [y for d, y in near if d == near[0][0]]
            if len(set(least)) == 1:
                x = least[0]
            elif not least or not b.heading:
                x = "good" if k == H.ARTICLE else "bad"
            else:
                x = labels[i + near[0][0]]
        out.append(x == "good")
    free = [i for i in range(len(found)) if where[i] == 0]
    for i, x in zip(free, plain_sections([found[i] for i in free], [labels[i] for i in free], rules, size[True] <= size[False])):
        out[i] = x == "good"
    return out


@pytest.mark.parametrize("hints", [True, False])
def test_both_passes_equal_their_definition(tables, hints):
    rng, rules = random.Random(8), H.BlockRules(hints=hints)
    stop, other = ["the", "of", "die", "que"], ["stone", "river", "haus"]
    pages = [H.blocks(r["html"]) for r in tables["pages"].collect()]
    for _ in range(1500):
        kinds = [H.PLAIN, *(rng.choice((H.BY_ELEMENT, H.BY_NAME, H.PERHAPS, H.ARTICLE)) for _ in range(3))]
        page = []
        for _ in range(rng.randrange(12)):
            share, section = rng.choice([0, 0.1, 0.2, 0.5]), rng.randrange(4)
            text = " ".join(rng.choice(stop if rng.random() < share else other) for _ in range(rng.choice([2, 8, 20, 60]))) + rng.choice(["", "", "", " ©"])
            page.append(H.Block(text, rng.choice([0, 0, len(text) // 3, len(text) * 4 // 5]), section, kinds[section], rng.random() < 0.1))
        pages.append(page)
    for page in pages:
        H.label_blocks(page, rules)
        assert [b.good for b in page] == plain_labels(page, rules)


PROSE = "This is the text of the story, and it is long enough to be judged by the words that are in it, as they are of the kind that holds sentences together. "


@pytest.mark.parametrize("name", ["side-effects", "search-results", "legal", "form-history", "related-work", "comment on the law"])
def test_misleading_names_lose_no_text(name):
    text = (PROSE * 2).strip()
    inner = f"<h2>Dosage</h2><p>{text}</p><p>Short.</p><p>{text}</p>"
    if name in ("legal", "comment on the law"):  # weak evidence, or furniture with other words beside it
        inner = f"<p>{text}</p><p>{text}</p>"
    want = [x for x in re.split(r"<[^>]+>", inner) if x]
    wrapped = f'<div class="{name.replace(" ", "-")}">{inner}</div>'
    assert H.main_text(f"<nav><a href=/>Home</a></nav><article><p>{text}</p>{wrapped}</article><footer>{text}</footer>").split("\n") == [text, *want]
    assert H.main_text(f"<div id=top-menu><a href=/>Home</a></div>{wrapped}<footer>{text}</footer>").split("\n") == want


def test_wrong_names_give_way_where_nothing_else_is_good():
    text = (PROSE * 2).strip()
    page = f"<nav><a href=/>Home</a></nav><div class=ad>Buy the best of it.</div><div class=sidebar><h1>Title</h1><p>{text}</p><p>End.</p></div><footer>{text}</footer>"
    assert H.main_text(page).split("\n") == ["Title", text, "End."]
    beside = page.replace("<footer>", f"<div><p>{text}</p></div><footer>")
    assert H.main_text(beside) == text


def test_furniture_goes_at_any_length():
    text = (PROSE * 9).strip()
    for mark in ("<aside>{}</aside>", "<form><p>{}</p></form>", "<div class='comment-list'><p>{}</p></div>", "<section id=comments><p>{}</p><p>{}</p></section>", "<div role=complementary>{}</div>", "<div class=cookieConsent>{}</div>"):
        page = f"<main><h1>Title</h1><p>{text}</p>{mark.replace('{}', text)}</main>"
        assert H.main_text(page) == f"Title\n{text}"


def test_pages_need_no_hints(tables):
    """The passes alone, without elements and names, give the articles of nearly all pages."""
    rows = tables["pages"].collect()
    plain = [H.main_text(r["html"], H.BlockRules(hints=False)) == H.main_text(r["html"]) for r in rows]
    assert sum(plain) >= 0.95 * len(rows)


def test_sections_without_hints():
    text, rules = (PROSE * 2).strip(), H.BlockRules(hints=False)
    menu = "<div><a href=/>Home</a></div><div><a href=/n>News</a></div>"
    page = f"{menu}<div>Buy the best of it now.</div><h1>Title</h1><p>Short.</p><p>{text}</p><h2>Part</h2><p>One of it.</p><p>End.</p><div><a href=/x>More of this</a></div><p>© example.org · All of it.</p>"
    assert H.main_text(page, rules).split("\n") == ["Title", "Short.", text, "Part", "One of it.", "End."]
    short = f"{menu}<div>Buy the best of it now.</div><h1>Title</h1><p>A story.</p><p>© example.org</p>"
    assert H.main_text(short, rules).split("\n") == ["Title", "A story."]


def test_links_over_blocks():
    text = (PROSE * 2).strip()
    teaser = f"<a href=/x><h3>Other</h3><p>{text[:128]}</p></a>"
    assert [(b.text, b.link_chars > 0) for b in H.blocks(teaser + "<p>no link</p>")] == [("Other", True), (text[:128], True), ("no link", False)]
    assert H.main_text(f"<h1>Title</h1><p>{text}</p>{teaser}", H.BlockRules(hints=False)) == f"Title\n{text}"
    # a link that is never closed ends with what it was opened in
    for page in ("<p><a href=/>link<p>no link", "<li><a href=/>link</li><li>no link", "<div><a href=/>link</div>no link"):
        assert [(b.text, b.link_chars > 0) for b in H.blocks(page)] == [("link", True), ("no link", False)]


def test_unmatched_and_deep_tags_take_linear_time():
    def seconds(n):
        page = "<div>" * n + "x" + "</section>" * n + "<p>y" + "<ul><li>" * n + "z" + "</div>" * n
        began = time.perf_counter()
        assert [b.text for b in H.blocks(page)] == ["x", "y", "z"]
        return time.perf_counter() - began

    assert seconds(40_000) < 5


def test_blocks_without_an_article():
    para = "This is the text of the story, and it is long enough to be judged by the words that are in it, as they are of the kind that holds sentences together. "
    page = (
        "<html><head><title>T</title><script>if (a < b) { x('</p>') }</script></head><body><div id=top-menu><a href=/>Home</a> <a href=/x>News of the day</a></div><h1>A title</h1>"
        f"<p>{para * 2}<p>Short &amp; sweet.<div>{para}<i>with</i> more</div><!-- <p>hidden --><div class='comments'><p>{para * 2}</p></div><form><p>{para}</p></form><div>Share</div><footer>{para}</footer><p class"
    )
    want = ["A title", (para * 2).strip(), "Short & sweet.", (para + "with more").strip()]
    assert H.main_text(page).split("\n")[:4] == want
    assert "hidden" not in H.main_text(page) and H.main_text(page).count("story") == 3


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!--", "<script>x", "<nav>only a menu</nav>", "<div class=\"ad\">buy</div>", '<a href="'])
def test_pages_without_text(page):
    assert H.main_text(page) == ""


def test_pages_defined_cases(spark):
    pages = spark.createDataFrame([(1, None, "<article>x<p>y", "t"), (1, None, "<article>x<p>y", "t"), (None, "u", None, None), (2, "u", "<article>" + "<p>a" * 20_000, None)], "page_id long, url string, html string, text string")
    got = Counter((r["page_id"], r["text"][:20], r["n_chars"]) for r in H.extract_pages(pages).collect())
    assert got == Counter({(1, "x\ny", 3): 2, (None, "", 0): 1, (2, "a\n" * 10, 39_999): 1})
    assert H.extract_pages(pages.limit(0)).count() == 0


# --- 9 ----------------------------------------------------------------------------------------------------------------


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, target, left = 1.5 * sum(sizes.values()), {}, set(names)
    while left:
        share = total - sum(target.values())
        level = {s: share * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if level[s] > 2 * sizes[s]}
        if not over:
            return target | level
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= over
    return target


@pytest.mark.parametrize("source", ["nasty", "documents"])
@pytest.mark.parametrize("group_rows", [3, 8192])
def test_mix(request, tables, source, group_rows):
    docs = tables["documents"] if source == "documents" else request.getfixturevalue("nasty")
    rows = [(r["doc_id"], r["source"], len(WORDS.findall(r["text"] or ""))) for r in docs.select("doc_id", "source", "text").collect()]
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    want = plain_targets(dict(sizes))
    got = M.mix_report(docs, group_rows=group_rows, fan_in=4).collect()
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter(rows)
    assert all(r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]]) for r in got)
    assert all(r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2 for r in got)
    most = {s: max(n for _, x, n in rows if x == s) for s in sizes}
    for s in sizes:
        assert abs(sum(r["taken"] for r in got if r["source"] == s) - want[s]) <= most[s] + 1e-6
    again = M.mix_report(docs.repartition(3), group_rows=group_rows, fan_in=4).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    mixed = M.mix_documents(docs, group_rows=group_rows, fan_in=4)
    assert mixed.columns == docs.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({i: n for i, n in ((i, sum(r["copies"] for r in got if r["doc_id"] == i)) for i, _, _ in rows) if n})


def test_equal_rows_are_rounded_each_by_itself(spark):
    """A source of which most rows are equal comes as near its target as any other."""
    rows = [(7, "four words of it", "en", "y")] * 1000 + [(100 + i, "five words of another one", "en", "y") for i in range(200)] + [(1000 + i, prose(i, 30), "en", "x") for i in range(90)]
    docs = spark.createDataFrame(doc_rows(rows), DOCS).withColumn("n_chars", F.monotonically_increasing_id())
    got = M.mix_report(docs).collect()
    target = {r["source"]: r["target"] for r in got}
    assert len(got) == len(rows) and abs(sum(r["taken"] for r in got if r["source"] == "y") - target["y"]) <= 5
    assert len({r["copies"] for r in got if r["doc_id"] == 7}) == 2
    mixed = Counter((r["doc_id"], r["n_chars"]) for r in M.mix_documents(docs).collect())
    assert mixed == Counter((r["doc_id"], r["n_chars"]) for r in M.mix_documents(docs.repartition(5)).collect())
    of_id = Counter()
    for r in got:
        of_id[r["doc_id"]] += r["copies"]
    assert Counter(i for i, _ in mixed.elements()) == +of_id and max(mixed.values()) <= 2


def test_rounding_keeps_expectations(spark):
    """Over many seeds each document is taken as often as its probability says."""
    import pandas as pd

    rng, n, taken = np.random.default_rng(0), 400, np.zeros(5)
    for _ in range(n):
        f = pd.DataFrame({"key": range(5), "doc_id": range(5), "source": "s", "size": [1, 2, 3, 50, 7], "u": rng.random(5), "p": 0.3, "g": 0})
        taken += M._round_pairs(f, True).sort_values("doc_id")["p"].to_numpy()
    assert np.abs(taken / n - 0.3).max() < 0.08


def test_mix_of_nothing(nothing):
    assert M.mix_report(nothing).count() == 0 and M.mix_documents(nothing).count() == 0


# --- 10 ---------------------------------------------------------------------------------------------------------------


def plain_search(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        row, above = [i], row
        for j, d in enumerate(text, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (c != d)))
    return min(row)


def test_myers_equals_dynamic_programming():
    rng = random.Random(5)
    for _ in range(300):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, n))) for n in (12, 40))
        best = plain_search(p, t)
        got = D.myers_search(p, t, 3)
        assert (got[0] if got else None) == (best if best <= 3 else None)


def test_windows_that_overlap_are_one():
    assert D.windows({0, 3, 30, 200}, 10, 2, 205) == [(0, 15), (28, 42), (198, 205)]
    m = D.Matcher([(1, "again " * 200)], D.MatchParams())
    text = D.normalize("again " * 2500 + "then " + "again " * 199 + "agoin")
    assert m.find(text) == [(1, 0, len(D.normalize("again " * 200)))]


def test_leaks_equal_brute_force(spark, nasty):
    rng = random.Random(6)
    items = [(i, prose(300 + i, rng.choice([8, 25, 40]))) for i in range(12)] + [(50, None), (51, ""), (52, "...")]
    rows = []
    for i in range(60):
        parts = [prose(900 + i, 30)]
        if i % 3 == 0:
            x = list(items[i % 12][1])
            for _ in range(i % 7):
                k = rng.randrange(len(x))
                x[k : k + 1] = rng.choice([[], ["q"], [x[k], "q"]])
            parts.insert(rng.randrange(2), ("".join(x)).upper().replace(" ", ",  "))
        rows.append((i, " ".join(parts), "", ""))
    docs = spark.createDataFrame(doc_rows(rows), DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for d, t, *_ in rows:
        for i, x in items[:12]:
            item, text = D.normalize(x), D.normalize(t)
            if (n := plain_search(item, text)) <= int(0.05 * len(item)):
                want.add((d, i, n))
    for block in (4_000_000, 100):
        assert {(r["doc_id"], r["item_id"], r["distance"]) for r in D.find_leaks(docs, bench, D.MatchParams(block_chars=block)).collect()} == want
    named = bench.where("item_id < 4").union(bench.where("item_id >= 4").selectExpr("cast(null as long)", "text"))  # an item needs no id
    found = D.find_leaks(docs, named).collect()
    assert {(r["doc_id"], r["distance"]) for r in found} == {(d, n) for d, _, n in want} and None in {r["item_id"] for r in found}
    assert {r["doc_id"] for r in D.decontaminate(docs, named).collect()} == {r[0] for r in rows} - {d for d, _, _ in want}
    clean = D.decontaminate(docs, bench)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {r[0] for r in rows} - {d for d, _, _ in want} and len(want) > 5
    assert D.decontaminate(nasty, bench).count() == nasty.count()
    assert D.decontaminate(docs, bench.limit(0)).count() == 60
    assert D.find_leaks(docs.limit(0), bench).count() == 0 and D.decontaminate(docs.limit(0), bench).count() == 0


# --- together ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op2_rules", "op4_lines", "op7_simhash", "op8_html", "op9_mix"])
def test_queries_return_a_row_for_each_input(spark, sf_dir, tables, name):
    got = queries.QUERIES[name](spark, sf_dir)
    assert got.count() == tables["pages" if name == "op8_html" else "documents"].count()
    if name == "op7_simhash":
        assert {len(r["fingerprint"]) for r in got.collect()} == {16} and got.columns == ["doc_id", "fingerprint", "component_id"]
