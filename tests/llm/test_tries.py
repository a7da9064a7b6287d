"""Prefix trie, Merkle manifest and secret scans against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from memspool.llm import op11_prefixes as P
from memspool.llm import op12_merkle as K
from memspool.llm import op13_secrets as X
from memspool.llm import queries

from .conftest import DOCS, doc_rows, prose

# --- 11 ---------------------------------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, depth long, digest string, n long"


def plain_trie(rows, family=5, shared=9):
    """Nodes of the trie as tuples, by walking every prefix of every conversation."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), (role, text)))
    own = {c: [x[2] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    members, ends, size = defaultdict(list), defaultdict(list), {(): 0}
    for c in own:
        h = zlib.crc32(str(c).encode()) % shared
        turns = tuple(own.get(c - c % family, [])[:h] + own[c][h:])
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
            if d:
                size[turns[:d]] = len(turns[d - 1][1].encode())
        ends[turns].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(members[p]) - 1) * size[p]
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], digest(p)) for p, m in members.items())


def spark_trie(spark, rows, **options):
    table = spark.createDataFrame([(*r, None, None, None) for r in rows], TURNS)
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted(tuple(r[n] for n in names) for r in P.prefix_trie(table, **options).collect())


def talk(seed, most=14):
    """Conversations that share turns, with nulls, ties, repeats, gaps in the ids and one that is long."""
    rng, rows = random.Random(seed), []
    for c in range(60):
        if c % 7 != 3:
            rows += [(c, rng.choice([t, t, None]), rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "b", "é", "", None])) for t in range(rng.randrange(most))]
    rows += [(100, t, "user", str(t % 3)) for t in range(300)] + [(105, t, "user", str(t % 3)) for t in range(150)] + [(500_000, 0, "u", "x"), (500_000, 0, "u", "x")]
    return rows + [(None, 1, "user", "no id"), (61, None, None, None)]


@pytest.mark.parametrize("block", [2, 3, 16])
def test_trie_equals_brute_force(spark, block):
    """Several levels of blocks, one of which is wholly full, and none."""
    rows = talk(block)
    assert spark_trie(spark, rows, block=block) == plain_trie(rows)


def test_trie_of_little(spark):
    assert spark_trie(spark, []) == []
    assert spark_trie(spark, [(None, 0, "user", "x")]) == []
    rows = [(c, 0, None, None) for c in range(2000)]  # many that end in few nodes: ids in several pieces
    assert spark_trie(spark, rows) == plain_trie(rows)


# --- 12 ---------------------------------------------------------------------------------------------------------------


def H(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_levels(digests):
    """The levels of a tree, lowest first."""
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([H(levels[-1][k : k + 16]) for k in range(0, len(levels[-1]), 16)])
    return levels


def plain_way(levels, at):
    """Siblings before and behind, level by level."""
    for level in levels[:-1]:
        run = level[at // 16 * 16 : at // 16 * 16 + 16]
        yield run[: at % 16], run[at % 16 + 1 :]
        at //= 16


def plain_manifest(rows):
    def leaf(row, changed=False):
        d, t, lang, s, n = row
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t) if changed and t is not None else t
        return H("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, s, lang, n, t))

    groups = defaultdict(list)
    for r in rows:
        groups[r[3]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    groups = {s: sorted(groups[s], key=lambda x: x[:3]) for s in names}
    trees = {s: plain_levels([x[2] for x in groups[s]]) for s in names}
    over = plain_levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for at, (_, _, own, r) in enumerate(groups[s]):
            way = [*plain_way(trees[s], at), *plain_way(over, k)]
            got = leaf(r, True) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else own
            for before, behind in way:
                got = H([*before, got, *behind])
            out.append((r[0], own, trees[s][-1][0], over[-1][0], H(x for b, a in way for x in b + a), got, got == over[-1][0]))
    return Counter(out)


@pytest.mark.parametrize("source", ["nasty", "documents", "many"])
def test_manifest_equals_brute_force(request, spark, tables, source):
    if source == "many":  # 16, 17, 1, 256, 257 leaves and so on, and more than 16 sources; equal rows in one
        sizes = [16, 17, 1, 256, 257, 2, 300] + [3] * 15
        rows = [(1000 * k + i, f"Text {i} Of {k}", "en", None if k == 5 else f"s{k}") for k, n in enumerate(sizes) for i in range(n)]
        docs = spark.createDataFrame(doc_rows(rows + [(7, "Same", "en", "s9")] * 3), DOCS)
    else:
        docs = tables["documents"] if source == "documents" else request.getfixturevalue("nasty")
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = Counter(tuple(r[n] for n in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in K.merkle_manifest(docs).collect())
    assert got == plain_manifest(rows)


def test_manifest_of_little(spark, nothing):
    assert K.merkle_manifest(nothing).count() == 0
    one = K.merkle_manifest(spark.createDataFrame(doc_rows([(1, "x", "en", "s")]), DOCS)).first()
    assert one["leaf"] == one["subroot"] == one["root"] and one["proof_sha256"] == H([]) and one["depth"] == 0


# --- 13 ---------------------------------------------------------------------------------------------------------------

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_spans(x):
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(x) if len(m[2]) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 32]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def spans(x):
    raw = x.encode()
    found = X.Scanner().spans(raw) if not hasattr(spans, "scan") else spans.scan(raw)
    at = X.code_points(raw, [v for a, _, b in found for v in (a, b)])
    return [(X.KINDS[k].name, a, b) for (_, k, _), a, b in zip(found, at[::2], at[1::2])]


spans.scan = X.Scanner().spans
BASE = {k.name for k in X.BASE}


def test_base_spans_equal_whole_scans():
    rng = random.Random(1)
    parts = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", " ", "=", ":", "'", '"', "abcd1234", "AKIA", "ABCDEFGH12345", "deadbeef" * 4, "é", "ſecret", "\x00", "K", "0" * 33, "==", "-_.", "\n", "x"]
    for _ in range(20_000):
        x = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 25)))
        assert [s for s in spans(x) if s[0] in BASE] == plain_spans(x), x


def crc_digits(body):
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"[d] + out
    return out


def base58(data):
    n, out = int.from_bytes(data, "big"), ""
    while n:
        n, d = divmod(n, 58)
        out = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"[d] + out
    return out


def test_checksums_decide():
    body = "".join(random.Random(2).choices("abcXYZ0189", k=30))
    good = "ghp_" + body + crc_digits(body)
    assert spans(f"é {good}.") == [("token", 2, 42)]
    assert spans(f"{good[:-1]}{'A' if good[-1] != 'A' else 'B'}") == [] == spans("x" + good) == spans(good + "x")
    data = bytes.fromhex("0488ADE4") + bytes(range(74))
    key = base58(data + hashlib.sha256(hashlib.sha256(data).digest()).digest()[:4])
    assert key.startswith("xprv") and spans(key) == [("extended", 0, 111)]
    assert spans(key[:50] + ("a" if key[50] != "a" else "b") + key[51:]) == []
    assert spans("card 4111111111111111!") == [("card", 5, 21)] and spans("card 4111111111111112!") == [] == spans("94111111111111111")


@pytest.mark.parametrize("source", ["nasty", "documents", "secrets"])
def test_secrets_report(request, spark, tables, source):
    if source == "secrets":
        rows = [(1, "é token = abcdefgh1 AKIA" + "Z" * 20, "", ""), (2, "A" * 100 + "f" * 100_000 + " password:" + " " * 1000 + "secret=12345678", "", ""), (3, "4111111111111111 " * 500, "", "")] + [(4, "secret: 'tokentokentoken'", "", "")] * 2
        docs = spark.createDataFrame(doc_rows(rows), DOCS)
    else:
        docs = tables["documents"] if source == "documents" else request.getfixturevalue("nasty")
    got = Counter(tuple(r) for r in X.secrets_report(docs).drop("n_checked").collect())
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        base, every = plain_spans(r["text"] or ""), spans(r["text"] or "")
        listed = lambda s: ",".join(f"{k}:{a}:{b}" for k, a, b in s)
        n = Counter(k for k, _, _ in base)
        assert set(base) <= set(every)
        want[(r["doc_id"], n["assign"], n["access"], n["hex"], hashlib.sha256(listed(base).encode()).hexdigest(), listed(every))] += 1
    assert got == want


def test_redaction(spark, nasty, nothing):
    rows = [(1, "é token = abcdefgh1, and " + prose(1, 5), "", ""), (2, "secret=" + "a" * 40 + "!", "", ""), (3, None, "", "")]
    clean = X.redact_secrets(spark.createDataFrame(doc_rows(rows), DOCS))
    assert [r["text"] for r in clean.orderBy("doc_id").collect()] == [f"é [secret], and {prose(1, 5)}", "[secret]!", None]
    assert clean.columns == nasty.columns and X.redact_secrets(nothing).count() == 0 == X.secrets_report(nothing).count()


def test_new_queries_are_registered_with_their_twins(spark, sf_dir):
    assert {"op11_prefixes", "op12_merkle", "op13_secrets"} <= set(queries.QUERIES) and {"op11_prefixes", "op12_merkle"} <= set(queries.ORACLES)


@pytest.mark.parametrize("name", ["op11_prefixes", "op12_merkle"])
def test_queries_equal_their_twins(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = con.execute(queries.ORACLES[name]).fetchall()
    names = [d[0] for d in con.description]
    assert columns == sorted(names)
    assert Counter(tuple(r) for r in got.select(columns).collect()) == Counter(tuple(r[names.index(c)] for c in columns) for r in want)
