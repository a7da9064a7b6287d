"""Readers of large files: arrays by ranges, and branches of long conversations."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from memspool.operators.branches import ancestors
from memspool.sources import history as SH
from memspool.sources.arrays import array_members


@pytest.fixture
def small_ranges(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def value(rng, depth=0):
    """Any JSON value, with strings full of what looks like structure."""
    k = rng.randrange(8 if depth < 3 else 4)
    word = lambda n: "".join(rng.choice(["a", '"', "\\", "{", "}", "[", "]", ",", "é", "\n", " ", '\\"', '}"']) for _ in range(rng.randrange(n)))
    if k < 3:
        return word(12)
    if k == 3:
        return rng.choice([1, -2.5, None, True])
    return {word(4): value(rng, depth + 1) for _ in range(rng.randrange(4))} if k < 6 else [value(rng, depth + 1) for _ in range(rng.randrange(4))]


def test_members_of_arrays_that_are_read_in_ranges(spark, tmp_path, small_ranges):
    rng, want = random.Random(1), {}
    for f, (n, indent) in enumerate([(0, None), (1, None), (40, 2), (300, None), (300, None), (300, 1)]):
        objects = [{"k": i, "v": value(rng)} for i in range(n)]
        listed = [x for o in objects for x in (o, 1, "a}b", None, [])] if f == 3 else objects
        text = ("﻿" if f == 4 else "") + json.dumps(listed, indent=indent, ensure_ascii=f % 2 == 0) + "\n" * (f % 2)
        (tmp_path / f"f{f}.json").write_text(text)
        want |= {(f"f{f}.json", i): o for i, o in enumerate(objects)}
    assert spark.read.option("lineSep", "}").text(str(tmp_path / "f3.json")).rdd.getNumPartitions() >= 8
    got = {(r["file"].rsplit("/", 1)[1], r["idx"]): json.loads(r["item"]) for r in array_members(spark, str(tmp_path)).collect()}
    assert got == want


@pytest.mark.parametrize("text", ['[{"a":1},{"b":2}', '{"a":1}', '[{"a":1} {"b":2}]', '[{"a":1}] x', '[{"a":]}]', '[{"a":1}]]', '[{"a":"x}]'])
def test_what_is_no_array_fails(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception, match="array of JSON objects|MALFORMED"):
        array_members(spark, str(tmp_path)).collect()


def test_ancestors_with_forks_cycles_and_gaps(spark):
    rng = random.Random(2)
    rows, starts, want = [], [], set()
    for c in range(40):
        n = rng.randrange(1, 30)
        parent = {f"k{i}": rng.choice([f"k{rng.randrange(n)}", f"k{i - 1}" if i else None, "", "nowhere"]) for i in range(n)}
        leaf = rng.choice([f"k{rng.randrange(n)}", "missing", None])
        rows += [(c, k, p) for k, p in parent.items()]
        starts.append((c, leaf))
        path, now = [], leaf
        while now and now not in path:
            path.append(now)
            now = parent.get(now)
        want |= {(c, k, i) for i, k in enumerate(path)}
    got = ancestors(spark.createDataFrame(rows, "c long, key string, parent string"), spark.createDataFrame(starts, "c long, key string"), ("c",))
    assert {tuple(r) for r in got.collect()} == want


def tree(n, dead=0):
    said = lambda i: {"author": {"role": "user"}, "content": {"parts": [f"turn {i}"]}}
    mapping = {f"n{i}": {"parent": f"n{i - 1}" if i else None, "message": said(i)} for i in range(n)}
    mapping |= {f"d{i}": {"parent": "n0", "message": said(-i)} for i in range(dead)}
    return {"conversation_id": f"c{n}", "current_node": f"n{n - 1}", "mapping": mapping}


def test_both_walks_give_the_same_turns(spark):
    rows = [("f", i, json.dumps(tree(n, 3))) for i, n in enumerate((1, 5, 30))]
    rows.append(("f", 3, json.dumps({"current_node": "a", "mapping": {"a": {"parent": "b", "message": tree(1)["mapping"]["n0"]["message"]}, "b": {"parent": "a"}}})))
    convs = spark.createDataFrame(rows, "file string, idx int, conv string")
    want = sorted(map(str, SH.tree_turns(convs).collect()))
    for limit in (0, 10):
        assert sorted(map(str, SH.tree_turns(convs, limit).collect())) == want
    assert len(want) == 1 + 5 + 30 + 1


def test_a_long_branch_takes_no_square(spark):
    convs = spark.createDataFrame([("f", 0, json.dumps(tree(100_000)))], "file string, idx int, conv string")
    began = time.perf_counter()
    got = SH.tree_turns(convs).agg(F.count("*"), F.min_by("content", "n"), F.max_by("content", "n")).first()
    assert tuple(got) == (100_000, "turn 0", "turn 99999") and time.perf_counter() - began < 120
