"""The command line and the agent's tools over one store."""

import json

from memspool import cli
from memspool.sources.store import Store
from memspool.tools import Memory

from .test_plans import EXTRACTED, HISTORY, jsonl, scripted


def test_commands(spark, tmp_path):
    store, said = Store(spark, str(tmp_path / "root")), []
    call = lambda *a: (said.clear(), cli.run(list(a), store, scripted(EXTRACTED), said.append))[1]
    assert call("init") == 0 and call("init") == 1
    assert call("extract", jsonl(tmp_path / "h.jsonl", HISTORY)) == 0 and "5 nodes" in said[0]
    assert call("inspect") == 0 and any("(1.00) Lives in Turin  #home" in x for x in said) and said[-1].endswith("Short.")
    assert call("diff") == 0 and "+ [identity] Lives in Turin" in said[0]
    assert call("log") == 0 and len(said) == 2
    assert call("inject", "--budget", "300", "--query", "report") == 0 and "- Write report" in said[0]
    assert call("search", "TURIN") == 0 and said == ["Lives in Turin"]
    q = tmp_path / "q.json"
    q.write_text(json.dumps([{"question": "Who?", "expected": ["x"]}]))
    assert call("eval", str(q)) == 0 and "recall 0/1 (0%) @ budget 2000" in said[-1]
    assert call("export", str(tmp_path / "p")) == 0 and call("--profile", "copy", "import", said[0].split()[-1]) == 0
    assert call("verify", str(tmp_path / "nowhere")) == 1
    node = store.load("default").nodes.where("part = 'identity'").first()["id"]
    assert call("redact", "nobody") == 1 and call("redact", node) == 0 and call("search", "turin") == 0 and said == [""]
    assert call("checkout", "9") == 1 and call("--profile", "none", "log") == 1


def test_tools(spark, tmp_path):
    store = Store(spark, str(tmp_path / "root"))
    memory = Memory(store, "a")
    assert memory.enrich("Hi") == "Hi"
    store.init("a")
    store.init("b")
    memory.add_fact("Likes tea", "identity", ["drinks"])
    Memory(store, "b").add_fact("Likes tea", "identity")
    Memory(store, "b").add_fact("Has a cat", "threads")
    assert memory.search("DRINK") == ["Likes tea"] and "- Likes tea\n" in memory.context(500)
    merged = memory.enrich("Hi")
    assert merged.count("Likes tea") == 1 and "- Has cat" in merged and merged.endswith("\n\nHi")
    assert "cat" not in memory.enrich("Hi", ["a"])
