"""Command line: ``python -m memspool.cli COMMAND``; ``MEMSPOOL_HOME`` is the store's root."""

from __future__ import annotations

import argparse
import os
import sys
import uuid
from pathlib import Path


from .operators.context import inspect_report
from .operators.recall import report
from .schema import FORMAT_VERSION, PARTS
from .session import session
from .sources.packs import IntegrityError, pack_errors
from .sources.scratch import shared_dir
from .sources.store import Store
from .tools import Memory


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="memspool")
    p.add_argument("--home", default=os.environ.get("MEMSPOOL_HOME", str(Path.home() / ".memspool")))
    p.add_argument("--profile", default=os.environ.get("MEMSPOOL_PROFILE", "default"))
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *arguments: tuple, **flags: dict) -> None:
        c = sub.add_parser(name)
        for a in arguments:
            c.add_argument(a[0], **(a[1] if len(a) > 1 else {}))
        for k, v in flags.items():
            c.add_argument(f"--{k}", **v)

    flag, budget = {"action": "store_true"}, {"type": int, "default": 2000}
    add("init")
    add("extract", ("history",), force=flag)
    add("inspect")
    add("diff", ("rev_a", {"nargs": "?", "default": "HEAD~1"}), ("rev_b", {"nargs": "?", "default": "HEAD"}))
    add("log")
    add("checkout", ("rev",))
    add("inject", budget=budget, query={"default": ""})
    add("search", ("query",))
    add("eval", ("questions",), budget=budget, scoped=flag, verbose=flag)
    add("verify", ("path",))
    add("redact", ("node_id",))
    add("export", ("dest",))
    add("import", ("source",), force=flag)
    return p


def _rev(text: str) -> int | str:
    return int(text) if text.isdigit() and len(text) < 7 else text


def run(args: list[str], store: Store | None = None, adapter=None, out=print) -> int:
    a = _parser().parse_args(args)
    spark = store.spark if store else session()
    store = store or Store(spark, a.home)
    p, memory = a.profile, Memory(store, a.profile)
    try:
        if a.command == "init":
            out(f"initialized profile '{p}' at {store.init(p)[:8]}")
        elif a.command == "extract":
            from .plans.extract import extract_history
            from .plans.models import adapter_from_env

            if p not in store.profiles():
                store.init(p)
            pack = extract_history(spark, a.history, adapter or adapter_from_env(), f"{shared_dir(spark)}/extract-{uuid.uuid4().hex}", store.load(p), force=a.force)
            sha = store.commit(pack, p, f"extract from {Path(a.history).name}")
            out(f"{pack.nodes.count()} nodes, commit {sha[:8]}")
        elif a.command == "inspect":
            pack = store.load(p)
            out(f"format {FORMAT_VERSION}, {store.log(p).first()['ts'][:16].replace('T', ' ')} UTC")
            for r in inspect_report(pack.nodes, pack.style).orderBy("n").toLocalIterator():
                out(r["line"])
        elif a.command == "diff":
            out("\n".join(store.diff(p, _rev(a.rev_a), _rev(a.rev_b))) or "no memory changes")
        elif a.command == "log":
            for r in store.log(p).collect():
                out(f"{r['sha']}  {r['ts']}  {r['message']}")
        elif a.command == "checkout":
            out(f"restored {a.rev} as {store.checkout(p, _rev(a.rev))[:8]}")
        elif a.command == "inject":
            out(memory.context(a.budget, a.query))
        elif a.command == "search":
            out("\n".join(memory.search(a.query)))
        elif a.command == "eval":
            from .plans.extract import run_eval
            from .plans.models import adapter_from_env
            from .sources.benchprep import read_questions

            pack = store.load(p)
            card = spark.createDataFrame([(pack.style,)], "text string")
            results = run_eval(pack.nodes, card, read_questions(spark, a.questions), adapter or adapter_from_env(), f"{shared_dir(spark)}/eval-{uuid.uuid4().hex}", a.budget, a.scoped)
            for r in report(results, a.budget, a.verbose).orderBy("n").toLocalIterator():
                out(r["line"])
        elif a.command == "verify":
            if errors := pack_errors(spark, a.path):
                for e in errors:
                    out(f"FAIL {e}")
                return 1
            out(f"ok: {a.path} verifies")
        elif a.command == "redact":
            out(f"redacted {a.node_id}; history squashed at {store.redact(p, a.node_id)[:8]}")
        elif a.command == "export":
            out(f"exported {store.export(p, a.dest)}")
        elif a.command == "import":
            out(f"imported into '{p}' as {store.import_(a.source, p, a.force)[:8]}")
    except (IntegrityError, KeyError, FileNotFoundError, FileExistsError) as e:
        out(f"FAIL {e}")
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
