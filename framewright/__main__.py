"""``python -m framewright run SCRIPT | exec CODE | cache list|clear|import``: scripts and the memo store of a workspace."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from framewright.plans import Workspace
from framewright.sources.memo import MemoStore
from framewright.sources.objects import ObjectStore


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("framewright")
    p.add_argument("-w", "--workspace", default="workspace")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="run a script that joins operators; their names are there")
    run.add_argument("script")
    sub.add_parser("exec", help="the same of code on the command line").add_argument("code")
    cache = sub.add_parser("cache").add_subparsers(dest="action", required=True)
    for name in ("list", "clear", "import"):
        c = cache.add_parser(name)
        if name == "import":
            c.add_argument("source", nargs="+")
        c.add_argument("--pattern", default="*")
        c.add_argument("-d", "--domain")
        if name == "clear":
            c.add_argument("-f", "--force", action="store_true")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.getOrCreate()
    with Workspace(spark, a.workspace) as w:
        if a.command in ("run", "exec"):
            import framewright.nodes as nodes

            code, name = (a.code, "<command line>") if a.command == "exec" else (Path(a.script).read_text(), a.script)
            exec(compile(code, name, "exec"), {"__name__": "__pipeline__", "workspace": w, **{n: getattr(nodes, n) for n in nodes.__all__}})
            w.run()
        elif a.action == "list":
            for r in w.memo.list(a.pattern, a.domain).select("key", "domain", "value", "updated_at").orderBy("key", "domain").toLocalIterator():
                print(r.key, r.domain or "-", r.updated_at, r.value, sep="\t")
        elif a.action == "clear":
            n = w.memo.count(a.pattern, a.domain)
            if not a.force and input(f"Delete {n} entries? [y/N] ").strip().lower() != "y":
                return 1
            print(f"{w.memo.clear(a.pattern, a.domain)} entries deleted")
        else:
            for source in a.source:
                objects = w.objects.import_from(ObjectStore(spark, f"{source}/objects"))
                print(f"{source}: {objects} objects and {w.memo.import_from(MemoStore(spark, f'{source}/memo'), a.pattern, a.domain)} entries imported")
    return 0


if __name__ == "__main__":
    sys.exit(main())
