"""Command line of the loop: python -m textloom --root FOLDER COMMAND.

Exit codes: 0 done, 1 failed, 2 a locked file has changed, 3 the cap on costs is reached.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from textloom.operators import model
from textloom.operators.export import SEED
from textloom.plans.loop import Loop
from textloom.sources.config import Drift
from textloom.sources.store import Store


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="python -m textloom", description=__doc__.splitlines()[0])
    out.add_argument("--root", required=True, help="folder of the tables, of any store that Spark writes to")
    sub = out.add_subparsers(dest="command", required=True)
    for name in ("generate", "run-all"):
        p = sub.add_parser(name)
        p.add_argument("--seed", type=int, default=SEED)
        p.add_argument("--count", type=int, default=600)
    for name in ("induce", "run-all"):
        p = sub.choices.get(name) or sub.add_parser(name)
        p.add_argument("--taxonomy", required=True, help="JSON or YAML")
        p.add_argument("--alignment", required=True, help="vendor labels to lists of leaves, JSON or YAML")
    sub.choices["induce"].add_argument("--relock", action="store_true")
    p = sub.add_parser("review", help="takes decisions from JSON lines of doc_id, decision, leaf, seconds; shows what is left without any")
    p.add_argument("--answers")
    p.add_argument("--limit", type=int, default=20)
    sub.add_parser("export").add_argument("--to", required=True)
    for name in ("label", "qa", "improve", "evaluate", "report", "status"):
        sub.add_parser(name)
    return out


def _read(path: str):
    from textloom.sources import config

    text = Path(path).read_text()
    return json.loads(text) if path.endswith(".json") else config.loads(text)


def run(loop: Loop, args: argparse.Namespace) -> int:
    spark = loop.store.spark
    if args.command == "generate":
        return loop.generate(args.count, args.seed)
    if args.command == "induce":
        return loop.induce(args.taxonomy, _read(args.alignment), args.relock)
    if args.command == "run-all":
        code = loop.run_all(args.taxonomy, _read(args.alignment), args.count, args.seed)
        print("the queue awaits review; then: improve, evaluate, report, export" if not code else f"stopped with {code}")
        return code
    if args.command == "review":
        if args.answers:
            return loop.review(spark.read.schema("doc_id long, decision string, leaf string, seconds double").json(args.answers))
        for r in loop.screens().orderBy("place").limit(args.limit).toJSON().collect():
            print(r)
        return 0
    if args.command == "export":
        return loop.export(args.to)
    if args.command == "status":
        print(loop.status())
        return 0
    code = getattr(loop, args.command)()
    if args.command == "report":
        print(loop.store.meta("report") or "evaluate first")
    return code


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    try:
        return run(Loop(Store(spark, args.root)), args)
    except Drift as e:
        print(e, file=sys.stderr)
        return 2
    except model.CapExceeded as e:
        print(e, file=sys.stderr)
        return 3


if __name__ == "__main__":
    sys.exit(main())
