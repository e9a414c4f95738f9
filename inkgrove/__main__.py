"""``python -m inkgrove build|search|lint|status|eval ROOT INDEX ...``"""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession

from inkgrove.engine import Engine


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="inkgrove", description="Index, search and check a folder of notes.")
    p.add_argument("command", choices=("build", "search", "lint", "status", "eval"))
    p.add_argument("root")
    p.add_argument("index")
    p.add_argument("query", nargs="?", default="", help="the query, or the golden file of eval")
    p.add_argument("--mode", default="hybrid")
    p.add_argument("--folder", default="")
    p.add_argument("--k", type=int, default=5)
    p.add_argument("--rebuild", action="store_true")
    a = p.parse_args(argv)
    engine = Engine(SparkSession.builder.appName("inkgrove").getOrCreate(), a.root, a.index)
    if a.command == "build":
        print(json.dumps(engine.build(a.rebuild)))
    elif a.command == "search":
        print(engine.search(a.query, a.k, a.mode, a.folder).text(a.query))
    elif a.command == "lint":
        engine.lint(a.folder).orderBy("kind", "rel_path").show(1000, truncate=False)
    elif a.command == "status":
        print(json.dumps(engine.status(), indent=1))
    else:
        engine.evaluate(json.loads(Path(a.query).read_text()), a.k).show(truncate=False)


if __name__ == "__main__":
    main()
