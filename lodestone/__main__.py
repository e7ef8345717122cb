"""Command line: build an index, ask it, list what it holds.

    python -m lodestone build --index DIR [--update] FILE...
    python -m lodestone ask --index DIR [--scope DOC] [--mode MODE] QUESTION
    python -m lodestone list|tree|reset --index DIR
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from lodestone.config import Config
from lodestone.engine import MODES, Engine
from lodestone.sources.index import Index


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lodestone")
    parser.add_argument("command", choices=["build", "ask", "list", "tree", "reset"])
    parser.add_argument("rest", nargs="*")
    parser.add_argument("--index", default=None)
    parser.add_argument("--scope", default=None)
    parser.add_argument("--mode", choices=sorted(MODES), default="evidence")
    parser.add_argument("--size", type=int, default=800)
    parser.add_argument("--update", action="store_true", help="build into an index that is there, replacing documents it holds")
    given = parser.parse_intermixed_args(args)
    spark = spark or SparkSession.builder.appName("lodestone").getOrCreate()
    config = Config.load()
    path = given.index or config.index_path
    if given.command == "build":
        there = given.update and Index(spark, path).exists()
        engine = Engine.open(spark, path, config) if there else Engine.create(spark, path, config)
        engine.ingest_files(*given.rest, size=given.size, update=given.update)
        print(f"{engine.documents().count()} documents")
        return 0
    engine = Engine.open(spark, path, config)
    if given.command == "ask":
        how, ids, context = engine.retrieve_semantic(" ".join(given.rest), given.scope, given.mode)
        print(how, ids, context, sep="\n")
    elif given.command == "list":
        engine.documents().show(truncate=False)
    elif given.command == "tree":
        engine.tree().show(truncate=False)
    else:
        print(engine.reset() or "")
    return 0


if __name__ == "__main__":
    sys.exit(main())
