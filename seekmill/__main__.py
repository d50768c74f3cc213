"""Command line: python -m seekmill COMMAND --index FOLDER ..."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekmill.config import Config
from seekmill.plans.engine import Engine
from seekmill.session import get_session, ship
from seekmill.sources import files, wiki


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="seekmill", description="Build and query an index of documents.")
    top.add_argument("--index", required=True, help="folder of the index, a URI that all executors reach")
    top.add_argument("--config", help="TOML file")
    sub = top.add_subparsers(dest="command", required=True)
    add = sub.add_parser("index", help="index files of text, or tables with id and content")
    add.add_argument("source")
    add.add_argument("--format", choices=("files", "parquet", "wiki"), default="files")
    add.add_argument("--whole", action="store_true", help="a document is one chunk")
    add.add_argument("--no-dedup", action="store_true")
    search = sub.add_parser("search", help="print the best documents as JSON lines")
    search.add_argument("query")
    search.add_argument("--top", type=int, default=10)
    delete = sub.add_parser("delete", help="delete documents by id")
    delete.add_argument("ids", nargs="+")
    export = sub.add_parser("export", help="write all chunks")
    export.add_argument("path")
    export.add_argument("--format", choices=("jsonl", "json"), default="jsonl")
    for name, text in (("stats", "print counts"), ("rebuild", "build the lexical index anew"), ("compact", "fold segments"), ("clear", "delete everything")):
        sub.add_parser(name, help=text)
    return top


def _documents(spark, args: argparse.Namespace) -> DataFrame:
    if args.format == "parquet":
        return spark.read.parquet(args.source)
    if args.format == "wiki":
        return wiki.page_documents(wiki.read_pages(spark, args.source)).withColumn("ts", F.col("modified")).drop("modified")
    return files.read_files(spark, args.source).select(F.col("path").alias("id"), "content")


def main(argv: list[str] | None = None, out=sys.stdout) -> int:
    args = _parser().parse_args(argv)
    config = Config()
    if args.config:
        with open(args.config, encoding="utf-8") as f:
            config = Config.from_toml(f.read())
    spark = get_session("seekmill")
    ship(spark)
    engine = Engine(spark, args.index, config, "read" if args.command in ("search", "stats", "export") else "open")
    show = lambda **fields: print(json.dumps(fields, default=str), file=out)
    if args.command == "index":
        show(chunks=engine.index(_documents(spark, args), args.whole, False if args.no_dedup else None))
    elif args.command == "search":
        for row in engine.answer(args.query, args.top)[1].orderBy("index").collect():  # at most top rows
            show(**row.asDict())
    elif args.command == "delete":
        show(deleted=engine.delete(args.ids))
    elif args.command == "stats":
        show(**engine.stats().first().asDict())
    elif args.command == "export":
        engine.export(args.path, args.format)
    elif args.command == "rebuild":
        engine.rebuild_lexical()
    elif args.command == "compact":
        engine.store.compact()
    else:
        engine.clear()
    return 0


if __name__ == "__main__":
    sys.exit(main())
