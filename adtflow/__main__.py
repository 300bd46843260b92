"""python -m adtflow: run, explain, describe, fmt, schema and preview over Parquet files."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="adtflow", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, what in (("run", "run a query and print JSON lines"), ("explain", "print the plan"), ("describe", "print parameters, columns and cardinality")):
        c = sub.add_parser(name, help=what)
        c.add_argument("query", help="the query, or a file with it")
        c.add_argument("--table", action="append", default=[], metavar="NAME=PATH", help="a Parquet table")
        c.add_argument("--required", action="store_true", help="columns hold no nulls")
        c.add_argument("--key", action="append", default=[], metavar="NAME=COLUMN", help="a table's key, which pages need")
        if name == "explain":
            c.add_argument("--analyze", action="store_true")
    sub.add_parser("fmt", help="print a query or script in canonical form").add_argument("query")
    for name in ("schema", "preview"):
        c = sub.add_parser(name, help="columns of a Parquet table" if name == "schema" else "some of its rows")
        c.add_argument("path")
        if name == "preview":
            c.add_argument("--columns", nargs="*", default=[])
            c.add_argument("--offset", type=int, default=0)
            c.add_argument("--limit", type=int, default=20)
    a = p.parse_args(argv)

    from adtflow.errors import QueryError

    try:
        text = lambda q: Path(q).read_text(encoding="utf-8") if len(q) < 4096 and "\n" not in q and Path(q).is_file() else q
        if a.command == "fmt":
            from adtflow.lang.formatter import format_query

            print(format_query(text(a.query)), end="")
            return 0
        from pyspark.sql import SparkSession

        from adtflow.engine import Engine
        from adtflow.sources.files import metadata, preview
        from adtflow.streaming.pipelines import json_lines

        spark = SparkSession.builder.getOrCreate()
        if a.command == "schema":
            print(json.dumps(metadata(spark, a.path), indent=2))
        elif a.command == "preview":
            for line in preview(spark, a.path, a.columns, a.offset, a.limit).toJSON().toLocalIterator():
                print(line)
        else:
            e = Engine(spark)
            keys = dict(k.split("=", 1) for k in a.key)
            for t in a.table:
                name, _, path = t.partition("=")
                e.parquet(path, name, "all" if a.required else (), keys.get(name))
            q = text(a.query)
            if a.command == "run":
                for line in json_lines(e.query(q)):
                    print(line)
            else:
                print(json.dumps(e.explain(q, a.analyze) if a.command == "explain" else e.describe(q), indent=2))
    except QueryError as error:
        print(error, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
