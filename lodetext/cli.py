"""python -m lodetext.cli VERB ...: create-table, add-index, drop-index, index, query, compact, vacuum."""

from __future__ import annotations

import argparse
import dataclasses
import json

from pyspark.sql import SparkSession

from lodetext.table import SearchTable


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodetext")
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, *args: tuple[str, dict]):
        v = verbs.add_parser(name)
        v.add_argument("--table", required=True, help="the table's folder")
        for arg, options in args:
            v.add_argument(arg, **options)

    column = ("--column", {"required": True})
    verb("create-table", ("--name", {"required": True}), ("--location", {"required": True}), ("--columns", {"nargs": "*", "default": []}))
    verb("add-index", column)
    verb("drop-index", column)
    verb("index", ("--columns", {"nargs": "*"}), ("--files", {"nargs": "*"}))
    verb("query", ("--column", {}), ("--match", {}), ("--operator", {"default": "or", "choices": ["or", "and"]}), ("--json", {}), ("--select", {"nargs": "*", "default": []}), ("--limit", {"type": int}), ("--score", {"default": "none"}))
    verb("compact", column)
    verb("vacuum", ("--grace-seconds", {"type": float, "default": 3600}))
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("lodetext").getOrCreate()
    if a.verb == "create-table":
        table = SearchTable.create(spark, a.table, a.name, a.location, a.columns)
        table.register_files()
        out = {"table_id": table.state()["table_id"]}
    else:
        table = SearchTable.open(spark, a.table, "r" if a.verb == "query" else "rw")
        if a.verb == "add-index":
            out = {"columns": [table.add_index(a.column), table.columns()][1]}
        elif a.verb == "drop-index":
            out = {"columns": [table.drop_index(a.column), table.columns()][1]}
        elif a.verb == "index":
            out = {"results": [dataclasses.asdict(r) for r in table.index(a.columns, a.files)]}
        elif a.verb == "compact":
            out = dataclasses.asdict(table.compact(a.column))
        elif a.verb == "vacuum":
            out = dataclasses.asdict(table.vacuum(a.grace_seconds))
        else:
            query = json.loads(a.json) if a.json else {"column": a.column, "match": a.match, "operator": a.operator}
            rows = [json.loads(r) for r in table.search(query, a.select, a.limit, a.score).toJSON().toLocalIterator()]
            stats = table.search_stats(query)
            out = {"rows": rows, "stats": dataclasses.asdict(stats) | {"rows_scanned": stats.rows_scanned}}
    print(json.dumps(out, indent=2, default=str))
    return out


if __name__ == "__main__":
    main()
