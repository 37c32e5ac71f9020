"""python -m quarry PATH COMMAND ...: the engine's verbs from a shell; results are printed as JSON lines."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.plans.engine import Engine
from quarry.session import session
from quarry.sources.readers import parse_jsonl, read_jsonl


#: Commands and what they take; ? marks what may be left out.
COMMANDS = {
    "query": "text", "ask": "text", "lookup": "key", "get": "table id", "list": "table", "count": "table", "search": "table text", "traverse": "start depth direction", "schemas": "", "schema": "table",
    "ingest": "table file", "insert": "table json?", "update": "table id json", "delete": "table id", "export": "table target kind", "add-edge": "src dst rel_type", "get-edges": "node", "delete-edge": "src dst rel_type",
}


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="quarry")
    p.add_argument("path")
    p.add_argument("--tenant", default="default")
    p.add_argument("--schema", action="append", default=[], help="a JSON Schema file to register first")
    c = p.add_subparsers(dest="command", required=True)
    for name, args in COMMANDS.items():
        s = c.add_parser(name)
        for a in args.split():
            s.add_argument(a.rstrip("?"), **({"nargs": "?"} if a.endswith("?") else {}))
    a = p.parse_args(argv)
    spark = session()
    engine = Engine(spark, a.path, a.tenant)
    for f in a.schema:
        with open(f) as text:
            engine.register_schema(json.load(text))

    def rows_of(lines: list[str]) -> tuple[DataFrame, int]:
        """Rows of JSON lines, and how many lines are none."""
        good, bad = parse_jsonl(spark.createDataFrame([(x,) for x in lines], "value string"), engine.registry.struct(a.table))
        return good, bad.count()

    ids = lambda: spark.createDataFrame([(a.id,)], "id string")
    edge = lambda: spark.createDataFrame([(a.src, a.dst, a.rel_type)], "src string, dst string, rel_type string")

    def ingest() -> dict:
        good, bad = read_jsonl(spark, a.file, engine.registry.struct(a.table))
        return {"version": engine.insert(a.table, good), "bad_lines": bad.count()}

    def insert() -> dict:
        good, bad = rows_of([a.json] if a.json else sys.stdin.read().splitlines())  # a batch that someone pipes in
        return {"version": engine.insert(a.table, good), "bad_lines": bad}

    def update() -> dict:
        changes, kinds = json.loads(a.json), engine.registry.struct(a.table)
        return {"version": engine.update(a.table, spark.createDataFrame([(a.id, *changes.values())], T.StructType([T.StructField("id", T.StringType()), *[kinds[k] for k in changes]])))}

    does = {
        "count": lambda: engine.count(a.table), "ingest": ingest, "insert": insert, "update": update, "export": lambda: engine.export(a.table, a.target, a.kind),
        "delete": lambda: {"version": engine.delete(a.table, ids())}, "schema": lambda: engine.registry.get(a.table), "add-edge": lambda: {"version": engine.add_edges(edge())}, "delete-edge": lambda: {"version": engine.delete_edges(edge())},
    }
    shows = {
        "query": lambda: engine.query(a.text), "lookup": lambda: engine.lookup(a.key), "list": lambda: engine.list(a.table), "schemas": lambda: engine.registry.table(spark), "search": lambda: engine.search(a.table, a.text),
        "get": lambda: engine.get(a.table, a.id), "get-edges": lambda: engine.edges_of(a.node), "traverse": lambda: engine.traverse(a.start, int(a.depth), a.direction), "ask": lambda: engine.ask(a.text),
    }
    if a.command in shows:
        for row in shows[a.command]().select(F.to_json(F.struct("*")).alias("j")).toLocalIterator():
            print(row["j"])
    elif (made := does[a.command]()) is not None:
        print(json.dumps(made))


if __name__ == "__main__":
    main()
