"""LOOKUP, TRAVERSE and SEARCH texts: each is matched as a whole and becomes a small value.

Names keep their case. Anything that begins with SELECT or WITH is left to Spark SQL.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import ParseException
from pyspark.sql import SparkSession

from quarry.errors import QueryError
from quarry.operators.graph import MAX_DEPTH


@dataclass(frozen=True)
class Lookup:
    keys: tuple[str, ...]


@dataclass(frozen=True)
class Traverse:
    start: str
    depth: int
    direction: str
    rel_type: str | None = None


@dataclass(frozen=True)
class Search:
    text: str
    table: str
    where: str | None = None
    limit: int = 10


@dataclass(frozen=True)
class Sql:
    text: str


_KV = re.compile(r"(?is)^\s*select\s+(.+?)\s+from\s+kv\s+where\s+key\s*(?:in\s*\((.*)\)|=\s*(.+?))\s*;?\s*$")
_TRAVERSE = re.compile(r"(?is)^traverse\s+from\s+(\S+)\s+depth\s+(\d+)\s+direction\s+(\w+)(?:\s+type\s+(\S+))?\s*$")
_SEARCH = re.compile(r"(?is)^search\s+(['\"])(.*?)\1\s+in\s+(\w+)(?:\s+where\s+(.*?))?(?:\s+limit\s+(\d+))?\s*$")


def _keys(text: str) -> tuple[str, ...]:
    keys = tuple(k for k in (part.strip().strip("'\"") for part in text.split(",")) if k)
    if not keys:
        raise QueryError("no keys")
    return keys


def parse(text: str) -> Lookup | Traverse | Search | Sql:
    """What a text asks for."""
    t = text.strip()
    word = t.split(None, 1)[0].lower() if t else ""
    if word == "lookup":
        return Lookup(_keys(t[len("lookup") :]))
    if m := _KV.match(t):
        if m[1].strip() != "*":
            raise QueryError("a key query selects *")
        return Lookup(_keys(m[2] or m[3]))
    if word == "traverse":
        if not (m := _TRAVERSE.match(t)):
            raise QueryError("TRAVERSE FROM id DEPTH n DIRECTION out|in|both [TYPE name]")
        depth, direction = int(m[2]), m[3].lower()
        if not 1 <= depth <= MAX_DEPTH:
            raise QueryError(f"depth must be 1 to {MAX_DEPTH}")
        if direction not in ("out", "in", "both"):
            raise QueryError("direction must be out, in or both")
        return Traverse(m[1].strip("'\""), depth, direction, m[4].strip("'\"") if m[4] else None)
    if word == "search":
        if not (m := _SEARCH.match(t)):
            raise QueryError("SEARCH 'text' IN table [WHERE condition] [LIMIT n]")
        return Search(m[2], m[3], m[4], int(m[5]) if m[5] else 10)
    if word in ("select", "with"):
        return Sql(t)
    raise QueryError(f"unknown query: {text!r}")


def _plan(spark: SparkSession, text: str):
    return spark._jsparkSession.sessionState().sqlParser().parsePlan(text)


def validate_sql(spark: SparkSession, text: str) -> bool:
    """Whether Spark's parser takes the text; names aren't looked up."""
    try:
        _plan(spark, text)
    except ParseException:
        return False
    return True


def table_of(spark: SparkSession, text: str) -> str:
    """The table that a query's first FROM names. Derived tables, set operations and queries without FROM have none."""
    try:
        node = _plan(spark, text)
    except ParseException as e:
        raise QueryError(f"not SQL: {text!r}") from e
    while (kind := node.nodeName()) in ("Project", "Filter", "Sort", "Aggregate", "GlobalLimit", "LocalLimit", "Limit", "Offset", "Distinct", "UnresolvedHaving", "Join") or (kind == "SubqueryAlias" and node.children().head().nodeName() == "UnresolvedRelation"):
        node = node.children().head()
    if kind != "UnresolvedRelation":
        raise QueryError("the query's FROM must name a table")
    return node.tableName()
