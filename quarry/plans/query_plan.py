"""Plans from questions: a shortcut for identifiers, an injected planner for the rest, staged execution."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from quarry.errors import QueryError

TYPES = ("lookup", "search", "traverse", "sql", "hybrid")
_IDENTIFIER = re.compile(r"^[^\W_][\w-]*$")


@dataclass(frozen=True)
class QueryPlan:
    """A plan with a confidence of 0 to 1; one under 0.6 has to say why."""

    kind: str
    query: str
    confidence: float = 1.0
    explanation: str | None = None
    fallbacks: tuple[QueryPlan, ...] = field(default=())

    def __post_init__(self) -> None:
        if self.kind not in TYPES:
            raise QueryError(f"unknown plan type {self.kind}")
        if not 0 <= self.confidence <= 1:
            raise QueryError("confidence must be 0 to 1")
        if self.confidence < 0.6 and not self.explanation:
            raise QueryError("a plan of low confidence needs an explanation")


def is_identifier(question: str) -> bool:
    q = question.strip()
    return 1 <= len(q.encode()) <= 50 and bool(_IDENTIFIER.match(q))


def strip_markdown(text: str) -> str:
    m = re.match(r"(?s)^\s*```(?:json)?\s*\n?(.*?)\n?\s*```\s*$", text)
    return (m[1] if m else text).strip()


def plan(question: str, planner: Callable[[str], str] | None = None) -> QueryPlan:
    """A lookup for a bare identifier; else what the planner (question -> JSON) answers."""
    if is_identifier(question):
        return QueryPlan("lookup", f"LOOKUP '{question.strip()}'")
    if planner is None:
        raise QueryError("this question needs a planner")
    made = json.loads(strip_markdown(planner(question)))
    build = lambda d: QueryPlan(d["kind"], d["query"], float(d.get("confidence", 1.0)), d.get("explanation"), tuple(build(f) for f in d.get("fallbacks", ())))
    return build(made)


def run_staged(made: QueryPlan, execute: Callable[[str], DataFrame]) -> tuple[DataFrame, list[tuple[str, bool]]]:
    """The first stage that finds rows, and (query, found) of each stage that ran."""
    stages = []
    for p in (made, *made.fallbacks):
        df = execute(p.query)
        found = not df.isEmpty()
        stages.append((p.query, found))
        if found:
            break
    return df, stages


def lookup(*keys: str) -> dict:
    return {"type": "lookup", "keys": list(keys)}


def search(text: str, table: str, limit: int = 10, **filters) -> dict:
    return {"type": "search", "query": text, "table": table, "limit": limit, "filters": filters}


def traverse(start: str, depth: int = 1, direction: str = "out", rel_type: str | None = None) -> dict:
    return {"type": "traverse", "start": start, "depth": depth, "direction": direction, "rel_type": rel_type}


def sql(table: str, fields: list[str] | None = None, limit: int | None = None, **filters) -> dict:
    return {"type": "sql", "table": table, "fields": fields or ["*"], "limit": limit, "filters": filters}


def conditions(filters: dict) -> list:
    """Columns of filters; a text that starts with <, <=, > or >= compares, anything else is equality. Values never become SQL text."""
    from quarry.operators import predicates as p

    tests = {"<": p.lt, "<=": p.le, ">": p.gt, ">=": p.ge}
    out = []
    for name, value in filters.items():
        m = re.match(r"^(<=|>=|<|>)\s*(.+)$", value) if isinstance(value, str) else None
        if m:
            try:
                out.append(tests[m[1]](name, float(m[2])))
            except ValueError:
                out.append(tests[m[1]](name, m[2]))
        elif isinstance(value, list):
            out.append(p.is_in(name, value))
        else:
            out.append(p.eq(name, value))
    return out
