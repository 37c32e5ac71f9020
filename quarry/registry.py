"""Schema registry: declared tables, their versions, categories and extras."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.errors import QuarryError, SchemaNotFound, ValidationFailed
from quarry.model import BUILT_IN, struct_type
from quarry.sources import files

CATEGORIES = ("system", "agents", "public", "user")


def extra(schema: dict[str, Any], name: str, default: Any = None) -> Any:
    """An extra of a schema: under json_schema_extra, or merged into the top level."""
    return schema.get("json_schema_extra", {}).get(name, schema.get(name, default))


class Registry:
    def __init__(self) -> None:
        self._schemas: dict[str, dict] = {}
        self._versions: dict[str, list[str]] = {}
        for s in BUILT_IN.values():
            self.register(s)

    @staticmethod
    def name_of(schema: dict) -> str:
        return extra(schema, "name") or schema.get("short_name") or schema["title"].lower()

    def register(self, schema: dict) -> str:
        """Checks and adds a schema. A higher major version than the registered one is refused."""
        problems = [f"{k} is missing" for k in ("title", "description", "properties") if not schema.get(k)]
        version = extra(schema, "version")
        if not version or len(parts := str(version).split(".")) != 3 or not all(p.isdigit() for p in parts):
            problems.append("version must be major.minor.patch")
        problems += [f"{n} has no description" for n, p in schema.get("properties", {}).items() if not p.get("description")]
        if self.category(schema) not in CATEGORIES:
            problems.append(f"unknown category {self.category(schema)}")
        if problems:
            raise ValidationFailed(problems)
        name = self.name_of(schema)
        old = self._schemas.get(name)
        if old and int(str(version).split(".")[0]) > int(extra(old, "version").split(".")[0]):
            raise ValidationFailed([f"{name}: a new major version needs a new name"])
        self._schemas[name] = schema
        self._versions.setdefault(name, []).append(version)
        return name

    def get(self, name: str) -> dict:
        if name not in self._schemas:
            raise SchemaNotFound(name)
        return self._schemas[name]

    def has(self, name: str) -> bool:
        return name in self._schemas

    def names(self, category: str | None = None) -> list[str]:
        return [n for n, s in self._schemas.items() if category is None or self.category(s) == category]

    def versions(self, name: str) -> list[str]:
        """In the order of registration."""
        self.get(name)
        return list(self._versions[name])

    def remove(self, name: str) -> None:
        if self.category(self.get(name)) == "system":
            raise QuarryError(f"{name} is a system schema")
        del self._schemas[name], self._versions[name]

    @staticmethod
    def category(schema: dict) -> str:
        return extra(schema, "category", "user")

    def key_field(self, name: str) -> str | None:
        return extra(self.get(name), "key_field")

    def embedding_fields(self, name: str) -> list[str]:
        return extra(self.get(name), "embedding_fields", [])

    def indexed_fields(self, name: str) -> list[str]:
        return extra(self.get(name), "indexed_fields", [])

    def is_agent(self, name: str) -> bool:
        s = self.get(name)
        return bool(extra(s, "tools") or extra(s, "resources"))

    def struct(self, name: str):
        return struct_type(self.get(name))

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(n, self.category(s), extra(s, "version"), s.get("description"), extra(s, "key_field")) for n, s in self._schemas.items()]
        return spark.createDataFrame(rows, "name string, category string, version string, description string, key_field string")

    def violations(self, name: str, rows: DataFrame) -> DataFrame:
        """rows with `problems`: the declared rules that each one breaks (required fields, types, enums, ranges, lengths, patterns, formats)."""
        s = self.get(name)
        tests = [F.when(F.col(n).isNull() if n in rows.columns else F.lit(True), F.lit(f"{n} is required")) for n in s.get("required", [])]
        for n, p in s["properties"].items():
            if n in rows.columns:
                tests += [F.when(test, F.lit(f"{n} {what}")) for what, test in _breaks(F.col(n), rows.schema[n].dataType, p)]
        found = F.filter(F.array(*tests), lambda x: x.isNotNull()) if tests else F.array().cast("array<string>")
        return rows.withColumn("problems", found)

    def load(self, spark: SparkSession, folder: str) -> None:
        """Adds the schemas that save() left in a folder, each name's versions in their order."""
        for f in files.names(spark, folder):
            if f.endswith(".json"):
                self.register(json.loads(files.read(spark, f"{folder}/{f}")))

    def save(self, spark: SparkSession, folder: str, name: str) -> None:
        """Writes a schema's current version; system schemas come with the package."""
        s = self.get(name)
        if self.category(s) != "system":
            files.write(spark, f"{folder}/{name}-{len(self._versions[name]):06d}.json", json.dumps(s))


#: Formats of JSON Schema and the patterns that they stand for here.
FORMATS = {
    "date": r"^\d{4}-\d{2}-\d{2}$", "date-time": r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})?$", "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$",
    "uri": r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$", "uuid": r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
}
_KINDS = {"string": (T.StringType, T.TimestampType, T.TimestampNTZType, T.DateType), "integer": (T.IntegralType,), "number": (T.NumericType,), "boolean": (T.BooleanType,), "array": (T.ArrayType,), "object": (T.StructType, T.MapType)}


def _breaks(c, kind: T.DataType, rule: dict) -> list[tuple]:
    """(what is wrong, test) for one field; a null breaks none of these."""
    out = []
    wanted = rule.get("type")
    wanted = [w for w in (wanted if isinstance(wanted, list) else [wanted]) if w and w != "null"]
    if wanted and not isinstance(kind, T.NullType) and not any(isinstance(kind, _KINDS[w]) for w in wanted if w in _KINDS):
        casts = {"integer": c.cast("string").rlike(r"^[+-]?\d+$"), "number": c.try_cast("double").isNotNull(), "boolean": c.try_cast("boolean").isNotNull()}
        fits = [casts[w] for w in wanted if w in casts and isinstance(kind, (T.StringType, T.NumericType))]
        ok = F.lit(False)
        for f in fits:
            ok = ok | f
        out.append((f"is not of type {' or '.join(wanted)}", c.isNotNull() & ~ok))
    if "enum" in rule:
        out.append(("is not one of its values", ~c.isin(rule["enum"])))
    number = c.try_cast("double") if not isinstance(kind, (T.ArrayType, T.StructType, T.MapType)) else F.lit(None).cast("double")
    for name, test in (("minimum", lambda x: number < x), ("maximum", lambda x: number > x), ("exclusiveMinimum", lambda x: number <= x), ("exclusiveMaximum", lambda x: number >= x)):
        if name in rule:
            out.append((f"is out of range: {name} {rule[name]}", test(rule[name])))
    if isinstance(kind, T.StringType):
        for name, test in (("minLength", lambda x: F.length(c) < x), ("maxLength", lambda x: F.length(c) > x), ("pattern", lambda x: ~c.rlike(x)), ("format", lambda x: ~c.rlike(FORMATS[x]) if x in FORMATS else F.lit(False))):
            if name in rule:
                out.append((f"breaks {name} {rule[name]}", test(rule[name])))
    if isinstance(kind, T.ArrayType):
        for name, test in (("minItems", lambda x: F.size(c) < x), ("maxItems", lambda x: F.size(c) > x)):
            if name in rule:
                out.append((f"breaks {name} {rule[name]}", c.isNotNull() & test(rule[name])))
    return out
