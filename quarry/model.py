"""Row types: system columns, built-in tables, and JSON Schema compiled to Spark types."""

from __future__ import annotations

from typing import Any

from pyspark.sql import types as T

EDGE = T.StructType([T.StructField("dst", T.StringType()), T.StructField("rel_type", T.StringType()), T.StructField("properties", T.MapType(T.StringType(), T.StringType())), T.StructField("created_at", T.TimestampType())])
SYSTEM = [
    T.StructField("tenant_id", T.StringType(), False),
    T.StructField("id", T.StringType(), False),
    T.StructField("entity_type", T.StringType(), False),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("modified_at", T.TimestampType()),
    T.StructField("deleted_at", T.TimestampType()),
    T.StructField("edges", T.ArrayType(EDGE)),
]
SYSTEM_NAMES = [f.name for f in SYSTEM]
_PLAIN = {"string": T.StringType(), "integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType()}


def spark_type(node: dict[str, Any]) -> T.DataType:
    """The type of a JSON Schema node; unions with null are nullable, objects without properties are maps of strings."""
    kind = node.get("type")
    if kind is None and "anyOf" in node:
        others = [n for n in node["anyOf"] if n.get("type") != "null"]
        return spark_type(others[0]) if len(others) == 1 else T.StringType()
    if isinstance(kind, list):
        others = [k for k in kind if k != "null"]
        return spark_type({**node, "type": others[0]}) if len(others) == 1 else T.StringType()
    if kind == "array":
        return T.ArrayType(spark_type(node.get("items", {"type": "string"})))
    if kind == "object":
        return struct_type(node) if node.get("properties") else T.MapType(T.StringType(), T.StringType())
    if kind == "string" and node.get("format") == "date-time":
        return T.TimestampType()
    return _PLAIN.get(kind, T.StringType())


def struct_type(schema: dict[str, Any]) -> T.StructType:
    need = set(schema.get("required", []))
    return T.StructType([T.StructField(n, spark_type(p), n not in need) for n, p in schema.get("properties", {}).items()])


def _table(title: str, key: str, required: str, /, **fields: str) -> dict[str, Any]:
    """A built-in schema; field kinds: s string, i integer, n number, t time, a list of strings, o object."""
    kinds = {"s": {"type": "string"}, "i": {"type": "integer"}, "n": {"type": "number"}, "t": {"type": "string", "format": "date-time"}, "a": {"type": "array", "items": {"type": "string"}}, "o": {"type": "object"}}
    return {"title": title, "description": f"Built-in table {title}", "version": "1.0.0", "short_name": title, "type": "object", "properties": {n: {**kinds[k], "description": n} for n, k in fields.items()}, "required": required.split(), "key_field": key, "category": "system"}


#: The fields of the built-in tables.
BUILT_IN = {
    s["title"]: s
    for s in (
        _table("documents", "uri", "name uri", name="s", uri="s", content_type="s", file_size="i", file_hash="s", category="s", tags="a", sentiment_tags="a", active_start_time="t", active_end_time="t", chunk_count="i", metadata="o"),
        _table("resources", "uri", "name content uri chunk_ordinal", name="s", content="s", uri="s", chunk_ordinal="i", content_type="s", category="s", tags="a", sentiment_tags="a", active_start_time="t", active_end_time="t", document_id="s", metadata="o"),
        _table("sessions", "session_id", "session_id tenant_id created_at updated_at", session_id="s", tenant_id="s", agent_uri="s", message_count="i", metadata="o", created_at="t", updated_at="t"),
        _table("messages", "message_id", "message_id session_id tenant_id role content timestamp", message_id="s", session_id="s", tenant_id="s", role="s", content="s", model="s", timestamp="t", usage="o", trace_id="s", span_id="s"),
        _table("feedback", "feedback_id", "feedback_id session_id tenant_id timestamp", feedback_id="s", session_id="s", message_id="s", tenant_id="s", trace_id="s", span_id="s", label="s", score="n", feedback_text="s", user_id="s", timestamp="t", metadata="o"),
        _table("moments", "name", "name summary start_time end_time moment_type", name="s", summary="s", start_time="t", end_time="t", moment_type="s", tags="a", emotion_tags="a", people="a", resource_ids="a", session_ids="a", metadata="o"),
    )
}
