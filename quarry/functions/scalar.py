"""Scalar functions as Columns: identity, keys, comparison, text measures and formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_C = Column | str


def col(c: _C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_fold(c: _C) -> Column:
    """A-Z in lower case; other letters as they are."""
    return F.translate(col(c), _UPPER, _LOWER)


def eq_ci(a: _C, b: Column) -> Column:
    """Equality of strings without regard to ASCII case; a null is equal to nothing."""
    return F.coalesce(ascii_fold(a) == ascii_fold(b), F.lit(False))


def entity_uuid(entity_type: _C, value: _C, ordinal: _C | None = None) -> Column:
    """A stable id of "type:value[:ordinal]": the MD5 digits with the version and variant of a name-based UUID; null without a value."""
    parts = [col(entity_type), col(value).cast("string"), *([] if ordinal is None else [col(ordinal).cast("string")])]
    h = F.md5(F.concat_ws(":", *parts))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.when(col(value).isNotNull(), F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12)))


def key_value(columns: list[str], key_field: str | None = None) -> Column:
    """The value that a row is looked up by: uri, the declared key, key or name, whichever comes first and isn't null."""
    order = [c for c in ("uri", key_field, "key", "name") if c and c in columns]
    return F.coalesce(*[F.col(c).cast("string") for c in order]) if order else F.lit(None).cast("string")


def value_to_string(c: _C, kind) -> Column:
    """Strings, numbers and truth values as they are; lists, structs and maps as JSON. kind: the column's type."""
    from pyspark.sql import types as T

    return F.to_json(col(c)) if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)) else col(c).cast("string")


def is_uuid(c: _C) -> Column:
    return F.coalesce(col(c).rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), F.lit(False))


def is_entity_lookup(c: _C) -> Column:
    """Whether a question is a bare identifier: 1 to 50 bytes, letters and digits first, then also - and _."""
    t = F.trim(col(c))
    return F.coalesce(t.rlike(r"^[\p{L}\p{N}][\p{L}\p{N}_-]*$") & (F.octet_length(t) <= 50), F.lit(False))


def tokens(c: _C, min_length: int = 2) -> Column:
    """Lower-case runs of letters and digits of at least min_length."""
    return F.filter(F.split(F.lower(F.coalesce(col(c), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) >= min_length)


def strip_suffix(c: _C) -> Column:
    """A light stem: -ing, -ed or -s off words that stay at least three letters long."""
    return F.regexp_replace(col(c), r"^(.{3,}?)(ing|ed|s)$", "$1")


def estimate_tokens(c: _C) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(F.coalesce(col(c), F.lit(""))) / 4).cast("long")


def chunk_budget(context: _C, overhead: int = 2000, reserve: float = 0.2) -> Column:
    """Tokens of a context window that are left for a chunk."""
    return (col(context) - overhead - F.floor(col(context) * reserve)).cast("long")


def minutes_seconds(seconds: _C) -> Column:
    s = F.floor(col(seconds)).cast("long")
    return F.format_string("%02d:%02d", F.floor(s / 60), s % 60)


def markdown_cell(c: _C) -> Column:
    """Text for a table cell: null is empty, bars are escaped, line breaks become spaces."""
    return F.replace(F.replace(F.coalesce(col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def markdown_row(*cells: _C) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[markdown_cell(c) for c in cells]), F.lit(" |"))


def markdown_head(names: list[str]) -> str:
    return "| " + " | ".join(names) + " |\n| " + " | ".join(["---"] * len(names)) + " |"


def semver(c: _C) -> Column:
    """array(major, minor, patch) of longs; null where the text isn't a version."""
    ok = col(c).rlike(r"^\d+\.\d+\.\d+$")
    return F.when(ok, F.transform(F.split(col(c), r"\."), lambda x: x.cast("long")))


def semver_compare(a: _C, b: _C) -> Column:
    """-1, 0 or 1 by major, minor and patch; null where one isn't a version."""
    x, y = semver(a), semver(b)
    return F.when(x < y, -1).when(x > y, 1).when(x == y, 0)


def calculate(operation: str, a: _C, b: _C) -> Column:
    """add, subtract, multiply or divide; a division by zero is an error."""
    x, y = col(a).cast("double"), col(b).cast("double")
    return {"add": x + y, "subtract": x - y, "multiply": x * y, "divide": F.when(y == 0, F.raise_error(F.lit("division by zero"))).otherwise(F.try_divide(x, y))}[operation]


def backoff_seconds(attempt: _C, limit: float = 60.0) -> Column:
    """Doubles with each attempt from one second on, up to the limit."""
    return F.least(F.lit(limit), F.pow(F.lit(2.0), F.greatest(col(attempt) - 1, F.lit(0))))


def strip_fence(c: _C) -> Column:
    """The inside of a fenced block, or the text itself."""
    inside = F.regexp_extract(col(c), r"(?s)^\s*```(?:json)?\s*\n?(.*?)\n?\s*```\s*$", 1)
    return F.when(inside != "", inside).otherwise(F.trim(col(c)))


def json_field(c: _C, name: str, kind: str = "string") -> Column:
    """A top-level field of a JSON text."""
    return F.get_json_object(col(c), f"$.{name}").try_cast(kind)


def is_list_json(c: _C) -> Column:
    return F.json_array_length(col(c)).isNotNull()


def embedding_text(names: list[str]) -> Column:
    """Fields to embed, one a line; nulls are left out."""
    return F.concat_ws("\n", *[F.col(n).cast("string") for n in names])


def chunk_marker(i: _C, n: _C, text: _C) -> Column:
    return F.concat(F.lit("[Processing part "), col(i).cast("string"), F.lit("/"), col(n).cast("string"), F.lit("]\n\n"), col(text))
