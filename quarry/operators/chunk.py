"""Cutting texts and record lists into chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.scalar import estimate_tokens


def pack_pieces(pieces: Column, limit: int, joint: str, size=F.octet_length) -> Column:
    """Pieces packed in order into chunks of at most `limit` (bytes); a longer piece is a chunk of its own.

    A fold over the pieces' sizes notes in a text of one character a piece which of them open a chunk. Then all pieces
    are joined once, with a mark before those, and cut there: no piece is copied again and again as a chunk grows.
    """
    extra, mark, guard = len(joint.encode()), "\x01", "\x02"

    def step(acc, p):
        n = size(p)
        opens = (acc["held"] < 0) | (acc["held"] + n + extra > limit)
        return F.struct(F.when(opens, n).otherwise(acc["held"] + n + extra).cast("long").alias("held"), F.concat(acc["opens"], F.when(opens, "1").otherwise("0")).alias("opens"))

    start = F.struct(F.lit(-1).cast("long").alias("held"), F.lit("").alias("opens"))
    flags = F.split(F.aggregate(pieces, start, step, lambda acc: acc["opens"]), "")
    safe = lambda p: F.replace(F.replace(p, F.lit(guard), F.lit(guard + "b")), F.lit(mark), F.lit(guard + "a"))  # noqa: E731  a mark in the text itself
    back = lambda p: F.replace(F.replace(p, F.lit(guard + "a"), F.lit(mark)), F.lit(guard + "b"), F.lit(guard))
    joined = F.array_join(F.zip_with(pieces, flags, lambda p, f: F.concat(F.when(f == "1", mark).otherwise(joint), safe(p))), "")
    return F.transform(F.split(F.when(F.size(pieces) == 0, "").otherwise(F.substring(joined, 2, 2**31 - 1)), mark), back)


def paragraphs(text: Column, separator: str = "\n\n") -> Column:
    parts = F.transform(F.split(text, separator), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", ""))
    return F.filter(parts, lambda p: p != "")


def paragraph_chunks(docs: DataFrame, limit: int = 2000, separator: str = "\n\n", id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, ordinal, content: paragraphs packed up to `limit` bytes; an empty text gives one empty chunk."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    chunks = pack_pieces(paragraphs(text, separator), limit, separator)
    return docs.select(F.col(id_col).alias("id"), F.posexplode(chunks).alias("ordinal", "content"))


def fixed_chunks(docs: DataFrame, size: int, overlap: int = 0, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, ordinal, start, content, tokens: windows of `size` characters, each `size - overlap` after the one before."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")
    text = F.coalesce(F.col(text_col), F.lit(""))
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1 - overlap, F.lit(0)), F.lit(size - overlap))
    cut = docs.select(F.col(id_col).alias("id"), text.alias("_t"), F.posexplode(starts).alias("ordinal", "start"))
    out = cut.select("id", "ordinal", "start", F.substring(F.col("_t"), F.col("start") + 1, F.lit(size)).alias("content"))
    return out.withColumn("tokens", estimate_tokens("content"))


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+(?=[A-Z])")


def token_chunks(docs: DataFrame, max_tokens: int, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, ordinal, content, tokens: sentences packed up to max_tokens (a quarter of the characters); a longer sentence
    is cut into pieces of nine tenths of that."""
    width = max(1, int(max_tokens * 4 * 0.9))
    long_or_not = F.transform(
        sentences(F.coalesce(F.col(text_col), F.lit(""))),
        lambda s: F.when(F.length(s) / 4 > max_tokens, F.transform(F.sequence(F.lit(0), F.length(s) - 1, F.lit(width)), lambda i: F.substring(s, i + 1, F.lit(width)))).otherwise(F.array(s)),
    )
    chunks = pack_pieces(F.flatten(long_or_not), max_tokens * 4, " ", F.length)
    return docs.select(F.col(id_col).alias("id"), F.posexplode(chunks).alias("ordinal", "content")).withColumn("tokens", estimate_tokens("content"))


def record_chunks(records: DataFrame, by: str, order: str, per_chunk: int) -> DataFrame:
    """by, ordinal, n_records, content (a JSON list): records stay whole. The number of a record comes from its order."""
    from pyspark.sql import Window

    numbered = records.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1)
    chunk = F.floor(F.col("_n") / per_chunk).cast("int")
    body = F.array_sort(F.collect_list(F.struct("_n", F.struct(*records.columns).alias("r"))))
    return numbered.groupBy(by, chunk.alias("ordinal")).agg(F.count("*").alias("n_records"), F.to_json(F.transform(body, lambda x: x["r"])).alias("content"))


def records_per_chunk(records: DataFrame, budget: int, sample: int = 10) -> int:
    """How many records fit a token budget, by the mean of the first ones with five tokens added to each."""
    size = records.limit(sample).agg(F.avg(F.length(F.to_json(F.struct("*"))) / 4 + 5)).first()[0]
    return max(1, int(budget / size)) if size else 1
