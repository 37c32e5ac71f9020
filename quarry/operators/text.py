"""Tokens, postings, corpus statistics and BM25."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.scalar import strip_suffix, tokens
from quarry.session import cut


def term_frequencies(docs: DataFrame, id_col: str = "id", text_col: str = "text", stem: bool = False, stop_words: list[str] | None = None) -> DataFrame:
    """id, term, tf."""
    t = docs.select(F.col(id_col).alias("id"), F.explode(tokens(text_col)).alias("term"))
    t = t.withColumn("term", strip_suffix("term")) if stem else t
    t = t.where(~F.col("term").isin(stop_words)) if stop_words else t
    return t.groupBy("id", "term").agg(F.count("*").alias("tf"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def corpus_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """n_docs, avg_length (tokens), n_tokens."""
    n = F.size(tokens(text_col))
    return docs.agg(F.count("*").alias("n_docs"), F.avg(n).alias("avg_length"), F.sum(n).cast("long").alias("n_tokens"))


def index_stats(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """n_docs (with a token), n_terms and n_postings (distinct pairs of both).

    One pass over the texts: the row of an id counts its own postings, and terms are combined in the task, so no posting is
    shuffled. Only those of ids that come more than once are, as their rows may share terms.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(r"[\p{L}\p{N}]{2,}"), F.lit(0))  # as tokens()
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col))
    again = cut(own.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("_id")), "repeated-ids")
    same = F.col("id").eqNullSafe(F.col("_id"))
    repeated = not again.isEmpty()
    single = (own.join(again, same, "left_anti") if repeated else own).select("id", F.posexplode(F.array_distinct(words)).alias("place", "term"))
    found = single.select("term", F.lit(1).cast("long").alias("n"), ((F.col("place") == 0) & F.col("id").isNotNull()).cast("long").alias("docs"))
    if repeated:
        pairs = cut(own.join(again, same, "left_semi").select("id", F.explode(F.array_distinct(words)).alias("term")).distinct(), "repeated-postings")
        found = found.unionByName(pairs.select("term", F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("docs")))
        ids = pairs.where("id IS NOT NULL").select("id").distinct()
        found = found.unionByName(ids.select(F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), F.lit(1).cast("long").alias("docs")))
    by_term = found.groupBy("term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return by_term.agg(*[F.coalesce(c, F.lit(0).cast("long")).alias(a) for c, a in ((F.sum("docs"), "n_docs"), (F.count("term"), "n_terms"), (F.sum("n"), "n_postings"))])


def bm25(docs: DataFrame, query: str, id_col: str = "id", text_col: str = "text", k1: float = 1.2, b: float = 0.75, idf: str = "plain", keep: list[str] | None = None) -> DataFrame:
    """id, score (and kept columns) of the documents that hold a term of the query.

    One pass over the texts counts the query's terms and writes a few numbers a document; one row of totals gives their
    frequencies. Postings are never shuffled. idf "plain" may be negative for common terms; "plus1" adds 1 inside.
    """
    spark = docs.sparkSession
    words = [r[0] for r in spark.range(1).select(F.explode(F.array_distinct(tokens(F.lit(query)))).alias("w")).collect()]
    cols = [F.col(id_col).alias("id"), *[F.col(c) for c in keep or []]]
    if not words:
        return docs.select(*cols, F.lit(0.0).alias("score")).limit(0)
    lower = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    runs = docs.select(*cols, F.regexp_extract_all(lower, F.lit(r"[\p{L}\p{N}]{2,}"), F.lit(0)).alias("_w"))
    counts = [F.size(F.filter("_w", _is(w))).alias(f"_tf{i}") for i, w in enumerate(words)]
    counted = cut(runs.select("id", *(keep or []), F.size("_w").alias("_dl"), *counts), "term-counts")
    totals = counted.agg(F.count("*").alias("_n"), F.avg("_dl").alias("_avg"), *[F.sum((F.col(f"_tf{i}") > 0).cast("long")).alias(f"_df{i}") for i in range(len(words))])
    score = F.lit(0.0)
    for i in range(len(words)):
        ratio = (F.col("_n") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5)
        weight = F.log(ratio + 1) if idf == "plus1" else F.log(ratio)
        tf = F.col(f"_tf{i}")
        score = score + F.when(tf > 0, weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("_dl") / F.col("_avg")))).otherwise(0.0)
    hit = F.greatest(*[F.col(f"_tf{i}") for i in range(len(words))], F.lit(0)) > 0
    return counted.where(hit).join(F.broadcast(totals)).select("id", *(keep or []), score.alias("score"))  # totals is one row


def _is(word: str):
    return lambda x: x == word


def phrase_matches(docs: DataFrame, phrase: str, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, hits: how often the tokens of the phrase follow one another."""
    joined = F.concat(F.lit(" "), F.array_join(tokens(text_col), " "), F.lit(" "))
    wanted = F.concat(F.lit("(?= "), F.array_join(tokens(F.lit(phrase)), " "), F.lit(" )"))  # tokens hold letters and digits only
    found = docs.select(F.col(id_col).alias("id"), F.regexp_count(joined, wanted).cast("long").alias("hits"))
    return found.where((F.col("hits") > 0) & (F.size(tokens(F.lit(phrase))) > 0))


def bm25_fields(docs: DataFrame, query: str, boosts: dict[str, float], id_col: str = "id", idf: str = "plus1") -> DataFrame:
    """id, score: the sum of the fields' BM25 scores, each times its boost."""
    from functools import reduce

    parts = [bm25(docs, query, id_col, f, idf=idf).withColumn("score", F.col("score") * w) for f, w in boosts.items()]
    return reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.sum("score").alias("score"))


def positions(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, term, places: where each token of a text stands, counted from 0."""
    t = docs.select(F.col(id_col).alias("id"), F.posexplode(tokens(text_col)).alias("place", "term"))
    return t.groupBy("id", "term").agg(F.array_sort(F.collect_list("place")).alias("places"))
