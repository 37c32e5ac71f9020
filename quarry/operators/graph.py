"""Bounded traversal of edge tables (src, dst, rel_type)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.errors import QueryError
from quarry.session import cut

MAX_DEPTH = 10


def directed(edges: DataFrame, direction: str = "out", rel_type: str | None = None) -> DataFrame:
    """from, to of the edges that a step may take."""
    e = edges if rel_type is None else edges.where(F.col("rel_type") == rel_type)
    out = e.select(F.col("src").alias("from"), F.col("dst").alias("to"))
    back = e.select(F.col("dst").alias("from"), F.col("src").alias("to"))
    try:
        return {"out": out, "in": back, "both": out.union(back)}[direction]
    except KeyError:
        raise QueryError(f"direction must be out, in or both, not {direction}") from None


def bfs(edges: DataFrame, start: list, depth: int, direction: str = "out", rel_type: str | None = None) -> DataFrame:
    """node, depth: each node within `depth` steps of a start node, at its least depth; start nodes are included.

    Each hop joins the frontier with the edges and drops what was seen; the new frontier is written to the
    shared folder, so the plan stays as short as one hop. Stops when a frontier is empty.
    """
    if not 0 <= depth <= MAX_DEPTH:
        raise QueryError(f"depth must be 0 to {MAX_DEPTH}")
    spark = edges.sparkSession
    steps = directed(edges, direction, rel_type)
    seen = frontier = spark.createDataFrame([(s,) for s in start], f"node {steps.schema['from'].dataType.simpleString()}").distinct().withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        reached = steps.join(frontier, F.col("from") == F.col("node"), "left_semi").select(F.col("to").alias("node")).distinct()
        frontier = cut(reached.join(seen, "node", "left_anti").withColumn("depth", F.lit(d)), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def shortest_path(edges: DataFrame, start, end, depth: int = MAX_DEPTH, direction: str = "out") -> DataFrame:
    """pos, node of an unweighted shortest path, the first in node order; no rows where there is none within the depth."""
    spark = edges.sparkSession
    steps = directed(edges, direction)
    kind = steps.schema["from"].dataType.simpleString()
    if start == end:
        return spark.createDataFrame([(0, start)], f"pos int, node {kind}")
    seen = spark.createDataFrame([(start,)], f"node {kind}")
    paths = seen.withColumn("path", F.array("node"))
    for _ in range(depth):
        nxt = steps.join(paths, F.col("from") == F.col("node")).groupBy(F.col("to").alias("n")).agg(F.min(F.concat("path", F.array("to"))).alias("path"))
        paths = cut(nxt.withColumnRenamed("n", "node").join(seen, "node", "left_anti"), "paths")
        hit = paths.where(F.col("node") == F.lit(end))
        if not hit.isEmpty():
            return hit.select(F.posexplode("path").alias("pos", "node"))
        if paths.isEmpty():
            break
        seen = seen.union(paths.select("node"))
    return spark.createDataFrame([], f"pos int, node {kind}")


def dfs(edges: DataFrame, start, depth: int, direction: str = "out", rel_type: str | None = None, max_edges: int = 1_000_000) -> list:
    """Nodes in pre-order with one visited set, so a node first met at the limit isn't expanded again.

    The order is sequential by nature: it walks, on the driver, the depth-bounded subgraph, which bfs() cuts out
    first and which may hold max_edges edges at most.
    """
    near = bfs(edges, [start], depth, direction, rel_type).select("node")
    steps = directed(edges, direction, rel_type).join(near, F.col("from") == F.col("node"), "left_semi").distinct()
    rows = steps.limit(max_edges + 1).collect()
    if len(rows) > max_edges:
        raise QueryError(f"more than {max_edges} edges within reach; use bfs()")
    after: dict = {}
    for r in sorted(rows):
        after.setdefault(r["from"], []).append(r["to"])
    out, seen, stack = [], set(), [(start, 0)]
    while stack:
        node, d = stack.pop()
        if node in seen:
            continue
        seen.add(node)
        out.append(node)
        if d < depth:
            stack += [(n, d + 1) for n in reversed(after.get(node, [])) if n not in seen]
    return out


def neighbours(edges: DataFrame, node, direction: str = "both") -> DataFrame:
    """neighbour, rel_type, way (out or in)."""
    out = edges.where(F.col("src") == F.lit(node)).select(F.col("dst").alias("neighbour"), "rel_type", F.lit("out").alias("way"))
    back = edges.where(F.col("dst") == F.lit(node)).select(F.col("src").alias("neighbour"), "rel_type", F.lit("in").alias("way"))
    return {"out": out, "in": back, "both": out.union(back)}[direction]


def adjacency(edges: DataFrame) -> DataFrame:
    """src, neighbours (sorted) and offset: the rows of a compressed sparse row layout.

    Offsets are prefix sums over ranges of src: totals of the ranges are summed on the driver, one number a range.
    """
    rows = cut(edges.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("neighbours")).repartitionByRange("src").sortWithinPartitions("src").withColumn("part", F.spark_partition_id()), "adjacency")
    totals = rows.groupBy("part").agg(F.sum(F.size("neighbours")).alias("n")).orderBy("part").collect()
    base, bases = 0, []
    for t in totals:
        bases.append((t["part"], base))
        base += t["n"]
    from pyspark.sql import Window

    before = F.coalesce(F.sum(F.size("neighbours")).over(Window.partitionBy("part").orderBy("src").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = edges.sparkSession.createDataFrame(bases, "part int, base bigint")
    return rows.join(F.broadcast(starts), "part").select("src", "neighbours", (F.col("base") + before).alias("offset"))


def extract_edges(rows: DataFrame, json_col: str, id_col: str = "id") -> DataFrame:
    """src, dst, rel_type, properties from a JSON list of edges; entries without a UUID as dst or without rel_type are dropped."""
    from quarry.functions.scalar import is_uuid

    kind = "array<struct<dst:string,rel_type:string,properties:map<string,string>>>"
    e = rows.select(F.col(id_col).alias("src"), F.explode(F.from_json(json_col, kind)).alias("e")).select("src", "e.*")
    return e.where(is_uuid("dst") & F.col("rel_type").isNotNull()).withColumn("properties", F.coalesce("properties", F.create_map().cast("map<string,string>")))


def edges_from_texts(rows: DataFrame, provider: Callable[[str], list[tuple[str, str]]], id_col: str = "id", text_col: str = "content") -> DataFrame:
    """src, dst, rel_type: the edges that a provider (a model, say) finds in each row's text, in Arrow batches."""
    kind = rows.schema[id_col].dataType.simpleString()

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(i, dst, rel) for i, text in zip(b["src"], b["text"]) for dst, rel in provider(text or "")]
            yield pd.DataFrame(found, columns=["src", "dst", "rel_type"])

    return rows.select(F.col(id_col).alias("src"), F.col(text_col).alias("text")).mapInPandas(find, f"src {kind}, dst string, rel_type string")


def merge_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges of both; the new one wins for the same (src, dst, rel_type). Nothing is deleted."""
    both = old.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)))
    rest = [c for c in old.columns if c not in ("src", "dst", "rel_type")]
    best = both.groupBy("src", "dst", "rel_type").agg(F.max_by(F.struct(*rest) if rest else F.lit(True), "_n").alias("_r"))
    return best.select("src", "dst", "rel_type", *([F.col(f"_r.{c}").alias(c) for c in rest]))


def add_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame, id_col: str = "id") -> DataFrame:
    """merge_edges() with those new edges whose ends both exist."""
    ids = nodes.select(F.col(id_col).alias("_id")).distinct()
    ok = new.join(ids, F.col("src") == F.col("_id"), "left_semi").join(ids, F.col("dst") == F.col("_id"), "left_semi")
    return merge_edges(edges, ok)


def remove_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone, ["src", "dst", "rel_type"], "left_anti")


def expand(seeds: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """node, hops: what iterated retrieval reaches from seed rows (node), least hops first."""
    out = seeds.select("node").distinct().withColumn("hops", F.lit(0))
    steps = directed(edges, "both")
    front = out
    for d in range(1, depth + 1):
        front = cut(steps.join(front, F.col("from") == F.col("node"), "left_semi").select(F.col("to").alias("node")).distinct().join(out, "node", "left_anti").withColumn("hops", F.lit(d)), "expand")
        out = out.unionByName(front)
    return out


def inline_of_type(edges_col: str, rel_type: str):
    """Of an array of inline edges, those of one type."""
    return F.filter(edges_col, lambda e: e["rel_type"] == rel_type)


def without_inline(edges_col: str, dst: str, rel_type: str):
    """An array of inline edges without the one to dst of that type."""
    return F.filter(edges_col, lambda e: ~((e["dst"] == dst) & (e["rel_type"] == rel_type)))
