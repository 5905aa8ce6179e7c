"""Connected components of an edge table by alternating large-star and small-star steps.

Each step takes every node's least neighbour by partial aggregation and hands it
to the node's edges. Edges of nodes that hold a large share of all edges get it
by broadcast and don't move (``common.handed``), so no task reads a hub's edges.
A table of at most ``LOCAL_EDGES`` edges is united in one task instead, which
takes one pass and a bounded memory; the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import discard, handed, stored


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
    low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return handed(both.filter("v > u"), low, ["u"], "n", 2 * total).select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = handed(down, low, ["u"], "n", total).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select(F.col("u"), F.col("m")))


#: Edges that one task may unite: some hundred bytes of memory each.
LOCAL_EDGES = 500_000


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) -> (a, b): each node and the least of its component, for all nodes but the least."""
    root: dict = {}

    def find(x):
        top = x
        while (y := root.setdefault(top, top)) != top:
            top = y
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    schema = None
    for batch in batches:
        schema = batch.schema
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    nodes = [x for x in root if find(x) != x]
    for i in range(0, len(nodes), 10_000):
        part = nodes[i : i + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, schema.field(0).type), pa.array([find(x) for x in part], schema.field(0).type)], ["a", "b"])


def connected_components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``edges`` holds two node columns (orderable, links both ways).

    Returns (node, component): the smallest node reachable, for every node that
    stands in an edge with another. Nulls and loops are ignored; repeated edges
    count once; an empty table gives an empty result.
    """
    a, b = edges.columns[:2]
    now = stored(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct(), "cc")
    before = None
    while True:
        marks = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if marks == before or not marks[0]:
            break
        if marks[0] <= local_edges:
            now = stored(now.coalesce(1).mapInArrow(_united, now.schema), "cc")
            break
        before = marks
        big = _large_star(now, marks[0]).filter("a <> b").distinct()
        small = _small_star(big, marks[0]).filter("a <> b").distinct()
        after = stored(small, "cc")
        discard(now)
        now = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
