"""Embedding near-dedup by sorted projection passes.

Equal vectors are one node with a count. Each pass hashes a vector to a string
of random-hyperplane bits and orders a label's nodes by it; a node is compared
with a bounded window of its neighbours in that order, in blocks that overlap by
a window. Found pairs are verified by cosine in double precision. The passes'
pairs are united into components.

A window bounds what a pass compares, so a vector with more close neighbours
than the window would lose some of its links. The members of each component are
therefore compared with each other in full, in blocks, and links are counted
there: no link between members is lost, however dense the component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import handed, partitions, prepare, stored
from tributary.llm.components import connected_components

COSINE = 0.98
PASSES, BITS, WINDOW = 16, 48, 48
#: Members of a component that one block of the full comparison holds.
BLOCK = 512
#: Windows that a range of the order holds at least.
RANGE = 64
SEED = 7


def _planes(dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, PASSES * BITS))


def _vector_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, vector list<double>) -> (id, label, unit binary or null): float64 of unit length; null takes no part."""
    for batch in batches:
        units = []
        for v, label in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True):
            unit = None
            if label is not None and v and all(x is not None for x in v):
                x = np.array(v, np.float64)
                top = np.abs(x).max()
                if np.isfinite(top) and top > 0:
                    x = x / top
                    unit = (x / np.sqrt(x @ x)).astype("<f8").tobytes()
            units.append(unit)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(units, pa.binary())], ["id", "label", "unit"])


def _pass_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (pass, label, key, node, unit) for each node and pass; the key orders as its bits do."""
    weights = 2 ** np.arange(BITS - 1, -1, -1, dtype=np.int64)
    for batch in batches:
        node, label, unit = (batch.column(i) for i in range(3))
        keys = np.zeros((len(batch), PASSES), np.int64)
        data = unit.to_pylist()
        for size in {len(u) for u in data}:
            at = [i for i, u in enumerate(data) if len(u) == size]
            x = np.frombuffer(b"".join([data[i] for i in at]), "<f8").reshape(len(at), -1)
            keys[at] = ((x @ _planes(size // 8)) > 0).reshape(len(at), PASSES, BITS) @ weights
        for p in range(PASSES):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(batch), p, np.int32)), label, pa.array(keys[:, p].copy()), node, unit], ["turn", "label", "key", "node", "unit"])


def _forest(pairs: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that connect the same nodes as all of them."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.setdefault(x, x)) != x:
            root[x] = root[y]
            x = root[x]
        return x

    out = []
    for a, b in pairs.tolist():
        ra, rb = find(a), find(b)
        if ra != rb:
            root[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


def _window_pairs(cosine: float, window: int):
    """Rows (turn, label, key, node, unit) in order: pairs that connect what is close within ``window`` places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail_head, tail_nodes, tail = None, np.zeros(0, np.int64), []
        for batch in batches:
            unit = batch.column(4).to_pylist()
            node = batch.column(3).to_numpy(zero_copy_only=False)
            heads = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), map(len, unit), strict=True))
            found, a = [np.zeros((0, 2), np.int64)], 0
            while a < len(heads):
                b = a
                while b < len(heads) and heads[b] == heads[a]:
                    b += 1
                nodes, vectors = node[a:b], unit[a:b]
                if heads[a] == tail_head:
                    nodes, vectors = np.concatenate([tail_nodes, nodes]), tail + vectors
                x = np.frombuffer(b"".join(vectors), "<f8").reshape(len(vectors), -1)
                for i in range(0, len(x), window):
                    hit = np.argwhere(x[i : i + window] @ x[i : i + 2 * window].T >= cosine)
                    ahead = hit[:, 1] - hit[:, 0]
                    found.append(nodes[hit[(ahead > 0) & (ahead <= window)] + i])
                tail_head, tail_nodes, tail = heads[a], nodes[-window:], vectors[-window:]
                a = b
            edges = np.array(_forest(np.unique(np.sort(np.concatenate(found), axis=1), axis=0)), np.int64).reshape(-1, 2)
            if len(edges):
                yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0].copy()), pa.array(edges[:, 1].copy())], ["a", "b"])

    return run


def _full_links(cosine: float):
    """Rows (component, i, j, block, node, n, unit) in order: for each node of two blocks the vectors close to it in the other."""

    def count(rows: list) -> Iterator[tuple[int, int]]:
        i, j = rows[0][1], rows[0][2]
        sides = [[r for r in rows if r[3] == k] for k in ((i, j) if i != j else (i,))]
        if not all(sides):
            return
        x, y = (np.frombuffer(b"".join([r[6] for r in s]), "<f8").reshape(len(s), -1) for s in (sides[0], sides[-1]))
        near = x @ y.T >= cosine
        if i == j:
            np.fill_diagonal(near, False)
        for here, there, hits in ((sides[0], sides[-1], near), (sides[-1], sides[0], near.T))[: 1 + (i != j)]:
            totals = hits @ np.array([r[5] for r in there], np.int64)
            yield from zip([r[4] for r in here], totals.tolist(), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["node", "links"])

        held: list = []
        for batch in batches:
            out: list = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:3] != held[0][:3]:
                    out += count(held)
                    held = []
                held.append(row)
            if out:
                yield table(out)
        if held and (out := list(count(held))):
            yield table(out)

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """(id, n_links, component), one row per row.

    Vectors link when their labels are equal and not null and their cosine
    reaches the threshold. Vectors that are null, empty, zero or hold null or
    non-finite components, and rows without an id or a label, link with nothing
    (such a row is its own component). Vectors of different lengths don't link.
    Equal vectors link, also where a whole row repeats; rows that repeat an id with
    other vectors are vectors of their own. Ties have no part in the result.
    Other columns, whatever their names, are not read. An empty table gives an
    empty result.
    """
    spark = prepare(vectors.sparkSession)
    kind, label_kind = (vectors.schema[c].dataType.simpleString() for c in (id_col, label_col))
    src = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    units = src.mapInArrow(_vector_rows, f"id {kind}, label {label_kind}, unit binary").withColumn("sha", F.sha2("unit", 256))
    rows = stored(units.withColumn("sha", F.when(F.col("id").isNotNull(), F.col("sha"))), "units")
    total = rows.count()
    nodes = rows.filter("sha is not null").groupBy("label", "sha").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"), F.first("unit").alias("unit"))
    # A node's number is a value once written, and tells apart vectors of one id.
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    passes = nodes.select("node", "label", "unit").mapInArrow(_pass_rows, f"turn int, label {label_kind}, key long, node long, unit binary")
    order = ["turn", "label", "key", "node"]
    # A range's end cuts a window, so ranges are long beside it.
    ranges = max(1, min(partitions(spark), nodes.count() * PASSES // (RANGE * WINDOW)))
    edges = passes.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(_window_pairs(cosine, WINDOW), "a long, b long")
    cc = stored(connected_components(edges), "vectorcc")
    roots = cc.select("component").distinct()
    member = stored(cc.unionByName(roots.select(F.col("component").alias("node"), "component")), "members")
    sizes = member.groupBy("component").agg(F.count(F.lit(1)).alias("m"))
    held = handed(member, sizes, ["component"], "m", total).join(nodes, "node").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    held = held.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "n", "unit"
    )
    groups = ["component", "i", "j"]
    links = met.repartition(*groups).sortWithinPartitions(*groups).mapInArrow(_full_links(cosine), "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))
    per_node = nodes.select("label", "sha", "node", "low", "n").join(member, "node", "left").join(links, "node", "left")
    per_node = stored(per_node.select("label", "sha", "n", "low", F.coalesce("component", "node").alias("root"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "counts")
    name = per_node.groupBy("root").agg(F.min("low").alias("component"), F.count(F.lit(1)).alias("m"))
    facts = stored(handed(per_node, name, ["root"], "m", total).select("label", "sha", "n", "n_links", "component"), "names")
    found = handed(rows.filter("sha is not null").select("id", "label", "sha"), facts, ["label", "sha"], "n", total).select("id", "n_links", "component")
    alone = rows.filter("sha is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return found.unionByName(alone).select("id", "n_links", F.col("component").cast("long").alias("component"))


def near_vectors_report(vectors: DataFrame) -> DataFrame:
    """The contract's columns, one row per vector."""
    c = near_vectors(vectors)
    return c.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
