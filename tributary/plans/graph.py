"""Traversals of an edge table as DataFrame loops: one join and one anti join per level.

An edge table has the string columns ``from`` and ``to``; other columns ride
along where noted. Levels are written to the shared folder, a node is expanded
once, and loops end on an empty frontier or at ``max_depth``, so cycles end too.

Lineage is metadata: a project's graph has some thousand edges. Up to
``LOCAL_EDGES`` edges the most used traversals run over the collected edges,
which gives the same result without a job per hop; larger graphs are looped over.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tributary.tables import written

#: Direct hops first, then the types in this order.
TYPE_RANK = {"JOIN": 1, "FILTER": 2, "GROUP_BY": 3, "WINDOW": 4, "SORT": 5, "CONDITIONAL": 6}
MAX_PATHS = 1000
#: Edges, and starts of a traversal, that are collected at most.
LOCAL_EDGES, LOCAL_STARTS = 50_000, 1000


def _collected(df: DataFrame, most: int | None = None) -> list | None:
    """The distinct rows of a table of at most ``most`` rows (``LOCAL_EDGES``, by default); None of a larger one."""
    most = LOCAL_EDGES if most is None else most
    rows = df.distinct().limit(most + 1).collect() if most else [None]
    return rows if len(rows) <= most else None


def hops(direct: DataFrame, indirect: DataFrame | None = None) -> DataFrame:
    """(from, to, label, rank): direct edges by kind, indirect ones by type, one row per pair and label."""
    out = direct.select("from", "to", F.col("kind").alias("label"), F.lit(0).alias("rank"))
    if indirect is not None:
        rank = F.create_map(*[F.lit(x) for kv in TYPE_RANK.items() for x in kv])
        out = out.unionByName(indirect.select("from", "to", F.col("type").alias("label"), rank[F.col("type")].alias("rank")))
    return out


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.withColumnsRenamed({"from": "__to", "to": "__from"}).withColumnsRenamed({"__to": "to", "__from": "from"})


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def reach(edges: DataFrame, starts: DataFrame, max_depth: int = 100) -> DataFrame:
    """(root, node, depth): what each start reaches and in how few hops; the start itself is depth 0 and left out.

    ``starts`` has one column; all starts move together, one written level per hop.
    """
    begin = _collected(starts.select(F.col(starts.columns[0]).alias("root")), LOCAL_STARTS)
    known = _collected(edges.select("from", "to")) if begin is not None else None
    if known is not None:
        after = defaultdict(list)
        for r in known:
            after[r["from"]].append(r["to"])
        found = []
        for (root,) in begin:
            seen, level = {root}, [root]
            for depth in range(1, max_depth + 1):
                level = sorted({n for x in level for n in after[x]} - seen)
                seen.update(level)
                found += [(root, n, depth) for n in level]
        return edges.sparkSession.createDataFrame(found, "root string, node string, depth int")
    e = written(edges.select(F.col("from").alias("node"), F.col("to").alias("next")).distinct(), "edges")
    levels = [written(starts.select(F.col(starts.columns[0]).alias("root")).distinct().select("root", F.col("root").alias("node"), F.lit(0).alias("depth")), "level")]
    for depth in range(1, max_depth + 1):
        step = levels[-1].join(e, "node").select("root", F.col("next").alias("node")).distinct()
        levels.append(written(step.join(_union(levels), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)), "level"))
        if levels[-1].isEmpty():
            break
    return _union(levels).filter("depth > 0")


def downstream(edges: DataFrame, start: str, max_depth: int = 10) -> DataFrame:
    """(node, depth, via, label): what ``start`` affects, each with one hop into it from the level before.

    Of several hops the lowest rank counts, then the smaller column and label.
    """
    known = _collected(edges.select("from", "to", "label", "rank"))
    if known is not None:
        after = defaultdict(list)
        for r in known:
            after[r["from"]].append((r["rank"], r["from"], r["label"], r["to"]))
        found, seen, level = [], {start}, [start]
        for depth in range(1, max_depth + 1):
            best: dict[str, tuple] = {}
            for rank, via, label, node in sorted((h for x in level for h in after[x] if h[3] not in seen), reverse=True):
                best[node] = (node, depth, via, label)
            level = list(best)
            seen.update(level)
            found += best.values()
        return edges.sparkSession.createDataFrame(found, "node string, depth int, via string, label string")
    e = written(edges.select(F.col("from").alias("via"), F.col("to").alias("node"), "label", "rank"), "edges")
    levels = [edges.sparkSession.createDataFrame([(start, 0, None, None)], "node string, depth int, via string, label string")]
    for depth in range(1, max_depth + 1):
        step = levels[-1].select(F.col("node").alias("via")).join(e, "via").join(_union(levels).select("node"), "node", "left_anti")
        best = step.groupBy("node").agg(F.min(F.struct("rank", "via", "label")).alias("hop"))
        levels.append(written(best.select("node", F.lit(depth).alias("depth"), "hop.via", "hop.label"), "level"))
        if levels[-1].isEmpty():
            break
    return _union(levels).filter("depth > 0")


def more_below(edges: DataFrame, found: DataFrame, start: str, max_depth: int) -> bool:
    """Whether the traversal that gave ``found`` was cut at ``max_depth``."""
    seen = found.select("node").union(edges.sparkSession.createDataFrame([(start,)], "node string"))
    edge = found.filter(F.col("depth") == max_depth).select("node") if max_depth else seen
    below = edge.join(edges.select(F.col("from").alias("node"), "to"), "node").select(F.col("to").alias("node"))
    return not below.join(seen, "node", "left_anti").isEmpty()


@dataclass
class Paths:
    rows: DataFrame
    depth_limited: bool
    truncated: bool


def upstream_paths(edges: DataFrame, start: str, max_depth: int = 10, max_paths: int = MAX_PATHS) -> Paths:
    """All paths from a column to where they begin, as arrays from the start up.

    A path ends at a column without inputs, or at ``max_depth`` (then the result
    is depth-limited). More than ``max_paths`` paths are cut in path order (then
    it is truncated): the limit is the feature, as paths can be exponentially many.
    """
    spark = edges.sparkSession
    e = edges.select(F.col("to").alias("node"), F.col("from").alias("next"), "label")
    open_ = spark.createDataFrame([(start, [start], [])], "node string, path array<string>, labels array<string>")
    done, limited = None, False
    for depth in range(max_depth + 1):
        ends = open_.join(e.select("node").distinct(), "node", "left_anti")
        if depth == max_depth:
            limited = not open_.join(e.select("node").distinct(), "node", "left_semi").isEmpty()
            ends = open_
        done = ends if done is None else done.unionByName(ends)
        if depth == max_depth:
            break
        step = open_.join(e, "node").select(F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path"), F.concat("labels", F.array("label")).alias("labels"))
        open_ = written(step.orderBy("path", "labels").limit(max_paths + 1), "paths")
        if open_.isEmpty():
            break
    kept = written(done.filter(F.size("path") > 1).orderBy("path", "labels").limit(max_paths + 1), "paths")
    truncated = kept.count() > max_paths
    return Paths(kept.orderBy("path", "labels").limit(max_paths).select("path", "labels"), limited, truncated)


def shortest_path(edges: DataFrame, a: str, b: str, max_depth: int = 100) -> list[str] | None:
    """A shortest path from a to b (of the hops the lowest rank, then name), or None."""
    found = downstream(edges, a, max_depth)
    at = found.filter(F.col("node") == b).first()
    if at is None:
        return None
    path = [b]
    while at["via"] != a:  # as many steps as the path has hops
        path.append(at["via"])
        at = found.filter(F.col("node") == at["via"]).first()
    return [a, *path[::-1]]


def reaches(edges: DataFrame, a: str, b: str) -> bool:
    return shortest_path(edges, a, b) is not None


def depths(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(node, depth): hops of the longest path from a column without inputs; raises on a cycle."""
    known = _collected(edges.select("from", "to"))
    if known is not None:
        after, left = defaultdict(list), defaultdict(int)
        for r in known:
            after[r["from"]].append(r["to"])
            left[r["to"]] += 1
            left[r["from"]] += 0
        depth = {n: 0 for n, k in left.items() if not k}
        ready = list(depth)
        while ready:
            x = ready.pop()
            for n in after[x]:
                depth[n] = max(depth.get(n, 0), depth[x] + 1)
                left[n] -= 1
                if not left[n]:
                    ready.append(n)
        if any(left.values()):
            raise ValueError("the edges form a cycle")
        return edges.sparkSession.createDataFrame(list(depth.items()), "node string, depth int")
    e = edges.select("from", "to").distinct()
    nodes = e.select(F.col("from").alias("node")).union(e.select("to")).distinct()
    now = written(nodes.withColumn("depth", F.lit(0)), "depths")
    n = now.count()
    for _ in range(min(n, max_rounds) + 1):
        up = e.join(now.withColumnRenamed("node", "from"), "from").groupBy(F.col("to").alias("node")).agg((F.max("depth") + 1).alias("new"))
        nxt = written(now.join(up, "node", "left").select("node", F.greatest("depth", F.coalesce("new", F.lit(0))).alias("depth"), (F.col("new") > F.col("depth")).alias("moved")), "depths")
        now, moved = nxt.drop("moved"), not nxt.filter("moved").isEmpty()
        if not moved:
            return now
    raise ValueError("the edges form a cycle")


def longest_path(edges: DataFrame, target: str) -> list[str]:
    """The lexicographically largest of the longest paths that end at ``target``, from its first column."""
    d = depths(edges)
    on = edges.select("from", "to").distinct().join(d.select(F.col("node").alias("from"), F.col("depth").alias("df")), "from").join(d.select(F.col("node").alias("to"), F.col("depth").alias("dt")), "to").filter("dt = df + 1")
    paths = edges.sparkSession.createDataFrame([([target], target)], "path array<string>, head string")
    while True:
        step = paths.join(on.select(F.col("to").alias("head"), F.col("from").alias("prev")), "head").select(F.concat(F.array("prev"), "path").alias("path"), F.col("prev").alias("head"))
        step = written(step.groupBy("head").agg(F.max("path").alias("path")).select("path", "head"), "longest")
        if step.isEmpty():
            return paths.agg(F.max("path").alias("p")).first()["p"]
        paths = step


def neighbourhood(edges: DataFrame, start: str, depth: int) -> DataFrame:
    """(node, hops): what lies within ``depth`` hops either way, nearest first by hops and name."""
    one = edges.sparkSession.createDataFrame([(start,)], "n string")
    both = reach(edges, one, depth).unionByName(reach(reversed_edges(edges), one, depth))
    return both.groupBy("node").agg(F.min("depth").alias("hops"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_in, n_out) of every column that has an edge."""
    e = edges.select("from", "to").distinct()
    ends = e.select(F.col("from").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(e.select("to", F.lit(1), F.lit(0)))
    return ends.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def starts(edges: DataFrame) -> DataFrame:
    return degrees(edges).filter("n_in = 0").select("node")


def ends(edges: DataFrame) -> DataFrame:
    return degrees(edges).filter("n_out = 0").select("node")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest name connected with each, by min-label propagation with jumps."""
    known = _collected(edges.select("from", "to"))
    if known is not None:
        root: dict[str, str] = {}

        def top(x: str) -> str:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for r in known:
            a, b = top(r["from"]), top(r["to"])
            root[max(a, b)] = min(a, b)
        return edges.sparkSession.createDataFrame([(n, top(n)) for n in list(root)], "node string, component string")
    e = edges.select("from", "to").union(edges.select("to", "from")).toDF("node", "other").distinct()
    now = written(e.select("node").distinct().withColumn("component", F.col("node")), "cc")
    while True:
        low = e.join(now.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("near"))
        step = now.join(low, "node", "left").select("node", "component", F.least("component", F.coalesce("near", "component")).alias("new"))
        jump = step.select(F.col("node").alias("new"), F.col("new").alias("far"))
        nxt = written(step.join(jump, "new", "left").select("node", "component", F.least("new", F.coalesce("far", "new")).alias("new")), "cc")
        moved = not nxt.filter("new <> component").isEmpty()
        now = nxt.select("node", F.col("new").alias("component"))
        if not moved:
            return now


def short_id(column_id):
    return F.substring_index(column_id, ".", -2)


def display_names(nodes: DataFrame) -> DataFrame:
    """(node, display): the last two parts, or the whole id where those are not unique."""
    w = Window.partitionBy("short")
    named = nodes.select("node", short_id(F.col("node")).alias("short"))
    return named.select("node", F.when(F.count(F.lit(1)).over(w) == 1, F.col("short")).otherwise(F.col("node")).alias("display"))


def resolve(nodes: DataFrame, text: str) -> DataFrame:
    """Nodes that are the text, or end with its dotted parts."""
    t = text.strip().lower()
    return nodes.filter((F.col("node") == t) | F.col("node").endswith(f".{t}"))


def impact_labels(direct: DataFrame, everything: DataFrame, start: str, max_depth: int = 10) -> DataFrame:
    """(node, depth, label): label is 'direct' where an all-direct walk reaches the column (at its direct depth), else the first indirect hop's type on the shortest path."""
    only = downstream(direct, start, max_depth).select("node", F.col("depth").alias("direct_depth"))
    found = downstream(everything, start, max_depth)
    labels = found.filter("depth = 1").select("node", F.when(F.col("label").isin(*TYPE_RANK), F.col("label")).alias("first"))
    for d in range(2, (found.agg(F.max("depth")).first()[0] or 1) + 1):
        nxt = found.filter(F.col("depth") == d).join(labels.select(F.col("node").alias("via"), "first"), "via")
        labels = labels.unionByName(nxt.select("node", F.coalesce("first", F.when(F.col("label").isin(*TYPE_RANK), F.col("label"))).alias("first")))
    return found.join(labels, "node").join(only, "node", "left").select("node", F.coalesce("direct_depth", "depth").alias("depth"), F.when(F.col("direct_depth").isNotNull(), "direct").otherwise(F.coalesce("first", F.lit("direct"))).alias("label"))


def exposures_reached(found: DataFrame, exposures: DataFrame) -> DataFrame:
    """Exposures (exposure, model) whose model holds a reached column."""
    models = found.select(F.substring_index("node", ".", 1).alias("model")).distinct()
    return exposures.join(models, "model", "left_semi").select("exposure").distinct()


def coverage(report: DataFrame, edges: DataFrame) -> DataFrame:
    """(level, models): FULL; PARTIAL (gaps but an edge into the model); TABLE_ONLY; FAILED."""
    has = edges.select(F.substring_index("to", ".", 1).alias("model")).distinct().withColumn("has", F.lit(True))
    level = F.when(F.col("quality") == "FAILED", "FAILED").when(F.col("quality") == "FULL", "FULL").when(F.col("has"), "PARTIAL").otherwise("TABLE_ONLY")
    return report.join(has, "model", "left").groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("models"))


def heights(edges: DataFrame) -> DataFrame:
    """(node, depth): hops of the longest path that leaves each column."""
    return depths(reversed_edges(edges))
