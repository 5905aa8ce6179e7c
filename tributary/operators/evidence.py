"""Evidence of an answer as tables: records from logs, dedup, trimming, completion and augmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tributary.tables import written

MAX_HOPS = 4


def ledger_of_steps(runs: DataFrame) -> DataFrame:
    """(run, id, kind, from_col, to_col) of runs (run, steps array of (tool, results map of id to record)): each id once per run, at its first step."""
    rows = runs.select("run", F.posexplode("steps").alias("n", "step")).select("run", "n", F.explode("step.results").alias("id", "rec"))
    first = rows.groupBy("run", "id").agg(F.min_by("rec", "n").alias("rec"))
    return first.select("run", "id", "rec.kind", "rec.from_col", "rec.to_col")


def deduplicated(items: DataFrame) -> DataFrame:
    """Of items (id, priority, order, text) each id once: its least priority, its first place and that text."""
    return items.groupBy("id").agg(F.min("priority").alias("priority"), F.min("order").alias("order"), F.min_by("text", F.struct("priority", "order")).alias("text"))


def trimmed(items: DataFrame, cap: int, group: str = "kind") -> tuple[DataFrame, DataFrame]:
    """Items in order of priority and place as long as their texts' sizes fit the cap, and (group, n) of what was left out."""
    w = Window.orderBy("priority", "order", "id").rowsBetween(Window.unboundedPreceding, 0)  # one answer's evidence
    sized = items.withColumn("__sum", F.sum(F.ceil(F.length("text") / 3)).over(w))
    kept = sized.filter(F.col("__sum") <= cap).drop("__sum")
    return kept, sized.filter(F.col("__sum") > cap).groupBy(group).agg(F.count(F.lit(1)).alias("n"))


def completions(claims: DataFrame, ledger: DataFrame, names: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """(claim, path): the shortest chain of given edges, of at most ``max_hops``, that links two names of a claim which cites too little.

    ``names`` is (claim, name); ``ledger`` is (id, from_col, to_col). Ties go to the smaller path. All claims move together.
    """
    ends = names.select("claim", F.col("name").alias("start")).distinct()
    e = ledger.select("id", F.lower("from_col").alias("a"), F.lower("to_col").alias("b"))
    front = written(ends.join(e, F.col("start") == F.col("a")).select("claim", "start", F.col("b").alias("at"), F.array("id").alias("path")), "bridge")
    goal = names.select("claim", F.col("name").alias("at")).distinct()
    found = None
    for hop in range(1, max_hops + 1):
        hit = front.join(goal, ["claim", "at"]).filter("start <> at")
        found = hit if found is None else found.unionByName(hit)
        if hop < max_hops:
            step = front.join(e, F.col("at") == F.col("a")).filter(~F.array_contains("path", F.col("id")))
            front = written(step.groupBy("claim", "start", "b").agg(F.min(F.concat("path", F.array("id"))).alias("path")).select("claim", "start", F.col("b").alias("at"), "path"), "bridge")
    return found.groupBy("claim").agg(F.min(F.struct(F.size("path").alias("n"), "path")).alias("x")).select("claim", "x.path")


def left_out(found: DataFrame, named: DataFrame) -> DataFrame:
    """(depth, nodes): of the reached columns (node, depth) those that an answer (node) doesn't name, per depth in order."""
    rest = found.join(named.select("node").distinct(), "node", "left_anti")
    return rest.groupBy("depth").agg(F.array_sort(F.collect_list("node")).alias("nodes"))


def chain_end(candidates: DataFrame, closure: DataFrame) -> str | None:
    """The most downstream of candidates (node) that all lie on one chain of ``closure`` (root, node); None where two don't."""
    n = candidates.select("node").distinct()
    pairs = n.select(F.col("node").alias("a")).join(n.select(F.col("node").alias("b")), F.col("a") < F.col("b"))
    linked = closure.select(F.col("root").alias("x"), F.col("node").alias("y"))
    on = pairs.join(linked, ((F.col("a") == F.col("x")) & (F.col("b") == F.col("y"))) | ((F.col("b") == F.col("x")) & (F.col("a") == F.col("y"))), "left_anti")
    if not on.isEmpty():
        return None
    last = n.join(closure.join(n.withColumnRenamed("node", "to"), F.col("node") == F.col("to")).select(F.col("root").alias("node")).distinct(), "node", "left_anti")
    row = last.orderBy("node").first()
    return row["node"] if row else None


def compared(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, a, b, change) of two runs' scores on the keys that both have: worse, same or better."""
    both = a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key)
    return both.withColumn("change", F.when(F.col("b") < F.col("a"), "worse").when(F.col("b") > F.col("a"), "better").otherwise("same"))
