"""Scores and statistics as DataFrame operators. A metric that doesn't apply is null and left out of means."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.functions.text import hash_fraction

RESAMPLES, MIN_CI_N, SEED = 1000, 10, 20261019


def prf(pred: Column, gold: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of two arrays as sets; both empty is 1, one empty is 0."""
    p, g = F.array_distinct(pred), F.array_distinct(gold)
    both = F.size(F.array_intersect(p, g)).cast("double")
    none = (F.size(p) == 0) & (F.size(g) == 0)
    precision = F.when(none, 1.0).when(F.size(p) == 0, 0.0).otherwise(both / F.size(p))
    recall = F.when(none, 1.0).when(F.size(g) == 0, 0.0).otherwise(both / F.size(g))
    total = precision + recall
    return precision, recall, F.when(total > 0, 2 * precision * recall / total).otherwise(0.0)


def set_scores(pred: DataFrame, gold: DataFrame, *keys: str) -> DataFrame:
    """One row of precision, recall, F1 and counts between two tables of keys, each row counted once."""
    a, b = pred.select(*keys).distinct().withColumn("p", F.lit(1)), gold.select(*keys).distinct().withColumn("g", F.lit(1))
    n = a.join(b, list(keys), "full").agg(F.count("p").alias("n_pred"), F.count("g").alias("n_gold"), F.count(F.when(F.col("p").isNotNull() & F.col("g").isNotNull(), 1)).alias("n_both"))
    none = (F.col("n_pred") == 0) & (F.col("n_gold") == 0)
    part = lambda d: F.when(none, 1.0).when(F.col(d) == 0, 0.0).otherwise(F.col("n_both") / F.col(d))
    s = n.select("*", part("n_pred").alias("precision"), part("n_gold").alias("recall"))
    total = F.col("precision") + F.col("recall")
    return s.withColumn("f1", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0))


def percentile(df: DataFrame, value: str, q: float, by: list[str] | None = None) -> DataFrame:
    """Nearest-rank percentile of a column, nulls left out."""
    return df.groupBy(*(by or [])).agg(F.expr(f"percentile_disc({q / 100}) within group (order by {value})").alias(f"p{q:g}"))


def mcnemar(df: DataFrame, a: str, b: str) -> dict[str, float]:
    """Exact two-sided McNemar on two boolean columns: the discordant counts and p."""
    only_a, only_b = df.agg(F.count_if(F.col(a) & ~F.col(b)), F.count_if(~F.col(a) & F.col(b))).first()
    n = only_a + only_b
    p = min(1.0, 2 * sum(math.comb(n, i) for i in range(min(only_a, only_b) + 1)) / 2**n) if n else 1.0
    return {"b": only_a, "c": only_b, "p": p}


def bootstrap_ci(df: DataFrame, value: str, resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """(n, mean, low, high): percentile 95 % interval of the mean; no interval below ten values.

    Each resample gives every row a Poisson weight drawn from a hash of (seed,
    resample, row), so rows need not meet: one pass, one partial sum per resample.
    """
    rows = df.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"), F.xxhash64(*df.columns).alias("h"))
    marked = rows.withColumn("i", F.row_number().over(Window.partitionBy("h").orderBy("v")))  # equal rows draw apart
    draws = marked.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(resamples))))
    u = F.pmod(F.xxhash64(F.lit(seed), "r", "h", "i"), F.lit(2**31)).cast("double") / 2.0**31
    cuts, p, total = [], math.exp(-1), 0.0
    for k in range(8):
        total += p
        cuts.append(total)
        p /= k + 1
    weight = sum([(u >= c).cast("int") for c in cuts], F.lit(0))
    means = draws.groupBy("r").agg((F.sum(weight * F.col("v")) / F.nullif(F.sum(weight), F.lit(0))).alias("m"))
    low, high = math.ceil(0.025 * resamples) / resamples, math.ceil(0.975 * resamples) / resamples
    ends = means.agg(F.expr(f"percentile_disc({low}) within group (order by m)").alias("low"), F.expr(f"percentile_disc({high}) within group (order by m)").alias("high"))
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"))
    enough = F.col("n") >= MIN_CI_N
    return whole.crossJoin(ends).select("n", "mean", F.when(enough, F.col("low")).alias("low"), F.when(enough, F.col("high")).alias("high"))  # one row each


def paired_bootstrap(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """The interval of the mean of b - a over the keys that both have."""
    both = a.select(key, F.col(value).alias("x")).join(b.select(key, F.col(value).alias("y")), key)
    return bootstrap_ci(both.select(key, (F.col("y") - F.col("x")).alias("d")), "d")


def stratified_split(df: DataFrame, key: str, stratum: str, share: float, salt: str, forced: Column | None = None) -> DataFrame:
    """Adds ``held``: in each stratum the ceiling of its share, forced rows first, then by a hash of the key."""
    first = F.when(forced, 0).otherwise(1) if forced is not None else F.lit(1)
    w = Window.partitionBy(stratum).orderBy(first, hash_fraction(salt, F.col(key).cast("string")), key)
    n = F.count(F.lit(1)).over(Window.partitionBy(stratum))
    return df.withColumn("held", F.row_number().over(w) <= F.ceil(n * share))


def breakdown(df: DataFrame, metric: str, dimensions: list[str]) -> DataFrame:
    """(dimension, value, n, mean) of a nullable metric over each dimension, and over all, in one pass."""
    cells = F.array(F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("value")), *[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])
    return df.select(F.col(metric).alias("m"), F.explode(cells).alias("c")).groupBy("c.dimension", "c.value").agg(F.count("m").alias("n"), F.avg("m").alias("mean"))


def tolerant_prf(pred: Column, gold: Column, closure: Column) -> tuple[Column, Column, Column]:
    """As :func:`prf`, but a prediction within the closure of the gold is not wrong."""
    p, g = F.array_distinct(pred), F.array_distinct(gold)
    none, one = (F.size(p) == 0) & (F.size(g) == 0), (F.size(p) == 0) | (F.size(g) == 0)
    right = F.size(F.array_intersect(p, F.array_union(closure, g))).cast("double") / F.size(p)
    found = F.size(F.array_intersect(p, g)).cast("double") / F.size(g)
    cell = lambda c: F.when(none, 1.0).when(one, 0.0).otherwise(c)
    precision, recall = cell(right), cell(found)
    total = precision + recall
    return precision, recall, F.when(total > 0, 2 * precision * recall / total).otherwise(0.0)


def depth_bucket(depth: Column) -> Column:
    """n/a, seed, 1, 2-3, 4-5 or 6+."""
    return F.when(depth.isNull(), "n/a").when(depth == 0, "seed").when(depth == 1, "1").when(depth <= 3, "2-3").when(depth <= 5, "4-5").otherwise("6+")


def latency(df: DataFrame, value: str, cached: str) -> DataFrame:
    """(n, p50, p95) over rows that no cache answered."""
    fresh = df.filter(~F.coalesce(F.col(cached), F.lit(False)))
    cut = lambda q: F.expr(f"percentile_disc({q}) within group (order by {value})")
    return fresh.agg(F.count(value).alias("n"), cut(0.5).alias("p50"), cut(0.95).alias("p95"))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """(value, n, share) of a column, nulls too."""
    n = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(df.agg(F.count(F.lit(1)).alias("total"))).select("value", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))  # one row
