"""Perturbation: change one column, run the models again, and see which columns changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.tables import written

# The seed of all draws, the steps of modes, and the word that no column has.
SEED, STEP, SHIFT, NEW_WORD = 20261019, 1_000_003, 7.31, "zz_oracle"
#: Rows among which a value may move in the mode that shuffles them.
SHUFFLED_TOGETHER = 100_000


def type_class(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.IntegralType):
        return "integer"
    if isinstance(kind, T.NumericType):
        return "numeric"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "temporal"
    return "string" if isinstance(kind, T.StringType) else "other"


def canonical(c: Column, kind: T.DataType) -> Column:
    """One string per value, equal for equal values; doubles keep ten significant digits."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        text = F.concat(F.lit("f:"), F.format_string("%.9e", c.cast("double") + 0.0))
    else:
        tag = {"integer": "n:", "numeric": "n:", "temporal": "t:", "boolean": "b:"}.get(type_class(kind), "s:")
        text = F.concat(F.lit(tag), c.cast("string"))
    return F.coalesce(text, F.lit("\u0000NULL"))


def fingerprint(df: DataFrame) -> DataFrame:
    """(column, n_rows, hash): a hash of each column's values whatever their order, as sums of two hashes of each value."""
    names = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.StructType))]
    sums = []
    for i, f in enumerate(df.schema.fields):
        if f.name in names:
            text = canonical(F.col(f.name), f.dataType)
            sums += [F.sum(F.xxhash64(text).cast("decimal(38,0)")).alias(f"a{i}"), F.sum(F.xxhash64(F.concat(F.lit("#"), text)).cast("decimal(38,0)")).alias(f"b{i}")]
    one = df.agg(F.count(F.lit(1)).alias("n"), *sums)
    cells = [F.struct(F.lit(f.name).alias("column"), F.sha2(F.concat_ws("|", F.col(f"a{i}").cast("string"), F.col(f"b{i}").cast("string")), 256).alias("hash")) for i, f in enumerate(df.schema.fields) if f.name in names]
    return one.select("n", F.explode(F.array(*cells)).alias("c")).select("c.column", F.col("n").alias("n_rows"), "c.hash")


def changed(base: DataFrame, now: DataFrame) -> DataFrame:
    """Columns whose fingerprints differ; all of them where the row count does."""
    n = now.select("column", F.col("n_rows").alias("n2"), F.col("hash").alias("h2"))
    return base.join(n, "column", "left").filter("not (n_rows <=> n2) or not (hash <=> h2)").select("column")


def half(key: Column, column: str, mode: str, seed: int = SEED) -> Column:
    """About half of the rows, the same ones at every run."""
    return F.pmod(F.xxhash64(F.lit(f"{seed}:{column}:{mode}"), key.cast("string")), F.lit(2)) == 0


def perturbed(df: DataFrame, column: str, mode: str, key: str, seed: int = SEED) -> DataFrame:
    """``df`` with one column changed by a mode of its type class; ``key`` tells the rows apart."""
    kind = df.schema[column].dataType
    c, of, h = F.col(column), type_class(kind), half(F.col(key), column, mode, seed)
    if (of, mode) in (("integer", "break"),):
        top = df.agg(F.coalesce(F.max(column), F.lit(0)).alias("top")).first()["top"]
        new = F.when(h & c.isNotNull(), F.lit(top + 7) + F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(STEP))).otherwise(c)
    elif mode in ("remap_existing", "remap_new"):
        first = [r[column] for r in df.filter(c.isNotNull()).groupBy(column).count().orderBy(F.desc("count"), F.col(column).cast("string")).limit(2).collect()]
        if len(first) < (2 if mode == "remap_existing" else 1):
            return df
        new = F.when(c == first[0], F.lit(first[1] if mode == "remap_existing" else NEW_WORD)).otherwise(c)
    elif mode == "null_out":
        new = F.when(~h, c)
    elif mode == "shuffle":
        return shuffled(df, column, key, seed)
    else:
        new = MODES[of][mode](c, h)
    return df.withColumn(column, new.cast(kind))


def shuffled(df: DataFrame, column: str, key: str, seed: int = SEED) -> DataFrame:
    """``df`` with the values of one column dealt out anew: rows fall into parts by a hash of their key, and within a part the k-th row by key takes the k-th value by another hash."""
    parts = max(1, df.count() // SHUFFLED_TOGETHER)
    part = F.pmod(F.xxhash64(F.lit(seed), F.col(key).cast("string")), F.lit(parts))
    place = lambda *order: F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    rows = df.withColumn("__part", part)
    drawn = rows.select("__part", F.col(column).alias("__new"), place(F.xxhash64(F.lit(seed + 1), F.col(key).cast("string")), key).alias("__k"))
    placed = rows.withColumn("__k", place(key)).join(drawn, ["__part", "__k"])
    return placed.select([F.col("__new").alias(c) if c == column else F.col(c) for c in df.columns])


def modes_of(kind: T.DataType) -> list[str]:
    """The modes that fit a type: those of its class, and the ones that fit every column."""
    of = type_class(kind)
    words = ["remap_existing", "remap_new"] if of == "string" else []
    return [*MODES[of], *(["break"] if of == "integer" else []), *words, "null_out", "shuffle"]


def end_to_end(spark: SparkSession, table: str, column: str, modes: list[str], key: str, models: dict[str, str], closure: DataFrame) -> DataFrame:
    """(model, column, label, modes): what changes of a raw column change in all models, against the closure (model, column) that is expected of it."""
    return local_check(spark, table, column, modes, key, models, closure)


def _days(n: int) -> Column:
    return F.make_dt_interval(days=F.lit(n))


MODES: dict[str, dict[str, Callable[[Column, Column], Column]]] = {
    "integer": {"relabel": lambda c, h: c + STEP, "scale": lambda c, h: c * 3, "cross": lambda c, h: F.when(h, c * 10).otherwise(-c)},
    "numeric": {"shift": lambda c, h: c + SHIFT, "scale": lambda c, h: c * 1.5, "cross": lambda c, h: F.when(h, c * 10).otherwise(c * 0.1)},
    "temporal": {"shift": lambda c, h: c + _days(37), "cross": lambda c, h: F.when(h, c + _days(120)).otherwise(c - _days(120))},
    "boolean": {"flip": lambda c, h: ~c, "flip_subset": lambda c, h: F.when(h, ~c).otherwise(c)},
    "string": {},
    "other": {},
}


def affected(spark: SparkSession, table: str, column: str, mode: str, key: str, models: dict[str, str]) -> DataFrame:
    """(model, column) of the models' columns that change when a table's column does.

    The view of the table is swapped for the perturbed one while the models run
    again, and put back; ``models`` are given in an order that runs.
    """
    from tributary.functions.dialect import to_spark

    def prints() -> DataFrame:
        out = None
        for m, sql in models.items():
            made = written(spark.sql(to_spark(sql)), m)  # each model is computed once, from written ones
            made.createOrReplaceTempView(m)
            p = fingerprint(made).withColumn("model", F.lit(m))
            out = p if out is None else out.unionByName(p)
        return spark.createDataFrame(out.collect(), out.schema)  # a row for each column of the models

    original = spark.table(table)
    try:
        base = prints()
        perturbed(original, column, mode, key).createOrReplaceTempView(table)
        now = prints()
    finally:
        original.createOrReplaceTempView(table)
        for m, sql in models.items():
            spark.sql(to_spark(sql)).createOrReplaceTempView(m)
    n = now.select("model", "column", F.col("n_rows").alias("n2"), F.col("hash").alias("h2"))
    return base.join(n, ["model", "column"]).filter("n_rows <> n2 or hash <> h2").select("model", "column")


def nearest(df: DataFrame, column: str, cutoffs: list[float]) -> DataFrame:
    """For each cut-off the nearest values below and above, and the rows below, at and above it."""
    c = F.col(column)
    cells = [
        F.struct(
            F.lit(float(x)).alias("cutoff"), F.max(F.when(c < x, c)).alias("nearest_below"), F.count_if(c == x).alias("at_cutoff"),
            F.min(F.when(c > x, c)).alias("nearest_above"), F.count_if(c < x).alias("rows_below"), F.count_if(c > x).alias("rows_above"),
        )
        for x in cutoffs
    ]
    return df.agg(F.array(*cells).alias("a")).select(F.explode("a").alias("x")).select("x.*")


def classify(seen: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Adds a label to each pair of either table: confirmed, missing (seen, not expected) or silent (expected, not seen)."""
    a, b = seen.select(*keys).distinct().withColumn("s", F.lit(1)), expected.select(*keys).distinct().withColumn("e", F.lit(1))
    label = F.when(F.col("s").isNull(), "silent").when(F.col("e").isNull(), "missing").otherwise("confirmed")
    return a.join(b, keys, "full").select(*keys, label.alias("label"))


def deterministic(source: DataFrame, make: Callable[[DataFrame], DataFrame], parts: tuple[int, ...] = (1, 3, 7)) -> bool:
    """Whether what ``make`` derives from a frame is the same whatever the order and partitions of the frame's rows."""
    marks = {tuple(map(tuple, fingerprint(make(source.repartition(n))).orderBy("column").collect())) for n in parts}
    return len(marks) == 1


def threshold_lines(models: DataFrame) -> DataFrame:
    """(model, line, text): lines of (model, sql) that compare with a number."""
    rows = models.select("model", F.posexplode(F.split("sql", "\n")).alias("n", "text"))
    return rows.filter(F.col("text").rlike(r"(<=?|>=?|<>|!=|(?<![<>!])=|\bbetween\b)\s*-?\d")).select("model", (F.col("n") + 1).alias("line"), F.trim("text").alias("text"))


def uncovered_lines(models: DataFrame, known: DataFrame) -> DataFrame:
    """Threshold lines that no (model, line) row of ``known`` covers."""
    return threshold_lines(models).join(known.select("model", "line"), ["model", "line"], "left_anti")


def stale_lines(models: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of ``known`` whose line compares with nothing now."""
    return known.join(threshold_lines(models), ["model", "line"], "left_anti")


def crossings(base: DataFrame, now: DataFrame) -> DataFrame:
    """How many keys of both (key, outcome) tables have another outcome."""
    both = base.select("key", F.col("outcome").alias("a")).join(now.select("key", F.col("outcome").alias("b")), "key")
    return both.agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("n"))


def spot_check(df: DataFrame, key: str, k: int = 10, seed: int = SEED) -> DataFrame:
    """The k rows that a seeded hash of their key puts first: the same at every run."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key).cast("string")), key).limit(k)


def local_check(spark: SparkSession, table: str, column: str, modes: list[str], key: str, models: dict[str, str], expected: DataFrame) -> DataFrame:
    """(model, column, label, modes) for the models next to a table: what a column's modes changed against the edges that are expected.

    ``expected`` is (model, column) of the edges from the column. A pair that any
    mode changes is seen; without an edge it is missing, an edge that no mode shows is silent.
    """
    seen = None
    for mode in modes:
        part = affected(spark, table, column, mode, key, models).withColumn("mode", F.lit(mode))
        seen = part if seen is None else seen.unionByName(part)
    seen = spark.createDataFrame(seen.collect(), seen.schema)  # a row for each changed column and mode
    labels = classify(seen, expected, ["model", "column"])
    by = seen.groupBy("model", "column").agg(F.array_sort(F.collect_set("mode")).alias("modes"))
    return labels.join(by, ["model", "column"], "left").withColumn("modes", F.coalesce("modes", F.array().cast("array<string>")))


def report(labels: DataFrame) -> str:
    """Counts by label and the pairs that need a look, as text."""
    counts = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    lines = [", ".join(f"{counts.get(k, 0)} {k}" for k in ("confirmed", "missing", "silent"))]
    rows = labels.filter("label <> 'confirmed'").orderBy("label", "model", "column").collect()
    return "\n".join([*lines, *[f"{r['label']}: {r['model']}.{r['column']}" for r in rows]])
