"""Operators that SQL projects build from macros, as functions of Columns and DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NULL_KEY = "_dbt_utils_surrogate_key_null_"


def surrogate_key(*cols: Column) -> Column:
    """MD5 of the values as text, joined by '-', nulls by a fixed word."""
    return F.md5(F.concat_ws("-", *[F.coalesce(c.cast("string"), F.lit(NULL_KEY)) for c in cols]))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, unit: str = "mi") -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 3961 * F.asin(F.sqrt(a)) * (1.0 if unit == "mi" else 1.60934)


def width_bucket(value: Column, low: float, high: float, n: int) -> Column:
    """Bucket from 1 to n of equal widths; 0 below and n + 1 from the upper end on."""
    width = (high - low) / n
    return F.when(value < low, 0).when(value >= high, n + 1).otherwise(F.floor((value - low) / width) + 1).cast("int")


def safe_divide(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0).cast("double"))


def safe_add(*cols: Column) -> Column:
    return reduce(lambda x, y: x + y, [F.coalesce(c, F.lit(0)) for c in cols])


def safe_subtract(*cols: Column) -> Column:
    return reduce(lambda x, y: x - y, [F.coalesce(c, F.lit(0)) for c in cols])


def url_host(url: Column) -> Column:
    """What lies between the scheme (if any) and the first slash or question mark."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "android-app://", ""), "http://", ""), "https://", "")
    return F.substring_index(F.substring_index(bare, "/", 1), "?", 1)


def url_path(url: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(url, "http://", ""), "https://", "")
    at = F.coalesce(F.nullif(F.instr(bare, "/"), F.lit(0)), F.lit(0))
    path = F.when(at == 0, F.lit("")).otherwise(F.substring(bare, at + 1, F.length(bare)))
    return F.substring_index(path, "?", 1)


def url_parameter(url: Column, name: str) -> Column:
    value = F.when(F.instr(url, f"{name}=") > 0, F.substring_index(F.substring_index(url, f"{name}=", -1), "&", 1))
    return F.nullif(value, F.lit(""))


def json_value(text: Column, path: str) -> Column:
    return F.get_json_object(text, f"$.{path}")


def number_in(text: Column) -> Column:
    """The first number in a text that may have thousands separators."""
    return F.nullif(F.regexp_extract(F.regexp_replace(text, ",", ""), r"(-?\d+(?:\.\d+)?)", 1), F.lit("")).cast("double")


def nullcheck(df: DataFrame) -> DataFrame:
    """Empty strings as nulls, in every string column."""
    return df.select([F.nullif(F.col(c), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def deduplicate(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group in an order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def pivot(df: DataFrame, by: Sequence[str], column: str, values: Sequence, prefix: str = "", value: Column | None = None) -> DataFrame:
    """A column per value: the sum of ``value`` (rows counted, by default) where the column has it."""
    one = F.lit(1) if value is None else value
    return df.groupBy(*by).agg(*[F.sum(F.when(F.col(column) == v, one).otherwise(0)).alias(f"{prefix}{v}") for v in values])


def unpivot(df: DataFrame, keep: Sequence[str], columns: Sequence[str], cast_to: str = "string", name: str = "field_name", value: str = "value") -> DataFrame:
    typed = df.select(*keep, *[F.col(c).cast(cast_to).alias(c) for c in columns])
    return typed.unpivot(list(keep), list(columns), name, value)


def union_relations(frames: dict[str, DataFrame], source: str = "source_relation") -> DataFrame:
    """Rows of all frames by column name, missing columns null, with the frame's name."""
    parts = [df.withColumn(source, F.lit(n)) for n, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def star(df: DataFrame, but: Sequence[str] = (), prefix: str = "", suffix: str = "") -> list[Column]:
    return [F.col(c).alias(f"{prefix}{c}{suffix}") for c in df.columns if c not in but]


def column_values(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """(value, n) from the most frequent, ties by value."""
    out = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("value"))
    return out.limit(limit) if limit else out


def date_spine(spark: SparkSession, first: str, after: str, unit: str = "day") -> DataFrame:
    """Every date from ``first`` to before ``after``."""
    days = spark.sql(f"select sequence(date '{first}', date '{after}', interval 1 {unit}) as d")
    return days.select(F.explode("d").alias("date")).filter(F.col("date") < F.to_date(F.lit(after)))


def number_series(spark: SparkSession, upper: int) -> DataFrame:
    return spark.range(1, upper + 1).withColumnRenamed("id", "generated_number")


# Tests: each gives the rows, or the groups, that fail.


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def unique(df: DataFrame, *columns: str) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])).groupBy(*columns).agg(F.count(F.lit(1)).alias("n_records")).filter("n_records > 1")


def accepted_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.filter(~F.col(column).isin(*values)).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n_records"))


def accepted_range(df: DataFrame, column: str, low=None, high=None) -> DataFrame:
    bad = F.lit(False)
    bad = bad | (F.col(column) < low) if low is not None else bad
    return df.filter(bad | (F.col(column) > high) if high is not None else bad)


def relationships(df: DataFrame, column: str, to: DataFrame, field: str) -> DataFrame:
    keys = to.select(F.col(field).alias("__key")).distinct()
    return df.filter(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("__key"), "left_anti")


def equality(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one frame has and the other has not (or not as often)."""
    return a.exceptAll(b).withColumn("which", F.lit("a_minus_b")).unionByName(b.exceptAll(a).withColumn("which", F.lit("b_minus_a")))


def not_null_proportion(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.avg(F.col(column).isNotNull().cast("double")).alias("proportion"))


def overlapping_ranges(df: DataFrame, low: str, high: str, by: Sequence[str] = ()) -> DataFrame:
    """Ranges that end after the next of their group begins."""
    w = Window.partitionBy(*by).orderBy(low, high)
    return df.withColumn("next_low", F.lead(low).over(w)).filter(F.col(high) > F.col("next_low"))


def broken_sequence(df: DataFrame, column: str, by: Sequence[str] = (), step: int = 1) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(column)
    return df.withColumn("previous", F.lag(column).over(w)).filter(F.col(column) != F.col("previous") + step)


def at_least_one(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count(column).alias("n")).filter("n = 0")


def not_constant(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_distinct(column).alias("n")).filter("n <= 1")


def cardinality_equality(a: DataFrame, column: str, b: DataFrame, field: str) -> DataFrame:
    """Values that the two columns have in different numbers."""
    x = a.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n_a"))
    y = b.groupBy(F.col(field).alias("v")).agg(F.count(F.lit(1)).alias("n_b"))
    return x.join(y, F.col("value").eqNullSafe(F.col("v")), "full").filter("not (n_a <=> n_b)").select(F.coalesce("value", "v").alias("value"), "n_a", "n_b")


def recency(df: DataFrame, column: str, since: Column) -> DataFrame:
    return df.agg(F.max(column).alias("most_recent")).filter(F.col("most_recent") < since)


def group_by(df: DataFrame, n: int, *aggregates: Column) -> DataFrame:
    """Aggregates by the first n columns."""
    return df.groupBy(*df.columns[:n]).agg(*aggregates)


def not_empty_string(df: DataFrame, column: str, trimmed: bool = True) -> DataFrame:
    """Rows whose text is empty (white space counts as nothing, if asked)."""
    return df.filter((F.trim(column) if trimmed else F.col(column)) == "")


def expression_is_true(df: DataFrame, expression: str) -> DataFrame:
    """Rows for which an SQL condition is false or unknown."""
    return df.filter(~F.coalesce(F.expr(expression), F.lit(False)))


def not_accepted_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """The values, of those that may not occur, that do."""
    return df.filter(F.col(column).isin(*values)).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n_records"))


def row_counts(a: DataFrame, b: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, n_a, n_b): rows of both frames, per group."""
    count = lambda df, name: df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    if not by:
        return count(a, "n_a").crossJoin(count(b, "n_b"))  # one row each
    both = count(a, "n_a").join(count(b, "n_b"), list(by), "full")
    return both.withColumns({n: F.coalesce(n, F.lit(0).cast("long")) for n in ("n_a", "n_b")})


def equal_rowcount(a: DataFrame, b: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Groups with other numbers of rows in the two frames."""
    return row_counts(a, b, by).filter("n_a <> n_b")


def fewer_rows_than(a: DataFrame, b: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Groups in which the first frame doesn't have fewer rows than the second."""
    return row_counts(a, b, by).filter("n_a >= n_b")


def running_size_guard(text: Column, key: str, order: str, most: int) -> Column:
    """A text where all texts of its key up to and with it have at most ``most`` characters together, else null."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return F.when(F.sum(F.length(text)).over(w) <= most, text)
