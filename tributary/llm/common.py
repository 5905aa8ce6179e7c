"""Session settings, scratch tables and small helpers shared by the operators."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch; texts can be long, so batches stay small.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20

#: White space of the contracts: space and U+0009 to U+000D.
SPACE_RUN = r"[\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> SparkSession:
    """Settings that the Python stages need: bounded Arrow batches and an importable package.

    Executors import this package by its install; where it runs from a source
    tree, the tree's folder goes into the workers' PYTHONPATH.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
    return spark


_held: list = []


def claim(owner: str, build):
    """What a worker keeps between tasks for one owner at a time: another owner's is given back first."""
    if not _held or _held[0] != owner:
        _held.clear()
        give_back()
        _held.extend([owner, build()])
    return _held[1]


def give_back() -> None:
    """Return freed memory to the system, where the C library can."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def scratch(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``, or one of our own where that is unset (local runs)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("a cluster needs spark.checkpoint.dir, a folder that all of it shares")
        base = getattr(spark.sparkContext, "_tributary_scratch", None)
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="tributary-")
            spark.sparkContext._tributary_scratch = base
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors, and prunes columns."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tributary_path = path
    scope = spark.sparkContext.__dict__.get("_tributary_scope")
    if scope is not None:
        scope.append(out)
    return out


def discard(df: DataFrame | None) -> None:
    """Delete a table that :func:`stored` wrote and nothing reads any more."""
    path = getattr(df, "_tributary_path", None)
    if path:
        spark = df.sparkSession
        jvm = spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        df._tributary_path = None


@contextmanager
def own_tables(spark: SparkSession, owner: str) -> Iterator[None]:
    """What :func:`stored` writes inside belongs to ``owner`` and is deleted when the owner begins anew; nobody else's tables are touched.

    For callers that have by then written what they made of those tables.
    """
    context = spark.sparkContext.__dict__
    owned = context.setdefault("_tributary_owned", {})
    for df in owned.pop(owner, []):
        discard(df)
    gc.collect()
    spark._jvm.System.gc()  # Spark deletes shuffle files of plans that nothing holds any more
    before, owned[owner] = context.get("_tributary_scope"), []
    context["_tributary_scope"] = owned[owner]
    try:
        yield
    finally:
        context["_tributary_scope"] = before


#: Rows of one key that a join may always send to one task.
SMALL_KEY = 500


def handed(rows: DataFrame, facts: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """``rows`` inner-joined with ``facts``, which has one row per key and in ``count`` at least the rows of that key.

    ``total`` is at least the sum of ``count``. Keys of more than total / (4 x
    partitions) rows are at most 4 x partitions, whatever the data: their facts
    are broadcast, and their rows, of which one task would read too many, stay
    where they are. The other keys' rows are joined by a shuffle.
    """
    bound = max(SMALL_KEY, total // (4 * partitions(rows.sparkSession)))
    hot = F.broadcast(facts.filter(F.col(count) > bound))
    cold = facts.filter(F.col(count) <= bound)
    return rows.join(hot, on).unionByName(rows.join(hot.select(*on), on, "left_anti").join(cold, on))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def squeezed(text: Column) -> Column:
    """Each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
