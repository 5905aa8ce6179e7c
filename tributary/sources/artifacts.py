"""Project artifacts as DataFrames: a manifest's nodes, a catalog's columns, seeds and logs."""

from __future__ import annotations

import json
from pathlib import Path
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = "struct<unique_id:string,resource_type:string,name:string,relation_name:string,original_file_path:string,compiled_code:string,package_name:string,database:string,schema:string,alias:string,depends_on:struct<nodes:array<string>>,columns:map<string,struct<name:string,data_type:string,description:string>>>"
EXPOSURE = "struct<unique_id:string,name:string,type:string,depends_on:struct<nodes:array<string>>>"
MANIFEST = f"struct<metadata:struct<dbt_schema_version:string,dbt_version:string,adapter_type:string,project_name:string>,nodes:map<string,{NODE}>,sources:map<string,{NODE}>,exposures:map<string,{EXPOSURE}>>"
TABLE = "struct<metadata:struct<database:string,schema:string,name:string>,columns:map<string,struct<name:string,type:string,index:int>>>"
CATALOG = f"struct<metadata:struct<dbt_schema_version:string>,nodes:map<string,{TABLE}>,sources:map<string,{TABLE}>>"
#: Adapters and the dialects that their SQL is in.
DIALECTS = ("duckdb", "postgres", "snowflake", "bigquery", "redshift", "databricks", "spark", "trino")


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("j")).select("j.*")


def _version(df: DataFrame, wanted: str, what: str) -> str:
    found = df.select("metadata.dbt_schema_version").first()[0] or ""
    if not found.rstrip("/").removesuffix(".json").endswith(f"/{wanted}"):
        raise ValueError(f"{what} of version {found!r}; {wanted} is read")
    return found


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A row per model, seed and source; every other kind of node is left out, other versions are refused."""
    m = _json(spark, path, MANIFEST)
    _version(m, "v12", "manifest")
    both = m.select(F.explode(F.map_values("nodes")).alias("n")).unionByName(m.select(F.explode(F.map_values(F.coalesce("sources", F.create_map().cast(f"map<string,{NODE}>")))).alias("n")))
    return both.select("n.*").filter(F.col("resource_type").isin("model", "seed", "source"))


def read_exposures(spark: SparkSession, path: str) -> DataFrame:
    e = _json(spark, path, MANIFEST).select(F.explode(F.map_values("exposures")).alias("e"))
    return e.select(F.col("e.unique_id").alias("exposure"), "e.type", F.explode("e.depends_on.nodes").alias("node"))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(unique_id, database, schema, name, column, type, index), columns in their order."""
    c = _json(spark, path, CATALOG)
    _version(c, "v1", "catalog")
    rows = c.select(F.explode("nodes").alias("unique_id", "t")).unionByName(c.select(F.explode("sources").alias("unique_id", "t")))
    return rows.select("unique_id", "t.metadata.*", F.explode(F.map_values("t.columns")).alias("c")).select("unique_id", "database", "schema", "name", F.lower("c.name").alias("column"), "c.type", "c.index")


def catalog_of_manifest(nodes: DataFrame) -> DataFrame:
    """Where no catalog is at hand: the declared columns, of type unknown."""
    rows = nodes.select("unique_id", "database", "schema", "name", F.explode(F.map_values("columns")).alias("c"))
    return rows.select("unique_id", "database", "schema", "name", F.lower("c.name").alias("column"), F.coalesce("c.data_type", F.lit("unknown")).alias("type"))


def with_compiled(nodes: DataFrame, target: str) -> DataFrame:
    """Fill a missing compiled_code from the files under target/compiled, by package and path."""
    files = nodes.sparkSession.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.sql").text(f"{target}/compiled", wholetext=True)
    files = files.select(F.regexp_replace(F.col("_metadata.file_path"), r"^.*/compiled/", "").alias("place"), "value")
    place = F.concat_ws("/", "package_name", "original_file_path")
    return nodes.withColumn("__place", place).join(files, F.col("__place") == F.col("place"), "left").withColumn("compiled_code", F.coalesce(F.nullif("compiled_code", F.lit("")), "value")).drop("__place", "place", "value")


def resolve_dialect(adapter: str | None, override: str | None = None) -> str:
    chosen = (override or adapter or "").lower()
    if chosen not in DIALECTS:
        raise ValueError(f"no dialect for {chosen!r}; give one of {', '.join(DIALECTS)}")
    return chosen


def normalize_relation(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, '["`]', ""))


def relation_map(nodes: DataFrame) -> DataFrame:
    """(relation, unique_id): a source beats a seed of the same relation; any other clash raises."""
    rel = nodes.filter("relation_name is not null").select(normalize_relation(F.col("relation_name")).alias("relation"), "unique_id", "resource_type")
    each = rel.groupBy("relation").agg(F.sort_array(F.collect_list(F.struct(F.when(F.col("resource_type") == "source", 0).otherwise(1).alias("o"), "unique_id", "resource_type"))).alias("all"))
    pair = F.array_sort(F.transform("all", lambda x: x["resource_type"]))
    bad = each.filter((F.size("all") > 1) & ~(pair == F.array(F.lit("seed"), F.lit("source")))).select("relation").first()
    if bad:
        raise ValueError(f"several nodes write {bad['relation']}")
    return each.select("relation", F.col("all")[0]["unique_id"].alias("unique_id"))


def unmapped(catalog: DataFrame, mapped: DataFrame) -> DataFrame:
    rel = catalog.select(F.lower(F.concat_ws(".", "database", "schema", "name")).alias("relation")).distinct()
    return rel.join(mapped, "relation", "left_anti").orderBy("relation")


def read_seed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def content_key(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, sha256) of files: a cache is stale where one differs."""
    return spark.read.format("binaryFile").load(paths).select("path", F.sha2("content", 256).alias("sha256"))


def first_difference(old: DataFrame, new: DataFrame) -> str | None:
    """The first file (by name) whose hash changed, came or went."""
    o, n = old.select("path", F.col("sha256").alias("a")), new.select("path", F.col("sha256").alias("b"))
    row = o.join(n, "path", "full").filter("not (a <=> b)").orderBy("path").first()
    return row["path"] if row else None


def save_graph(edges: DataFrame, indirect: DataFrame, path: str) -> None:
    """Both edge tables as Parquet, and a version beside them."""
    spark = edges.sparkSession
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    indirect.write.mode("overwrite").parquet(f"{path}/indirect")
    spark.createDataFrame([(1,)], "version int").coalesce(1).write.mode("overwrite").json(f"{path}/version")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    version = spark.read.json(f"{path}/version").first()["version"]
    if version != 1:
        raise ValueError(f"graph of version {version}; 1 is read")
    return spark.read.parquet(f"{path}/edges"), spark.read.parquet(f"{path}/indirect")


def append_log(rows: DataFrame, path: str) -> None:
    """Records with a ``day`` column, appended as JSON lines by day."""
    rows.write.mode("append").partitionBy("day").json(path)


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def confined(root: Path, display: str) -> Path | None:
    """A file under ``root``, or None where the path leaves it."""
    place = (root / display).resolve()
    return place if place.is_relative_to(root.resolve()) and place.is_file() else None


def canonical_json(edges: DataFrame) -> str:
    """The edges as one sorted JSON text; for project graphs, which fit a driver."""
    rows = [r.asDict(recursive=True) for r in edges.orderBy(*edges.columns).collect()]
    return json.dumps(rows, sort_keys=True, separators=(",", ":"))


class Target(NamedTuple):
    """What a project's build leaves behind, read in one go."""

    nodes: DataFrame
    catalog: DataFrame
    relations: DataFrame
    exposures: DataFrame
    dialect: str
    has_catalog: bool


def load_target(spark: SparkSession, target: str, dialect: str | None = None) -> Target:
    """The artifacts of a folder: the manifest with its compiled texts, the catalog or, where there is none, what the manifest declares."""
    path = f"{target.rstrip('/')}/manifest.json"
    nodes = read_manifest(spark, path)
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/compiled")
    exists = lambda p: p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    if exists(place):
        nodes = with_compiled(nodes, target)
    has = exists(spark._jvm.org.apache.hadoop.fs.Path(f"{target}/catalog.json"))
    catalog = read_catalog(spark, f"{target}/catalog.json") if has else catalog_of_manifest(nodes)
    adapter = _json(spark, path, MANIFEST).select("metadata.adapter_type").first()[0]
    return Target(nodes, catalog, relation_map(nodes), read_exposures(spark, path), resolve_dialect(adapter, dialect), has)


def referenced_files(nodes: DataFrame, root: str) -> DataFrame:
    """(file): the files that nodes are written in, those of packages under the packages' folder."""
    own = F.col("package_name") == root
    return nodes.filter("original_file_path is not null").select(F.when(own, F.col("original_file_path")).otherwise(F.concat_ws("/", F.lit("dbt_packages"), "package_name", "original_file_path")).alias("file")).distinct()


def is_stale(spark: SparkSession, cache: str, sources: list[str]) -> bool:
    """Whether a cache is missing, or some source file is younger than its youngest part."""

    def youngest(paths: list[str]):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
        return files.agg(F.max("modificationTime")).first()[0]

    place = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return True
    kept, now = youngest([cache]), youngest(sources)
    return kept is None or (now is not None and now > kept)


def save_index(chunks: DataFrame, vectors: DataFrame, path: str, key: dict[str, str]) -> None:
    """Search chunks (id, ...) with their vectors (id, vector) as Parquet; what they were made from is written last, so an index that broke off has no key."""
    spark = chunks.sparkSession
    chunks.join(vectors, "id", "left").write.mode("overwrite").parquet(f"{path}/chunks")
    spark.createDataFrame(sorted(key.items()), "part string, value string").coalesce(1).write.mode("overwrite").json(f"{path}/key")


def load_index(spark: SparkSession, path: str, key: dict[str, str]) -> DataFrame:
    """The chunks and vectors of an index made from the same parts; the first part that differs is told."""
    have = {r["part"]: r["value"] for r in spark.read.schema("part string, value string").json(f"{path}/key").collect()}
    changed = next((k for k in sorted(key.keys() | have.keys()) if key.get(k) != have.get(k)), None)
    if changed:
        raise ValueError(f"the index was made from another {changed}")
    return spark.read.parquet(f"{path}/chunks")
