"""Command line: ``python -m tributary COMMAND``, over SQL models and Parquet tables, or over a saved graph."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession


def _session() -> SparkSession:
    return SparkSession.builder.appName("tributary").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def ingest(spark: SparkSession, tables: str, models: str, out: str) -> str:
    """Register the tables (Parquet, by file name), read each model's lineage from its plan and save the graph."""
    from tributary.plans import lineage as L
    from tributary.sources.artifacts import save_graph

    for p in sorted(Path(tables).glob("*.parquet")):
        spark.read.parquet(str(p)).createOrReplaceTempView(p.stem)
    found = L.project_lineage(spark, {p.stem: p.read_text() for p in sorted(Path(models).rglob("*.sql"))})
    direct, indirect = L.edges_frame(spark, found), L.indirect_frame(spark, found)
    save_graph(direct, indirect, out)
    bad = [f"{m.model}: {m.quality} {m.reason}" for m in found if m.quality != "FULL"]
    return "\n".join([f"{len(found)} models, {direct.count()} edges, {indirect.count()} indirect edges", *bad])


def main(argv: list[str] | None = None) -> str:
    p = argparse.ArgumentParser(prog="tributary")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("ingest")
    c.add_argument("tables")
    c.add_argument("models")
    c.add_argument("--out", required=True)
    for name in ("trace", "impact", "report", "ask", "dot"):
        c = sub.add_parser(name)
        c.add_argument("graph")
        if name in ("trace", "impact", "ask"):
            c.add_argument("text")
        c.add_argument("--depth", type=int, default=10)
        c.add_argument("--indirect", action="store_true")
    c = sub.add_parser("search")
    c.add_argument("documents")
    c.add_argument("text")
    c.add_argument("-k", type=int, default=8)
    a = p.parse_args(argv)
    spark = _session()
    if a.command == "ingest":
        return ingest(spark, a.tables, a.models, a.out)
    if a.command == "search":
        from tributary.operators import retrieval

        docs = spark.read.parquet(a.documents).toDF("id", "text", *spark.read.parquet(a.documents).columns[2:])
        hits = retrieval.hybrid(docs.select("id", "text"), spark.createDataFrame([(0, a.text)], "qid long, text string"), a.k)
        return "\n".join(f"{r['rank']:>3} {r['score']:.6f} {r['id']}" for r in hits.orderBy("rank").collect())
    from tributary.plans import answers, graph
    from tributary.sources.artifacts import load_graph

    direct, indirect = load_graph(spark, a.graph)
    edges = graph.hops(direct, indirect if a.indirect else None)
    if a.command == "ask":
        return str(answers.answer(a.text, direct, indirect))
    if a.command == "dot":
        return answers.dot(edges)
    if a.command == "report":
        kinds = {r["kind"]: r["n"] for r in direct.groupBy("kind").count().withColumnRenamed("count", "n").collect()}
        return f"{sum(kinds.values())} edges {kinds}, {indirect.count()} indirect edges"
    nodes = edges.selectExpr("`from` as node").union(edges.select("to")).distinct()
    found = [r["node"] for r in graph.resolve(nodes, a.text).orderBy("node").collect()]
    if len(found) != 1:
        return f"{a.text}: " + ("no such column" if not found else "one of " + ", ".join(found))
    if a.command == "trace":
        return answers.render_paths(found[0], graph.upstream_paths(edges, found[0], a.depth), a.depth)
    return answers.render_impact(found[0], graph.downstream(edges, found[0], a.depth))


if __name__ == "__main__":
    print(main())
