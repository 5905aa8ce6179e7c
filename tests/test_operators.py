import json
import math

import pytest
from pyspark.sql import functions as F

from tributary.functions import macros as M
from tributary.functions import text as X
from tributary.operators import linking, metrics, perturb, retrieval
from tributary.sources import artifacts as A
from tributary.streaming import events as S
from tests.conftest import SF


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first()["r"]


def test_tokens(spark):
    assert one(spark, "The fct_orders.revenue_finance of A", X.search_tokens) == ["fct", "orders", "revenue", "finance", "fct_orders", "revenue_finance", "fct_orders.revenue_finance"]
    assert one(spark, None, X.search_tokens) == []
    assert one(spark, "custOrder-QTYs  x", X.name_tokens) == ["cust", "order", "qtys", "x"]
    assert [one(spark, w, lambda c: X.rewritten(c)) for w in ("amts", "class", "gas", "revs", "name")] == ["amount", "class", "gas", "revenue", "name"]


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "apple pie apple"), (2, "pie"), (3, "")], "id long, text string")
    got = {r["id"]: r["score"] for r in retrieval.bm25(docs, spark.createDataFrame([(0, "apple pie pie")], "qid long, text string")).collect()}
    avgdl = (3 + 1 + 1) / 3
    idf = lambda df: math.log(1 + (3 - df + 0.5) / (df + 0.5))
    part = lambda tf, dl: tf / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))
    assert got[1] == pytest.approx(idf(1) * part(2, 3) + 2 * idf(2) * part(1, 3))
    assert got[2] == pytest.approx(2 * idf(2) * part(1, 1))
    assert set(got) == {1, 2}


def test_fusion_windows_and_recall(spark):
    a = spark.createDataFrame([(0, 5, 1), (0, 6, 2)], "qid long, id long, rank int")
    b = spark.createDataFrame([(0, 6, 1)], "qid long, id long, rank int")
    got = {r["id"]: r["score"] for r in retrieval.rrf(a, b).collect()}
    assert got == {5: pytest.approx(1 / 61), 6: pytest.approx(1 / 62 + 1 / 61)}
    text = "\n".join(f"line {i}" for i in range(85))
    w = retrieval.windows(spark.createDataFrame([(1, text)], "id long, text string")).orderBy("part").collect()
    assert [(r["first_line"], r["last_line"]) for r in w] == [(1, 40), (41, 80), (81, 85)]
    assert "\n".join(r["chunk"] for r in w) == text
    gold = spark.createDataFrame([(0, 6), (0, 9)], "qid long, id long")
    assert retrieval.recall_at(a, gold, 2).first()["recall"] == 0.5


def test_fuzzy_scores(spark):
    schema = "{} string, plain array<string>"
    m = spark.createDataFrame([("order date", ["order", "date"]), ("none", []), ("ordr", ["ordr"]), ("abc", ["abc"]), ("ab", ["ab"]), ("a a", ["a", "a"])], schema.format("mention"))
    c = spark.createDataFrame([("order_date", ["order", "date"]), ("order", ["order"]), ("xyz", ["xyz"]), ("acb", ["acb"]), ("a", ["a"])], schema.format("column_id"))
    got = {(r["mention"], r["column_id"]): r["score"] for r in linking.fuzzy_scores(m, c).collect()}
    assert got[("order date", "order_date")] == pytest.approx(0.8)
    assert got[("ordr", "order")] == pytest.approx(0.8 * 8 / 9)
    assert got[("ab", "acb")] == pytest.approx(0.8 * 0.8)  # no shared pair of characters but at the ends
    assert set(got) == {("order date", "order_date"), ("ordr", "order"), ("ab", "acb")}  # "a a" has each token once: 2 of 3


def test_link_ambiguity_and_metrics(spark):
    cols = spark.createDataFrame([("a.total", "total"), ("b.total", "total"), ("a.user_id", "user_id")], "column_id string, name string")
    found = linking.link(spark.createDataFrame([("total",), ("a.user_id",), ("zebra",)], "mention string"), cols)
    assert {r["mention"]: r["ambiguous"] for r in linking.ambiguous(found).collect()} == {"total": True, "a.user_id": False}
    gold = spark.createDataFrame([("total", "b.total"), ("a.user_id", "a.user_id"), ("zebra", None)], "mention string, column_id string")
    m = linking.link_metrics(found, gold).first()
    assert (m["top1"], m["top3"], m["no_match"]) == (0.5, 1.0, 1.0)


def test_metrics(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], []), (["a"], []), ([], ["a"])], "p array<string>, g array<string>")
    got = [tuple(r) for r in df.select(*metrics.prf(F.col("p"), F.col("g"))).collect()]
    assert got == [(0.5, 0.5, 0.5), (1.0, 1.0, 1.0), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0)]
    pairs = spark.createDataFrame([(True, False)] * 5 + [(False, True)] + [(True, True)] * 3, "a boolean, b boolean")
    assert metrics.mcnemar(pairs, "a", "b") == {"b": 5, "c": 1, "p": pytest.approx(14 / 64)}
    assert metrics.mcnemar(pairs.filter("a and b"), "a", "b")["p"] == 1.0
    ten = spark.range(10).withColumn("v", F.col("id").cast("double"))
    assert [metrics.percentile(ten, "v", q).first()[0] for q in (10, 50, 95)] == [0.0, 4.0, 9.0]
    ci = metrics.bootstrap_ci(spark.range(200).withColumn("v", (F.col("id") % 2).cast("double")), "v").first()
    assert ci["n"] == 200 and 0.38 < ci["low"] < 0.47 and 0.53 < ci["high"] < 0.62
    assert metrics.bootstrap_ci(ten.limit(5), "v").first()["low"] is None
    same = metrics.paired_bootstrap(ten.select("id", "v"), ten.select("id", (F.col("v") + 2).alias("v")), "id", "v").first()
    assert (same["n"], same["mean"], same["low"], same["high"]) == (10, 2.0, 2.0, 2.0)
    split = metrics.stratified_split(spark.range(40).withColumn("s", F.col("id") % 4), "id", "s", 0.3, "x", F.col("id") == 5)
    assert {r["s"]: r["n"] for r in split.filter("held").groupBy("s").agg(F.count("*").alias("n")).collect()} == dict.fromkeys(range(4), 3)
    assert split.filter("id = 5").first()["held"]


def test_perturbation(spark):
    df = spark.createDataFrame([(i, i % 3, float(i), "abc"[i % 3], i % 2 == 0) for i in range(30)], "k int, i int, d double, s string, b boolean")
    base = perturb.fingerprint(df)
    assert perturb.changed(base, perturb.fingerprint(df.repartition(7))).count() == 0
    for column, mode in (("i", "relabel"), ("i", "cross"), ("i", "break"), ("d", "shift"), ("d", "cross"), ("s", "remap_existing"), ("s", "remap_new"), ("b", "flip_subset"), ("s", "null_out")):
        got = perturb.changed(base, perturb.fingerprint(perturb.perturbed(df, column, mode, "k"))).collect()
        assert [r["column"] for r in got] == [column], (column, mode)
    assert perturb.changed(base, perturb.fingerprint(df.limit(29))).count() == 5
    label = perturb.classify(spark.createDataFrame([(1,), (2,)], "x int"), spark.createDataFrame([(2,), (3,)], "x int"), ["x"])
    assert {r["x"]: r["label"] for r in label.collect()} == {1: "missing", 2: "confirmed", 3: "silent"}


def test_macros(spark):
    df = spark.createDataFrame([(1, 5, 9), (1, 8, 12), (2, 1, 2)], "g int, a int, b int")
    assert [tuple(r)[:3] for r in M.overlapping_ranges(df, "a", "b", ["g"]).collect()] == [(1, 5, 9)]
    assert M.broken_sequence(spark.createDataFrame([(1,), (2,), (4,)], "n int"), "n").count() == 1
    assert M.equality(df, df.limit(2)).count() == 1
    assert M.cardinality_equality(df, "g", df.filter("b > 2"), "g").count() == 1
    assert M.at_least_one(df.filter("g > 5"), "a").count() == 1 and M.not_constant(df.filter("g = 2"), "a").count() == 1
    assert M.nullcheck(spark.createDataFrame([("", 1)], "s string, n int")).first()["s"] is None
    assert M.not_null_proportion(spark.createDataFrame([(1,), (None,)], "n int"), "n").first()[0] == 0.5
    assert M.number_series(spark, 4).count() == 4
    assert one(spark, "about 1,234.5 units", M.number_in) == 1234.5
    assert one(spark, "https://a.b/c/d?x=1&y=2", M.url_path) == "c/d"
    assert M.recency(df, "a", F.lit(10)).count() == 1


def test_artifacts(spark, tmp_path):
    node = lambda n, t, r: {"unique_id": n, "resource_type": t, "name": n, "relation_name": r, "package_name": "p", "original_file_path": f"models/{n}.sql", "compiled_code": "", "columns": {"C": {"name": "C"}}}
    manifest = {
        "metadata": {"dbt_schema_version": "https://x/dbt/manifest/v12.json", "adapter_type": "duckdb"},
        "nodes": {"model.p.m": node("model.p.m", "model", '"d"."s"."M"'), "seed.p.r": node("seed.p.r", "seed", "d.s.raw"), "test.p.t": node("test.p.t", "test", None)},
        "sources": {"source.p.r": node("source.p.r", "source", "D.S.raw")},
        "exposures": {"exposure.p.e": {"unique_id": "exposure.p.e", "name": "e", "type": "dashboard", "depends_on": {"nodes": ["model.p.m"]}}},
        "unknown": 1,
    }
    catalog = {"metadata": {"dbt_schema_version": "https://x/dbt/catalog/v1.json"}, "nodes": {"model.p.m": {"metadata": {"database": "d", "schema": "s", "name": "M"}, "columns": {"C": {"name": "C", "type": "INT", "index": 1}}}}, "sources": {"source.p.z": {"metadata": {"database": "d", "schema": "s", "name": "z"}, "columns": {}}}}
    (tmp_path / "m.json").write_text(json.dumps(manifest))
    (tmp_path / "c.json").write_text(json.dumps(catalog))
    place = tmp_path / "compiled" / "p" / "models"
    place.mkdir(parents=True)
    (place / "model.p.m.sql").write_text("select 1")
    nodes = A.read_manifest(spark, str(tmp_path / "m.json"))
    assert {r["unique_id"] for r in nodes.collect()} == {"model.p.m", "seed.p.r", "source.p.r"}
    assert {r["relation"]: r["unique_id"] for r in A.relation_map(nodes).collect()} == {"d.s.m": "model.p.m", "d.s.raw": "source.p.r"}
    with pytest.raises(ValueError):
        A.relation_map(nodes.unionByName(nodes.filter("resource_type = 'model'"))).collect()
    filled = A.with_compiled(nodes, str(tmp_path))
    assert {r["unique_id"]: r["compiled_code"] for r in filled.collect()}["model.p.m"] == "select 1"
    cat = A.read_catalog(spark, str(tmp_path / "c.json"))
    assert [tuple(r)[-3:] for r in cat.collect()] == [("c", "INT", 1)]
    assert A.catalog_of_manifest(nodes).count() == 3
    assert [r["node"] for r in A.read_exposures(spark, str(tmp_path / "m.json")).collect()] == ["model.p.m"]
    with pytest.raises(ValueError):
        A.read_catalog(spark, str(tmp_path / "m.json"))
    with pytest.raises(ValueError):
        A.resolve_dialect("oracle9")
    before = A.content_key(spark, [str(tmp_path / "m.json"), str(tmp_path / "c.json")]).collect()
    old = spark.createDataFrame(before, "path string, sha256 string")
    (tmp_path / "c.json").write_text("{}")
    assert A.first_difference(old, A.content_key(spark, [str(tmp_path / "m.json"), str(tmp_path / "c.json")])).endswith("c.json")
    e = spark.createDataFrame([("a.x", "b.x", "RENAME")], "`from` string, `to` string, kind string")
    A.save_graph(e, e, str(tmp_path / "g"))
    assert A.load_graph(spark, str(tmp_path / "g"))[0].collect() == e.collect()
    assert A.confined(tmp_path, "../../etc/passwd") is None and A.confined(tmp_path, "m.json")


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    q = S.hourly(S.read_events(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("hours").collect())) == sorted(map(tuple, S.hourly(events).collect()))
