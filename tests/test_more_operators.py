from pyspark.sql import functions as F

from tributary.operators import chunks as C
from tributary.operators import linking, metrics, perturb, validation


def test_chunks(spark):
    sql = "-- head\nwith a as (\n select 1\n),\nb as (select 2)\nselect *\nfrom a"
    assert C.segments(sql) == [(1, 4, "cte a"), (5, 5, "cte b"), (6, 7, "final select")]
    assert C.segments("\n".join(["x"] * 85)) == [(1, 40, "lines 1"), (41, 80, "lines 41"), (81, 85, "lines 81")]
    text = "\n".join(["short line"] * 30 + ["word " * 700 + "end", "", "x" * 2000, "tail"])
    parts = list(C.bounded(text, 1, 100))
    assert all(C.fits(p, 100) for _, _, p in parts) and parts[0][0] == 1 and parts[-1][1] == 34
    assert "".join(p for _, _, p in parts).replace("\n", "") == text.replace("\n", "")
    got = C.bounded_chunks(spark.createDataFrame([(1, text), (2, None)], "id long, text string"), 100).collect()
    assert len([r for r in got if r["id"] == 1]) == len(parts)
    df = spark.createDataFrame([("q", i, n) for i, n in enumerate([5, 6, 3, 1])], "q string, i int, n int")
    assert [r["i"] for r in C.prefix_under_cap(df, F.col("n"), 11, [F.col("i")], ["q"]).collect()] == [0, 1]
    assert sorted(r["i"] for r in C.skip_and_pack(df, "n", 9, ["i"], "q").collect()) == [0, 2, 3]


def test_metrics(spark):
    df = spark.createDataFrame([(["a", "x"], ["a", "b"], ["x"]), ([], [], []), (["a"], [], [])], "p array<string>, g array<string>, c array<string>")
    got = [tuple(r) for r in df.select(*metrics.tolerant_prf(F.col("p"), F.col("g"), F.col("c"))).collect()]
    assert got == [(1.0, 0.5, 2 / 3), (1.0, 1.0, 1.0), (0.0, 0.0, 0.0)]
    d = spark.createDataFrame([(None,), (0,), (1,), (3,), (5,), (9,)], "d int")
    assert [r[0] for r in d.select(metrics.depth_bucket(F.col("d"))).collect()] == ["n/a", "seed", "1", "2-3", "4-5", "6+"]
    t = spark.createDataFrame([(1.0, False), (2.0, None), (50.0, True)], "ms double, cached boolean")
    assert tuple(metrics.latency(t, "ms", "cached").first()) == (2, 1.0, 2.0)
    assert {r["value"]: r["share"] for r in metrics.distribution(t, "cached").collect()}[True] == round(1 / 3, 6)


def test_perturbation_controls(spark):
    df = spark.range(50).withColumn("v", F.col("id") * 0.1)
    assert perturb.deterministic(df, lambda d: d.groupBy((F.col("id") % 3).alias("k")).agg(F.count("*").alias("n")))
    assert not perturb.deterministic(df, lambda d: d.withColumn("p", F.spark_partition_id()))
    models = spark.createDataFrame([("m", "select a\nwhere b > 5\n and c = 'x'\n and d between 3 and 4")], "model string, sql string")
    assert [(r["line"], r["text"]) for r in perturb.threshold_lines(models).orderBy("line").collect()] == [(2, "where b > 5"), (4, "and d between 3 and 4")]
    known = spark.createDataFrame([("m", 2), ("m", 1)], "model string, line int")
    assert [r["line"] for r in perturb.uncovered_lines(models, known).collect()] == [4]
    assert [r["line"] for r in perturb.stale_lines(models, known).collect()] == [1]
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "key int, outcome string")
    b = spark.createDataFrame([(1, "y"), (2, None), (4, "z")], "key int, outcome string")
    assert perturb.crossings(a, b).first()["n"] == 1
    assert perturb.spot_check(df, "id", 5).collect() == perturb.spot_check(df.repartition(4), "id", 5).collect()


def test_prose_and_verdicts(spark):
    claims = spark.createDataFrame([(0, "see models/a.sql lines 3-4", ["e1"]), (1, "see b.sql line 9", ["e1"]), (2, "No, it does not reach it.", ["r1"]), (3, "Yes, it does.", ["r1"])], "claim int, text string, ids array<string>")
    ledger = spark.createDataFrame([("e1", "p/models/a.sql", 2, 5)], "id string, file string, first_line int, last_line int")
    assert sorted((r["claim"], r["item"]) for r in validation.prose_references(claims, ledger).collect()) == [(1, "b.sql"), (1, "line 9")]
    facts = spark.createDataFrame([("r1", True)], "id string, reaches boolean")
    assert [r["claim"] for r in validation.verdicts(claims, facts).collect()] == [2]


def test_qualified_links(spark):
    cols = spark.createDataFrame([("fct_orders.items_total", "items_total"), ("dim_people.items_total", "items_total")], "column_id string, name string")
    said = spark.createDataFrame([("items total in fct orders",), ("item total of the dim people",), ("items total",)], "mention string")
    assert {r["mention"]: r["column_id"] for r in linking.qualified(said, cols).collect()} == {"items total in fct orders": "fct_orders.items_total", "item total of the dim people": "dim_people.items_total"}
