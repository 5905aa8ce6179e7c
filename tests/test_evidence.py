from pyspark.sql import functions as F

from tributary.operators import evidence as E
from tributary.operators import perturb
from tributary.plans import gold
from tributary.plans import graph as G


def test_evidence(spark):
    runs = spark.createDataFrame(
        [(1, [("t", {"e1": ("RENAME", "a.x", "b.x")}), ("t", {"e1": ("RENAME", "a.x", "b.x"), "e2": ("IDENTITY", "b.x", "c.x")})])],
        "run int, steps array<struct<tool:string,results:map<string,struct<kind:string,from_col:string,to_col:string>>>>",
    )
    ledger = E.ledger_of_steps(runs)
    assert sorted((r["id"], r["kind"]) for r in ledger.collect()) == [("e1", "RENAME"), ("e2", "IDENTITY")]
    items = spark.createDataFrame([("a", 1, 0, "x" * 30, "k"), ("b", 0, 1, "y" * 30, "k"), ("a", 0, 2, "z" * 3, "k"), ("c", 2, 3, "w" * 300, "m")], "id string, priority int, order int, text string, kind string")
    assert {r["id"]: (r["priority"], r["order"], r["text"][:1]) for r in E.deduplicated(items).collect()} == {"a": (0, 0, "z"), "b": (0, 1, "y"), "c": (2, 3, "w")}
    kept, out = E.trimmed(items, 21)
    assert [r["text"][0] for r in kept.collect()] == ["y", "z", "x"] and [tuple(r) for r in out.collect()] == [("m", 1)]
    names = spark.createDataFrame([(0, "a.x"), (0, "c.x"), (1, "a.x"), (1, "zz.q")], "claim int, name string")
    claims = spark.createDataFrame([(0,), (1,)], "claim int")
    assert [(r["claim"], r["path"]) for r in E.completions(claims, ledger, names).collect()] == [(0, ["e1", "e2"])]
    found = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "node string, depth int")
    assert {r["depth"]: r["nodes"] for r in E.left_out(found, spark.createDataFrame([("b",)], "node string")).collect()} == {1: ["a"], 2: ["c"]}
    closure = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c")], "root string, node string")
    chain = lambda *n: E.chain_end(spark.createDataFrame([(x,) for x in n], "node string"), closure)
    assert chain("a", "c", "b") == "c" and chain("a", "z") is None
    a, b = (spark.createDataFrame(r, "q int, f1 double") for r in ([(1, 0.5), (2, 1.0)], [(1, 0.7), (2, 0.9), (3, 0.1)]))
    assert {r["q"]: r["change"] for r in E.compared(a, b, "q", "f1").collect()} == {1: "better", 2: "worse"}


def test_gold_checks(spark):
    direct, indirect = gold.gold_edges(spark), gold.expand_indirect(spark)
    nodes = spark.createDataFrame(sorted({(f"{m}.{c}",) for m, c in gold.columns()} | {(a,) for a, _, _, _ in gold.direct_rows()}), "node string")
    assert gold.check_endpoints(direct, nodes).count() == 0 and gold.check_endpoints(indirect, nodes).count() == 0
    assert gold.check_duplicates(direct).count() == 0 and gold.check_duplicates(direct.union(direct.limit(1))).count() == 1
    assert gold.check_overlap(direct, indirect).count() == 0 and gold.check_overlap(direct, direct).count() == direct.select("from", "to").distinct().count()
    alone = {r["node"] for r in gold.check_incoming(direct, nodes, G.starts(direct)).collect()}
    assert alone == {f"{m}.{c}" for m, cs in gold.CONSTANTS.items() for c in cs} - {r["node"] for r in G.starts(direct).collect()}
    assert {r["depth"]: r["n"] for r in gold.depth_histogram(direct).collect()}[0] > 20
    q = gold.trace_question(G.hops(direct), "fct_monthly.revenue")
    assert q["inputs"] == ["int_order_totals.items_total"] and q["sources"] == ["lineitem.l_discount", "lineitem.l_extendedprice"]


def test_local_check(spark):
    spark.createDataFrame([(i, i * 1.5, "ab"[i % 2]) for i in range(20)], "k int, v double, s string").createOrReplaceTempView("raw_t")
    models = {"m_copy": "select k, v * 2 as w, s from raw_t", "m_sum": "select s, sum(v) as total, count(*) as n from raw_t group by s"}
    expected = spark.createDataFrame([("m_copy", "w"), ("m_sum", "total"), ("m_sum", "n")], "model string, column string")
    got = perturb.local_check(spark, "raw_t", "v", ["shift", "scale"], "k", models, expected)
    assert {(r["model"], r["column"]): (r["label"], r["modes"]) for r in got.collect()} == {("m_copy", "w"): ("confirmed", ["scale", "shift"]), ("m_sum", "total"): ("confirmed", ["scale", "shift"]), ("m_sum", "n"): ("silent", [])}
    assert perturb.report(got) == "2 confirmed, 0 missing, 1 silent\nsilent: m_sum.n"
    assert spark.table("raw_t").agg(F.sum("v")).first()[0] == sum(i * 1.5 for i in range(20))
