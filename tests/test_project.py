import pytest
from pyspark.sql import functions as F

from tributary.operators import cards, linking, mentions, perturb, toolbox
from tributary.sources import artifacts

COLUMNS = [("dim.customer_count", "customer_count"), ("dim.amount_usd", "amount_usd"), ("fct.order_total", "order_total"), ("fct.state", "state")]


@pytest.fixture(scope="module")
def columns(spark):
    return spark.createDataFrame(COLUMNS, "column_id string, name string")


def said(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "mention string")


def test_phrase_forms(spark):
    got = {(r["mention"], r["rule"]): r["form"] for r in linking.phrase_forms(said(spark, "number of open orders per day", "how many customers", "total amount by state", "state", "a count of rows in it")).collect()}
    assert got[("number of open orders per day", None)] == "number of open orders per day"
    assert got[("number of open orders per day", "P1")] == "open orders count per day"
    assert got[("how many customers", "P2")] == "customers count"
    assert got[("total amount by state", "P4")] == "amount total by state"
    assert got[("a count of rows in it", "P3")] == "a rows count in it"
    assert len(got) == 9


def test_dotted_ids(spark, columns):
    got = {r["mention"]: (r["column_id"], r["how"]) for r in linking.dotted(said(spark, "dim.customer_count", "dim.amt", "dim.amt_usd", "fct.order_tot", "fct.nothing", "other.x", "two words"), columns).collect()}
    assert got == {"dim.customer_count": ("dim.customer_count", "exact"), "dim.amt": ("dim.amount_usd", "abbreviation"), "dim.amt_usd": ("dim.amount_usd", "abbreviation"), "fct.order_tot": ("fct.order_total", "abbreviation"), "fct.nothing": (None, "none")}


def test_search_stage_and_thresholds(spark, columns):
    c = columns.select(F.col("column_id").alias("id"), F.regexp_replace("name", "_", " ").alias("text"))
    found = linking.search_candidates(said(spark, "order total", "zebra crossing"), c, 0.9)
    best = {r["mention"]: r["column_id"] for r in found.collect() if r["cosine"] > 0.99}
    assert best == {"order total": "fct.order_total"}
    linked = linking.link(said(spark, "state", "order total"), columns, fuzzy=False)
    both = linking.with_search(linked, found)
    assert {(r["mention"], r["tier"]) for r in both.collect()} == {("state", "exact_name"), ("order total", "surface")}
    loose = linking.search_candidates(said(spark, "order total", "order zebra"), c, 0.0)
    least = linking.least_cosine(loose, said(spark, "order zebra")).first()
    assert 0 < least["top"] < least["least"] <= least["top"] + 0.005
    gold = spark.createDataFrame([("state", "fct.state"), ("nothing", None)], "mention string, column_id string")
    assert {r["positive"]: (r["n"], r["high"]) for r in linking.score_spread(linked, gold).collect()} == {True: (1, 0.97), False: (1, 0.0)}


def test_cases_are_linked(spark, columns):
    made = linking.cases(columns)
    assert {r["variant"] for r in made.select("variant").distinct().collect()} == {"id", "name", "spaced", "shortened", "camel", "plural", "qualified", "none"}
    found = linking.link(made.filter("variant in ('id', 'name', 'spaced', 'shortened', 'camel', 'plural')").select("mention"), columns)
    top = found.filter("rank = 1").select("mention", F.col("column_id").alias("got"))
    assert made.filter("variant in ('id', 'name', 'spaced', 'shortened', 'camel', 'plural')").join(top, "mention", "left").filter("not (got <=> column_id)").count() == 0
    assert {r["mention"]: r["score"] for r in linking.baseline(said(spark, "order totals total", "state"), columns).collect()} == {"state": 1.0, "order totals total": pytest.approx(0.6667)}


def test_cards_and_chunks(spark):
    catalog = spark.createDataFrame([("M", "A", "int"), ("m", "b", "text")], "model string, column string, type string")
    declared = spark.createDataFrame([("m", "b", "Bee"), ("m", "c", None)], "model string, column string, description string")
    edges = spark.createDataFrame([("r.x", "m.b"), ("m.b", "z.q")], "`from` string, `to` string")
    got = {r["column"]: tuple(r)[2:] for r in cards.column_cards(catalog, declared, edges).collect()}
    assert got == {"a": ("column m.a (int)", 0, 0), "b": ("column m.b (text): Bee", 1, 1), "c": ("column m.c", 0, 0)}
    assert [tuple(r) for r in cards.parser_only(edges, cards.column_cards(catalog, declared)).collect()] == [("z", 1)]
    sql = "with a as (\n select 1\n)\nselect * from a"
    parts = cards.model_segments(spark.createDataFrame([("m", sql)], "model string, sql string")).orderBy("first_line").collect()
    assert [(r["label"], r["first_line"], r["last_line"]) for r in parts] == [("cte a", 1, 3), ("final select", 4, 4)]
    text = spark.createDataFrame([("a.b", "same"), ("a.b", "same"), ("c", " ")], "owner string, text string")
    assert [r["kind"] for r in cards.of_kinds(cards.project_chunks(column=text, readme=text), "readme").collect()] == ["readme"]
    found = spark.createDataFrame([(1, "x", 1)], "qid long, id string, rank int")
    chunk = spark.createDataFrame([("x", "sql", "m", "y" * 700)], "id string, kind string, owner string, text string")
    (hit,) = cards.hits(found, chunk).collect()
    assert len(hit["text"]) == 601 and hit["clipped"]


YAML = """version: 2
models:
  - name: orders
    description: all
    columns:
      - name: id
        description: key
        tests: [unique]
      - name: state
  - name: people
    columns:
      - name: id
sources:
  - name: raw
"""


def test_yaml_entries_and_citations(spark):
    assert cards.entry_lines(YAML, "models", "orders") == (3, 9)
    assert cards.entry_lines(YAML, "models", "orders", "columns", "id") == (6, 8)
    assert cards.entry_lines(YAML, "models", "people", "columns", "id") == (12, 12)
    assert cards.entry_lines(YAML, "models", "orders", "columns", "none") is None
    assert cards.entry_lines(YAML, "sources", "raw") == (14, 14)
    chunks = spark.createDataFrame([("1", "column", "orders.id"), ("2", "column", "seed.x"), ("3", "sql", "people"), ("4", "column", "no.y")], "id string, kind string, owner string")
    entries = spark.createDataFrame([("orders.id", "m.yml", 6, 8)], "owner string, file string, first_line int, last_line int")
    seeds = spark.createDataFrame([("seed", "seed.csv")], "model string, file string")
    models = spark.createDataFrame([("orders", "o.sql", 9), ("people", "p.sql", 4)], "model string, file string, n_lines int")
    got = {r["id"]: (r["file"], r["last_line"], r["level"]) for r in cards.cited(chunks, entries, seeds, models).collect()}
    assert got == {"1": ("m.yml", 8, "entry"), "2": ("seed.csv", 1, "header"), "3": ("p.sql", 4, "model"), "4": (None, None, None)}
    audit = cards.citation_audit(spark.createDataFrame([("column", "orders.id", "- name: ID"), ("column", "orders.state", "states"), ("sql", "m", None)], "kind string, owner string, cited string"))
    assert sorted(map(tuple, audit.collect())) == [("column", 2, 1), ("sql", 1, 0)]


def test_mentions_and_denials(spark):
    nodes = spark.createDataFrame([("a_m.x", "column"), ("b_m.y", "column"), ("c_m.z", "column")], "node string, kind string")
    texts = ["a_m.x comes from b_m.y, but not from c_m.z.", "a_m.x, which never reads b_m.y, reads c_m.z.", "a_m.x rather than b_m.y is used. c_m.z isn't.", "a_m.x is not null; no_m.q exists.", "not only a_m.x but b_m.y", "a_m.x column does not change"]
    found = mentions.mentions(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), nodes)
    got = {(r["id"], r["node"]): r["negated"] for r in mentions.kept_nodes(found).collect()}
    no = {k for k, v in got.items() if v}
    assert no == {(0, "c_m.z"), (1, "b_m.y"), (2, "b_m.y"), (2, "c_m.z"), (5, "a_m.x")}
    assert {r["node"] for r in found.filter("kind = 'unknown'").collect()} == {"no_m.q"}


def test_scores_of_answers(spark):
    q = spark.createDataFrame([(0, "upstream", ["a_m.x", "b_m.y"], None), (1, "false_premise", None, "a_m.x"), (2, "downstream", [], None)], "id long, subtype string, gold array<string>, premise string")
    rec = "struct<refused:boolean,text:string,claims:array<struct<text:string>>>"
    records = spark.createDataFrame([(0, (False, "a_m.x and", [("no_m.w",)]), None, None, None), (1, (False, "never a_m.x", []), None, None, None), (2, None, None, None, "broke")], f"id long, answer {rec}, validated {rec}, augmented {rec}, error string")
    preds = mentions.predictions(records)
    nodes = spark.createDataFrame([("a_m.x", "column"), ("b_m.y", "column")], "node string, kind string")
    rows = {r["id"]: r for r in mentions.scored(q, preds, mentions.mentions(preds, nodes)).collect()}
    assert (rows[0]["precision"], rows[0]["recall"], rows[0]["n_unknown"], rows[0]["mode"]) == (1.0, 0.5, 1, "direct")
    assert rows[1]["premise_outcome"] == "rejected" and rows[1]["f1"] is None
    assert rows[2]["answer_kind"] == "error" and rows[2]["f1"] == 0.0 and rows[2]["mode"] == "all"
    assert tuple(mentions.interpreted(spark.createDataFrame([(1, 'Interpreted "db.a.b" as c.d. It is')], "id long, text string")).first()) == (1, "a.b", "c.d")
    sheet = spark.createDataFrame([("s", 1, True), ("s", 1, False), ("s", 2, True)], "system string, fact int, right boolean")
    assert tuple(mentions.sheet_means(sheet).first()) == ("s", 2, 0.75)


def test_records_and_removed_claims(spark):
    a = spark.createDataFrame([(1, "x", 0.5), (2, "y", 0.6)], "id int, v string, seconds double")
    b = spark.createDataFrame([(1, "x", 0.9), (2, "z", 0.6)], "id int, v string, seconds double")
    assert sorted((r["v"], r["only"]) for r in mentions.same_records(a, b, ("seconds",)).collect()) == [("y", "a"), ("z", "b")]
    before = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c")], "id int, claim int, node string")
    fails = spark.createDataFrame([(1, 1, "R4"), (1, 2, "R4"), (1, 2, "R7")], "id int, claim int, rule string")
    gold = spark.createDataFrame([(1, "c")], "id int, node string")
    assert sorted(map(tuple, mentions.removed_claims(before, before.filter("claim = 0"), fails, gold).collect())) == [("R4", 2, 1), ("R7", 1, 1)]
    runs = spark.createDataFrame([(1.0, [(False,)]), (2.0, [(True,)]), (3.0, [])], "seconds double, calls array<struct<cached:boolean>>")
    assert tuple(mentions.fresh_latency(runs).first()) == (1, 1.0, 1.0)


def test_arguments_and_toolbox(spark):
    assert toolbox.argument({"k": "7"}, "k", int, low=1, high=5) == 5 and toolbox.argument({}, "k", int, 3) == 3
    assert toolbox.argument({"b": "TRUE"}, "b", bool) is True and toolbox.argument({"s": " x "}, "s", str) == "x"
    for given, kind in (({"k": "x"}, int), ({"k": "maybe"}, bool), ({"k": " "}, str), ({}, str)):
        with pytest.raises(toolbox.BadArgument):
            toolbox.argument(given, "k", kind)
    edges = spark.createDataFrame([("a.x", "b.y", "RENAME", "b.sql", 3, 4, "line"), ("a.x", "b.z", "IDENTITY", "b.sql", 1, 9, "model")], "`from` string, `to` string, kind string, file string, first_line int, last_line int, level string")
    recs = toolbox.edge_records(edges)
    assert sorted(r["text"] for r in recs.collect()) == ["a.x -> b.y [RENAME] b.sql:3-4", "a.x -> b.z [IDENTITY] b.sql"]
    box = toolbox.Toolbox(spark, {"edges": lambda a: recs.filter(F.col("to") == toolbox.argument(a, "to", str))})
    assert box.call("edges", {"to": "b.y"}).count() == 1 and "is missing" in box.call("edges", {}) and "not one of" in box.call("none", {})
    assert [(r["tool"], r["ok"], r["n_rows"]) for r in box.calls().orderBy("n").collect()] == [("edges", True, 1), ("edges", False, 0), ("none", False, 0)]
    (given,) = box.ledger().collect()
    claims = spark.createDataFrame([(0, " says ", [given["id"], "r_00000001", given["id"], " "]), (1, "bare", [])], "claim int, text string, ids array<string>")
    full = toolbox.with_citations(claims, recs)
    assert {r["claim"]: r["line"] for r in toolbox.rendered(full).collect()} == {0: "- says [b.sql:3-4] [graph check]", 1: "- bare [no citation]"}
    seen = toolbox.ids_in(spark.createDataFrame([(1, f"x {given['id']} {given['id']} e_nothex")], "n int, text string"))
    assert [tuple(r) for r in seen.collect()] == [(1, given["id"])]


def test_talks_fit_their_budget(spark):
    rows = [(1, "user", "q" * 30, "", ""), (2, "tool", "a" * 300, "b" * 60, "c" * 6), (3, "tool", "d" * 300, "e" * 60, "f" * 6)]
    talk = spark.createDataFrame(rows, "n int, kind string, full string, short string, shortest string")
    levels = lambda cap: [r["level"] for r in toolbox.compacted(talk, cap).orderBy("n").collect()]
    assert levels(1000) == [0, 0, 0] and levels(150) == [0, 1, 0] and levels(60) == [0, 1, 1] and levels(35) == [0, 2, 1] and levels(14) == [0, 2, 2]
    assert toolbox.compacted(talk, 14).first()["fits"] and not toolbox.compacted(talk, 13).first()["fits"]
    told = toolbox.regenerate(spark.createDataFrame([("R2", "b" * 30), ("R1", "a" * 30), ("R1", "a" * 30)], "rule string, line string"), 12)
    assert [r["rule"] for r in told.collect()] == ["R1"]


def test_policies_and_files(spark, columns):
    tie = spark.createDataFrame([("a.x", 0.9, 1), ("b.x", 0.88, 2), ("c.x", 0.5, 3)], "column_id string, score double, rank int")
    assert toolbox.ambiguity(tie, "what of x?")["mode"] == "per_candidate" and toolbox.ambiguity(tie, "what of a.x?") is None
    assert toolbox.ambiguity(tie, "x?", "b.x")["downstream"] == "b.x"
    many = spark.createDataFrame([(f"{c}.x", 0.9, i) for i, c in enumerate("abcd")], "column_id string, score double, rank int")
    assert toolbox.ambiguity(many, "x?")["mode"] == "clarification"
    asked = spark.createDataFrame([("dim.amount",), ("dim.amount_usd",), ("other.q",)], "node string")
    assert {r["node"]: r["closest"][0] for r in toolbox.unknown_columns(asked, columns).collect()} == {"dim.amount": "dim.amount_usd"}
    files = spark.createDataFrame([("f", "one\ntwo x\nthree")], "file string, text string")
    import hashlib

    cites = spark.createDataFrame([("a", "f", 2, 2, hashlib.sha1(b"two x").hexdigest(), "X"), ("b", "f", 2, 9, None, None), ("c", "g", 1, 1, None, None), ("d", "f", 1, 1, "0", None), ("e", "f", 1, 1, None, "two")], "id string, file string, first_line int, last_line int, sha string, word string")
    assert {r["id"]: r["problem"] for r in toolbox.on_disk(cites, files).collect()} == {"b": "no such lines", "c": "no such file", "d": "another excerpt", "e": "the word is not there"}
    names = toolbox.named_models(spark.createDataFrame([(1, "does fct order items feed orders?")], "id int, text string"), spark.createDataFrame([("fct_order_items",), ("order_items",), ("orders",), ("people",)], "model string"))
    assert sorted(r["model"] for r in names.collect()) == ["fct_order_items", "orders"]
    assert toolbox.redacted(spark.createDataFrame([(1, "user: a\npassword: 'x y'\nAPI_KEY=zz")], "id int, text string")).first()["text"] == "user: a\npassword: ***\nAPI_KEY=***"
    closure = spark.createDataFrame([("a", "b", 2)], "root string, node string, depth int")
    facts = toolbox.reach_facts(closure, spark.createDataFrame([("a", "b"), ("b", "a")], "from_col string, to_col string"))
    assert {(r["from_col"], r["reaches"], r["hops"]) for r in facts.collect()} == {("a", True, 2), ("b", False, None)}
    gaps = toolbox.pool_gaps(spark.createDataFrame([("x",), ("x",)], "bucket string"), spark.createDataFrame([("x", 2), ("y", 1)], "bucket string, need int"))
    assert [tuple(r) for r in gaps.collect()] == [("y", 0, 1)]
    m = toolbox.run_manifest(spark, "s", columns, {"k": "v"}).first()
    assert m["n_records"] == 4 and m["settings"] == {"k": "v"} and m["records_hash"] == toolbox.run_manifest(spark, "s", columns.orderBy(F.desc("name")), {"k": "v"}).first()["records_hash"]


def test_shuffled_and_modes(spark):
    d = spark.range(1000).withColumn("v", F.col("id") * 3)
    s = perturb.perturbed(d, "v", "shuffle", "id")
    assert s.agg(F.sum("v")).first()[0] == d.agg(F.sum("v")).first()[0] and s.join(d.withColumnRenamed("v", "w"), "id").filter("v <> w").count() > 900
    assert s.columns == d.columns and "shuffle" in perturb.modes_of(d.schema["v"].dataType)


def test_index_and_staleness(spark, tmp_path, columns):
    path = f"file://{tmp_path}/index"
    assert artifacts.is_stale(spark, path, [f"file://{tmp_path}"])
    (tmp_path / "src.sql").write_text("select 1")
    chunks = columns.select(F.col("column_id").alias("id"), "name")
    artifacts.save_index(chunks, chunks.select("id", F.array(F.lit(1.0)).alias("vector")), path, {"manifest": "1"})
    assert artifacts.load_index(spark, path, {"manifest": "1"}).count() == 4
    with pytest.raises(ValueError, match="manifest"):
        artifacts.load_index(spark, path, {"manifest": "2"})
    assert not artifacts.is_stale(spark, path, [f"file://{tmp_path}/src.sql"])
