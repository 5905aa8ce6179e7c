import pytest

from tributary import __main__ as cli
from tributary.plans import answers as A
from tributary.plans import citations as C
from tributary.plans import lineage as L
from tests.conftest import SF

SQL = """select
    s.id,
    s.price * 2 as double_price,
    p.*
from sales s
join people p
    on s.buyer = p.id
where s.state = 'a'
order by s.day"""


def test_citations(spark):
    assert C.cite(SQL, "double_price", "price") == C.Place(3, 3, "line")
    assert C.cite(SQL, "name", "name")[:3] == (4, 4, "star")
    assert C.cite(SQL, "id", "buyer", "JOIN") == C.Place(6, 7, "line")
    assert C.cite(SQL, "id", "state", "FILTER") == C.Place(8, 8, "line")
    assert C.cite(SQL, "id", "day", "SORT") == C.Place(9, 9, "line")
    missing = C.cite(SQL, "id", "nope", "GROUP_BY")
    assert missing.level == "model" and missing.reason
    assert C.source_lines("a\n{{ x }}\nb", "a\nselect 1\nb") == [(1, 1), (2, 2), (3, 3)]
    assert C.source_lines("a\n{% for %}\nb", "a\n1\n2\n3\nb") == [(1, 1), (2, 2), (2, 2), (2, 2), (3, 3)]
    assert C.source_lines("x\nx\na\nx", "x\na\nx\nx\nnew") == [(1, 1), (3, 3), (4, 4), None, None]
    assert C.source_lines("", "a") == [None] and C.source_lines("a\nb", "b") == [(2, 2)]
    assert [(a, b) for a, b, _ in C.excerpt(SQL, [(1, 1), (3, 3), (9, 9)], 1)] == [(1, 4), (8, 9)]
    df = spark.createDataFrame([("f", 1, 3), ("f", 4, 5), ("f", 8, 9), ("g", 2, 2)], "file string, first int, last int")
    assert sorted(map(tuple, C.merged_intervals(df, "file").collect())) == [("f", 1, 5), ("f", 8, 9), ("g", 2, 2)]


def test_coverage_of_citations(spark):
    for t, s in {"sales": "id int, buyer int, price int, state string, day date", "people": "id int, name string"}.items():
        spark.createDataFrame([], s).createOrReplaceTempView(t)
    sql = "select s.id,\n p.name\nfrom sales s\njoin people p on s.buyer = p.id"
    found = [L.lineage_of_sql(spark, sql, "m")]
    cited = C.cited_edges(spark, found, {"m": sql})
    assert {r["level"]: r["n"] for r in C.citation_coverage(cited).collect()} == {"line": cited.count()}


@pytest.fixture(scope="module")
def graph(spark):
    direct = spark.createDataFrame([("raw.a", "stg.a", "IDENTITY"), ("stg.a", "fct.b", "AGGREGATION"), ("raw.c", "fct.d", "RENAME")], "`from` string, `to` string, kind string")
    return direct, spark.createDataFrame([("stg.a", "fct.d", "FILTER")], "`from` string, `to` string, type string")


def test_answers(spark, graph):
    direct, indirect = graph
    ask = lambda q: A.answer(q, direct, indirect)
    assert ask("Where does fct.b come from?")["found"] == [(1, "stg.a"), (2, "raw.a")]
    assert ask("How is fct.b computed?")["found"] == [("stg.a", "AGGREGATION")]
    assert ask("What is the impact of raw.a?")["found"] == [(1, "stg.a"), (2, "fct.b"), (2, "fct.d")]
    yes = ask("Does raw.a affect fct.d?")
    assert yes["verdict"] == "yes" and yes["found"] == ["raw.a", "stg.a", "fct.d"] and not yes["by_value"]
    no = ask("Does fct.d affect raw.a?")
    assert no["verdict"] == "no" and no["reverse"]
    assert ask("Where does no.such come from?")["verdict"] == "refused"
    nodes = [("fct_x", "model", None), ("x", "seed", ""), ("y", "model", "models/staging/a/y.sql"), ("z", "model", "staging/models/marts\\deep/z.sql"), ("w", "model", "models/w.sql"), ("int_v", "model", "models/other/int_v.sql")]
    got = {r["name"]: r["layer"] for r in A.with_layers(spark.createDataFrame(nodes, "name string, kind string, file string")).collect()}
    assert got == {"fct_x": "marts", "x": "raw", "y": "staging", "z": "marts", "w": None, "int_v": "intermediate"}
    assert '"raw.a" -> "stg.a"' in A.dot(A.G.hops(direct))


def test_command_line(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "_session", lambda: spark)
    models = tmp_path / "models"
    models.mkdir()
    (models / "stg_n.sql").write_text("select n_nationkey as id, upper(n_name) as name from nation")
    (models / "fct_n.sql").write_text("select name, count(*) as n from stg_n group by name")
    place = str(tmp_path / "graph")
    assert cli.main(["ingest", SF, str(models), "--out", place]).startswith("2 models, 3 edges, 1 indirect")
    assert "nation.n_name  [TRANSFORMATION]" in cli.main(["trace", place, "fct_n.name"])
    assert "1 affected" not in cli.main(["impact", place, "nation.n_name", "--indirect"])
    assert "fct_n.n" in cli.main(["impact", place, "nation.n_name", "--indirect"])
    assert cli.main(["trace", place, "nope"]) == "nope: no such column"
    assert "3 edges" in cli.main(["report", place])
    assert "'verdict': 'found'" in cli.main(["ask", place, "where does fct_n.name come from"])
    assert len(cli.main(["search", f"{SF}/benchmark.parquet", "the of and", "-k", "3"]).splitlines()) <= 3
