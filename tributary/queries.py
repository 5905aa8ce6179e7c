"""All registered queries of the engine, each with SQL that DuckDB runs on the same tables where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.functions import macros as M
from tributary.functions import text as X
from tributary.operators import linking, metrics, perturb, retrieval, validation
from tributary.plans import answers, citations, gold, graph, lineage, models
from tributary.streaming import events as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a function under its name, with its SQL twin."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain(df: DataFrame) -> DataFrame:
    """Dates and timestamps as text, whole numbers as 64-bit and decimals as doubles, which compare alike in every engine."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        elif isinstance(f.dataType, T.IntegralType):
            c = c.cast("long")
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        out.append(c.alias(f.name))
    return df.select(out)


# Models

_DATES = {"stg_orders": ["order_date"], "stg_items": ["ship_date"], "int_order_totals": ["order_date"], "int_customer_history": ["order_date", "previous_order_date"], "int_latest_order": ["order_date"], "fct_monthly": ["month"], "fct_items_slim": ["ship_date"], "stg_events": ["ts"]}


_MONEY = {"int_items_enriched": ["net_price"], "int_order_totals": ["items_total"], "int_customer_history": ["items_total"], "fct_orders": ["items_total"], "dim_customers": ["lifetime_value"], "dim_segments": ["lifetime_value"], "fct_monthly": ["revenue", "change", "running"], "fct_part_performance": ["revenue"], "fct_top_parts": ["revenue"]}


def _model(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = plain(models.model(spark, sf_dir, name))
        return df.drop("ts")

    texts = [f"CAST({c} AS VARCHAR) AS {c}" for c in _DATES.get(name, []) if c != "ts"] + [f"CAST({c} AS DOUBLE) AS {c}" for c in _MONEY.get(name, [])]
    select = "*" + (" EXCLUDE (ts)" if name == "stg_events" else "") + (f" REPLACE ({', '.join(texts)})" if texts else "")
    QUERIES[f"model_{name}"] = run
    ORACLES[f"model_{name}"] = models.oracle(name, select)


for _name in models.MODELS:
    _model(_name)

# Lineage and graph


_found: dict[tuple[str, str], list[lineage.ModelLineage]] = {}


def corpus_models(spark: SparkSession, sf_dir: str) -> list[lineage.ModelLineage]:
    """Lineage of every model, walked once per session and folder: it depends on the models and the tables' columns alone."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _found:
        for t in models.SOURCES:
            read(spark, sf_dir, t).createOrReplaceTempView(t)
        _found[key] = lineage.project_lineage(spark, models.MODELS)
    return _found[key]


def corpus_lineage(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Direct edges, indirect edges and the report of the model corpus, from Catalyst's plans."""
    found = corpus_models(spark, sf_dir)
    return lineage.edges_frame(spark, found), lineage.indirect_frame(spark, found), lineage.report_frame(spark, found)


def _direct(spark, sf_dir):
    return graph.hops(corpus_lineage(spark, sf_dir)[0])


def _all(spark, sf_dir):
    direct, indirect, _ = corpus_lineage(spark, sf_dir)
    return graph.hops(direct, indirect)


_D, _I = gold.edges_cte(), gold.indirect_cte()
_EVERY = f"{_D}, {_I}, every AS (SELECT src, dst FROM direct UNION SELECT src, dst FROM indirect)"


def _closure(edges: str, start: str, up: bool = False) -> str:
    a, b = ("dst", "src") if up else ("src", "dst")
    with_ = _EVERY if edges == "every" else _D
    return f"WITH RECURSIVE {with_}, walk AS (SELECT '{start}' AS node, 0 AS depth UNION SELECT e.{b}, w.depth + 1 FROM walk w JOIN {edges} e ON e.{a} = w.node WHERE w.depth < 50) SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY node HAVING min(depth) > 0"


@query(f'WITH {_D} SELECT src AS "from", dst AS "to", kind, model FROM direct')
def lineage_direct(spark, sf_dir):
    """Direct edges of the corpus, strongest kind per pair."""
    return corpus_lineage(spark, sf_dir)[0].drop("confidence")


@query(f'WITH {_D}, {_I} SELECT src AS "from", dst AS "to", type, model FROM indirect')
def lineage_indirect(spark, sf_dir):
    """Indirect edges of the corpus."""
    return corpus_lineage(spark, sf_dir)[1].drop("confidence")


@query(f"WITH {_D}, {_I} SELECT (SELECT count(*) FROM direct) AS n_direct, (SELECT count(*) FROM indirect) AS n_indirect, (SELECT count(DISTINCT model) FROM direct) AS n_models, (SELECT count(*) FROM cols) AS n_columns")
def lineage_stats(spark, sf_dir):
    """Totals of the graph."""
    direct, indirect, report = corpus_lineage(spark, sf_dir)
    cols = direct.select("to").union(report.select("model", F.explode("constants").alias("c")).select(F.concat_ws(".", "model", "c")))
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return one(direct, "n_direct").crossJoin(one(indirect, "n_indirect")).crossJoin(report.agg(F.count_distinct("model").alias("n_models"))).crossJoin(one(cols.distinct(), "n_columns"))


_FIXED = gold._values([(m, c) for m, cs in gold.CONSTANTS.items() for c in cs], "model, col")


@query(f"WITH {_D}, {_I}, known AS (SELECT c.model, c.col, EXISTS (SELECT 1 FROM direct d WHERE d.dst = c.model || '.' || c.col) AS has, EXISTS (SELECT 1 FROM {_FIXED} WHERE v.model = c.model AND v.col = c.col) AS fixed FROM cols c), per AS (SELECT model, CASE WHEN bool_and(has OR fixed) THEN 'FULL' WHEN bool_or(has) THEN 'PARTIAL' ELSE 'TABLE_ONLY' END AS level FROM known GROUP BY model) SELECT level, count(*) AS models FROM per GROUP BY level")
def lineage_coverage(spark, sf_dir):
    """Models by coverage level."""
    direct, _, report = corpus_lineage(spark, sf_dir)
    return graph.coverage(report, direct)


@query(f'WITH {_D}, {_I} SELECT src AS "from", dst AS "to", type, model FROM indirect')
def gold_expand_indirect(spark, sf_dir):
    """Compact gold rows opened to pairs."""
    return gold.expand_indirect(spark)


@query(f"WITH {_D} SELECT kind, count(*) AS n_gold, count(*) AS n_found, count(*) AS n_both FROM direct GROUP BY kind")
def lineage_vs_gold(spark, sf_dir):
    """The engine's direct edges against the gold, by kind."""
    a = corpus_lineage(spark, sf_dir)[0].select("from", "to", "kind").withColumn("f", F.lit(1))
    b = gold.gold_edges(spark).select("from", "to", "kind").withColumn("g", F.lit(1))
    both = a.join(b, ["from", "to", "kind"], "full")
    return both.groupBy("kind").agg(F.count("g").alias("n_gold"), F.count("f").alias("n_found"), F.count_if(F.col("f").isNotNull() & F.col("g").isNotNull()).alias("n_both"))


@query(_closure("direct", "lineitem.l_extendedprice"))
def graph_impact_direct(spark, sf_dir):
    """L4: what a column affects through values, with the fewest hops."""
    return graph.downstream(_direct(spark, sf_dir), "lineitem.l_extendedprice", 50).select("node", F.col("depth").cast("long").alias("depth"))


@query(_closure("every", "part.p_partkey"))
def graph_impact_all(spark, sf_dir):
    """L4: what a column affects through values or rows."""
    return graph.downstream(_all(spark, sf_dir), "part.p_partkey", 50).select("node", F.col("depth").cast("long").alias("depth"))


@query(_closure("direct", "dim_segments.segment", up=True))
def graph_upstream_closure(spark, sf_dir):
    """Where a column comes from."""
    found = graph.reach(graph.reversed_edges(_direct(spark, sf_dir)), spark.createDataFrame([("dim_segments.segment",)], "n string"))
    return found.select("node", F.col("depth").cast("long").alias("depth"))


@query(f"WITH RECURSIVE {_D}, walk AS (SELECT 'fct_top_parts.revenue' AS node, ['fct_top_parts.revenue'] AS path UNION ALL SELECT d.src, list_append(w.path, d.src) FROM walk w JOIN direct d ON d.dst = w.node) SELECT array_to_string(path, ' < ') AS path FROM walk w WHERE NOT EXISTS (SELECT 1 FROM direct d WHERE d.dst = w.node)")
def graph_upstream_paths(spark, sf_dir):
    """L3: all paths up from a column."""
    return graph.upstream_paths(_direct(spark, sf_dir), "fct_top_parts.revenue", 20).rows.select(F.concat_ws(" < ", "path").alias("path"))


@query(f"WITH RECURSIVE {_D}, walk AS (SELECT src AS node, 0 AS depth FROM direct WHERE src NOT IN (SELECT dst FROM direct) UNION SELECT d.dst, w.depth + 1 FROM walk w JOIN direct d ON d.src = w.node) SELECT node, CAST(max(depth) AS BIGINT) AS depth FROM walk GROUP BY node")
def graph_depths(spark, sf_dir):
    """The longest path from a raw column to each."""
    return graph.depths(_direct(spark, sf_dir)).select("node", F.col("depth").cast("long").alias("depth"))


@query(f"WITH {_D}, {_I}, n AS (SELECT src AS node, 0 AS i, 1 AS o FROM direct UNION ALL SELECT dst, 1, 0 FROM direct) SELECT node, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(o) AS BIGINT) AS n_out FROM n GROUP BY node")
def graph_degrees(spark, sf_dir):
    """Edges into and out of each column."""
    return graph.degrees(_direct(spark, sf_dir))


@query(f"WITH {_D} SELECT DISTINCT src AS node FROM direct WHERE src NOT IN (SELECT dst FROM direct)")
def graph_starts(spark, sf_dir):
    """Columns without an input."""
    return graph.starts(_direct(spark, sf_dir))


@query(f"WITH {_D} SELECT DISTINCT dst AS node FROM direct WHERE dst NOT IN (SELECT src FROM direct)")
def graph_ends(spark, sf_dir):
    """Columns that nothing reads."""
    return graph.ends(_direct(spark, sf_dir))


@query(f"WITH RECURSIVE {_D}, pairs AS (SELECT src AS a, dst AS b FROM direct UNION SELECT dst, src FROM direct), walk AS (SELECT a AS node, a AS other FROM pairs UNION SELECT w.node, e.b FROM walk w JOIN pairs e ON e.a = w.other) SELECT node, min(other) AS component FROM walk GROUP BY node")
def graph_components(spark, sf_dir):
    """Q10: columns that hang together."""
    return graph.components(_direct(spark, sf_dir))


@query(f"WITH RECURSIVE {_D}, down AS (SELECT 'int_order_totals.items_total' AS node, 0 AS d UNION SELECT e.dst, w.d + 1 FROM down w JOIN direct e ON e.src = w.node WHERE w.d < 2), up AS (SELECT 'int_order_totals.items_total' AS node, 0 AS d UNION SELECT e.src, w.d + 1 FROM up w JOIN direct e ON e.dst = w.node WHERE w.d < 2), n AS (SELECT * FROM down UNION SELECT * FROM up) SELECT node, CAST(min(d) AS BIGINT) AS hops FROM n GROUP BY node HAVING min(d) > 0")
def graph_neighbourhood(spark, sf_dir):
    """Columns within two hops."""
    return graph.neighbourhood(_direct(spark, sf_dir), "int_order_totals.items_total", 2).select("node", F.col("hops").cast("long").alias("hops"))


_PAIRS = [("lineitem.l_quantity", "fct_part_performance.unit_revenue"), ("lineitem.l_quantity", "dim_segments.segment"), ("dim_segments.segment", "customer.c_custkey"), ("orders.o_totalprice", "int_adjustments.amount")]


@query(f"WITH RECURSIVE {_D}, asked AS (SELECT * FROM {gold._values(_PAIRS, 'a, b')}), walk AS (SELECT a AS root, a AS node FROM asked UNION SELECT w.root, d.dst FROM walk w JOIN direct d ON d.src = w.node) SELECT a, b, EXISTS (SELECT 1 FROM walk w WHERE w.root = a AND w.node = b) AS reachable FROM asked")
def graph_reachability(spark, sf_dir):
    """Whether one column's value reaches another."""
    e = _direct(spark, sf_dir)
    return spark.createDataFrame([(a, b, graph.reaches(e, a, b)) for a, b in _PAIRS], "a string, b string, reachable boolean")


@query(f"WITH {_D}, n AS (SELECT src AS node FROM direct UNION SELECT dst FROM direct), every AS (SELECT 'one.' || node AS node, node AS short FROM n UNION ALL SELECT 'two.' || node, node FROM n WHERE node LIKE 'fct_%') SELECT node, CASE WHEN count(*) OVER (PARTITION BY short) = 1 THEN short ELSE node END AS display FROM every")
def graph_display_names(spark, sf_dir):
    """The shortest name that tells a column apart, over two projects that share some."""
    e = _direct(spark, sf_dir)
    n = e.select(F.col("from").alias("node")).union(e.select("to")).distinct()
    return graph.display_names(n.select(F.concat(F.lit("one."), "node").alias("node")).union(n.filter("node like 'fct_%'").select(F.concat(F.lit("two."), "node"))))


@query(f"WITH {_D}, {_I} SELECT 'line' AS level, count(*) AS n FROM (SELECT src, dst, kind FROM direct WHERE model <> 'fct_items_slim' UNION ALL SELECT src, dst, type FROM indirect) UNION ALL SELECT 'star', count(*) FROM direct WHERE model = 'fct_items_slim'".replace("WHERE model <> 'fct_items_slim'", "WHERE model NOT IN ('fct_items_slim', 'int_customer_history') OR dst = 'int_customer_history.previous_order_date'").replace("WHERE model = 'fct_items_slim'", "WHERE model = 'fct_items_slim' OR model = 'int_customer_history' AND dst <> 'int_customer_history.previous_order_date'"))
def lineage_citations(spark, sf_dir):
    """How precisely each edge is placed in its model's text."""
    found = corpus_models(spark, sf_dir)
    return citations.cited_edges(spark, found, models.MODELS).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH RECURSIVE {_EVERY},
up AS (SELECT 'dim_segments.segment' AS node UNION SELECT d.src FROM up u JOIN direct d ON d.dst = u.node),
down AS (SELECT 'stg_orders.priority' AS node UNION SELECT e.dst FROM down w JOIN every e ON e.src = w.node),
far AS (SELECT 'part.p_brand' AS node, 0 AS d UNION SELECT e.dst, f.d + 1 FROM far f JOIN every e ON e.src = f.node WHERE f.d < 30)
SELECT 'Where does dim_segments.segment come from?' AS question, 'trace' AS intent, (SELECT count(*) - 1 FROM up) AS n_found
UNION ALL SELECT 'How is fct_monthly.revenue computed?', 'computed', (SELECT count(*) FROM direct WHERE dst = 'fct_monthly.revenue')
UNION ALL SELECT 'What does stg_orders.priority affect?', 'impact', (SELECT count(*) - 1 FROM down)
UNION ALL SELECT 'Does part.p_brand affect stg_orders.status?', 'reach', coalesce((SELECT min(d) + 1 FROM far WHERE node = 'stg_orders.status'), 0)
UNION ALL SELECT 'Where does no.such come from?', 'trace', (SELECT count(*) FROM every WHERE src = 'no.such' OR dst = 'no.such')""")
def answer_questions(spark, sf_dir):
    """Answers from the graph alone."""
    direct, indirect, _ = corpus_lineage(spark, sf_dir)
    direct, indirect = direct.drop("confidence").cache(), indirect.drop("confidence").cache()
    asked = ("Where does dim_segments.segment come from?", "How is fct_monthly.revenue computed?", "What does stg_orders.priority affect?", "Does part.p_brand affect stg_orders.status?", "Where does no.such come from?")
    rows = [(q, a["intent"], len(a["found"])) for q in asked for a in [answers.answer(q, direct, indirect)]]
    return spark.createDataFrame(rows, "question string, intent string, n_found long")


# Joins, sets, windows


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def join_semi(spark, sf_dir):
    """C13, B12."""
    o = read(spark, sf_dir, "orders")
    return read(spark, sf_dir, "customer").join(o, F.col("c_custkey") == o["o_custkey"], "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def join_anti(spark, sf_dir):
    """Rows without a partner (null-aware in SQL's NOT IN)."""
    for t in ("customer", "orders"):
        read(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 300000)")


@query("WITH a AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS clicks FROM events WHERE event_type = 'click' AND value > 90 GROUP BY 1), b AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS buys FROM events WHERE event_type = 'purchase' AND value < 10 GROUP BY 1) SELECT coalesce(a.day, b.day) AS day, clicks, buys FROM a FULL JOIN b ON a.day = b.day")
def join_full_outer(spark, sf_dir):
    """C9."""
    e = read(spark, sf_dir, "events").withColumn("day", F.to_date("ts").cast("string"))
    a = e.filter("event_type = 'click' and value > 90").groupBy("day").agg(F.count(F.lit(1)).alias("clicks"))
    b = e.filter("event_type = 'purchase' and value < 10").groupBy("day").agg(F.count(F.lit(1)).alias("buys"))
    return a.join(b, "day", "full")


@query("SELECT n1.n_name AS a, n2.n_name AS b FROM nation n1 JOIN nation n2 ON n1.n_regionkey = n2.n_regionkey AND n1.n_nationkey < n2.n_nationkey")
def join_self(spark, sf_dir):
    """A table with itself, on a key and an inequality."""
    n = read(spark, sf_dir, "nation")
    a, b = n.alias("a"), n.alias("b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"))


@query("WITH p AS (SELECT p_partkey, CASE WHEN p_size > 25 THEN p_brand END AS k FROM part), g AS (SELECT k, count(*) AS n FROM p GROUP BY k) SELECT p.p_partkey, g.n FROM p JOIN g ON p.k IS NOT DISTINCT FROM g.k")
def join_null_safe(spark, sf_dir):
    """C11."""
    p = read(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") > 25, F.col("p_brand")).alias("k"))
    g = p.groupBy(F.col("k").alias("gk")).agg(F.count(F.lit(1)).alias("n"))
    return p.join(g, F.col("k").eqNullSafe(F.col("gk"))).select("p_partkey", "n")


@query("WITH s AS (SELECT c_custkey, min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS b FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1) SELECT CAST(d AS VARCHAR) AS month, count(*) AS active FROM s, LATERAL (SELECT unnest(generate_series(date_trunc('month', a), date_trunc('month', b), INTERVAL 1 MONTH))::DATE AS d) GROUP BY d")
def join_range_spine(spark, sf_dir):
    """Intervals opened to the months they span, instead of a range join."""
    o = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(F.to_date("o_orderdate")).alias("a"), F.max(F.to_date("o_orderdate")).alias("b"))
    months = o.select(F.explode(F.sequence(F.trunc("a", "MM"), F.trunc("b", "MM"), F.expr("interval 1 month"))).alias("month"))
    return months.groupBy("month").agg(F.count(F.lit(1)).alias("active")).select(F.col("month").cast("string").alias("month"), "active")


@query("SELECT p_brand AS name FROM part WHERE p_size < 5 UNION SELECT p_brand FROM part WHERE p_size > 45")
def set_union_distinct(spark, sf_dir):
    """G2."""
    p = read(spark, sf_dir, "part")
    return p.filter("p_size < 5").select(F.col("p_brand").alias("name")).union(p.filter("p_size > 45").select("p_brand")).distinct()


@query("(SELECT 'a' AS side, o_orderkey AS id FROM orders WHERE o_totalprice > 100000 EXCEPT SELECT 'a', o_orderkey FROM orders WHERE o_orderstatus = 'F') UNION ALL (SELECT 'b', o_orderkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT 'b', o_orderkey FROM orders WHERE o_totalprice > 100000)")
def set_two_way_except(spark, sf_dir):
    """What either of two queries has alone."""
    o = read(spark, sf_dir, "orders")
    a, b = o.filter("o_totalprice > 100000").select("o_orderkey"), o.filter("o_orderstatus = 'F'").select("o_orderkey")
    side = lambda df, s: df.select(F.lit(s).alias("side"), F.col("o_orderkey").alias("id"))
    return side(a.subtract(b), "a").unionByName(side(b.subtract(a), "b"))


@query("SELECT user_id, event_id, lead(event_id) OVER w AS next_event, first_value(event_id) OVER w AS first_event FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def window_scd(spark, sf_dir):
    """What follows each row, and what its group began with."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select("user_id", "event_id", F.lead("event_id").over(w).alias("next_event"), F.first("event_id").over(w).alias("first_event"))


@query("WITH e AS (SELECT user_id, event_id, ts, CASE WHEN event_type = 'purchase' THEN event_id END AS mark FROM events) SELECT user_id, event_id, last_value(mark IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM e")
def window_forward_fill(spark, sf_dir):
    """The last known value."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return read(spark, sf_dir, "events").select("user_id", "event_id", F.last(mark, ignorenulls=True).over(w).alias("last_purchase"))


@query("SELECT o_orderkey FROM (SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC) AS r FROM orders) WHERE r = 1")
def window_rank_ties(spark, sf_dir):
    """All rows of a group's last day."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc(F.to_date("o_orderdate")))
    return read(spark, sf_dir, "orders").withColumn("r", F.rank().over(w)).filter("r = 1").select("o_orderkey")


@query("SELECT l_returnflag AS flag, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(avg(l_discount), 6) AS mean FROM lineitem GROUP BY 1")
def agg_median(spark, sf_dir):
    """D16, D2."""
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.round(F.percentile("l_extendedprice", 0.5), 4).alias("median"), F.round(F.avg("l_discount"), 6).alias("mean"))


@query("SELECT user_id, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'purchase') AS purchases, bool_or(value > 95) AS any_high, count(DISTINCT CASE WHEN value > 50 THEN event_type END) AS high_types FROM events GROUP BY user_id")
def agg_filtered(spark, sf_dir):
    """D4-D6, D17."""
    return read(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("event_type") == "purchase").alias("purchases"),
        F.bool_or(F.col("value") > 95).alias("any_high"), F.count_distinct(F.when(F.col("value") > 50, F.col("event_type"))).alias("high_types"),
    )


# Functions and macros


@query("SELECT o_orderkey, md5(coalesce(CAST(o_custkey AS VARCHAR), '_dbt_utils_surrogate_key_null_') || '-' || coalesce(CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END, '_dbt_utils_surrogate_key_null_')) AS key FROM orders")
def fn_surrogate_key(spark, sf_dir):
    """H17."""
    return read(spark, sf_dir, "orders").select("o_orderkey", M.surrogate_key(F.col("o_custkey"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus"))).alias("key"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS n FROM events")
def fn_json(spark, sf_dir):
    """H23, H24."""
    e = read(spark, sf_dir, "events")
    return e.select("event_id", M.json_value(F.col("props"), "k").alias("k"), M.json_value(F.col("props"), "k").try_cast("long").alias("n"))


@query("SELECT page_id, split_part(split_part(replace(replace(url, 'http://', ''), 'https://', ''), '/', 1), '?', 1) AS host, nullif(CASE WHEN contains(url, 'page=') THEN split_part(list_last(string_split(url, 'page=')), '&', 1) END, '') AS page FROM pages")
def fn_url(spark, sf_dir):
    """H22."""
    return read(spark, sf_dir, "pages").select("page_id", M.url_host(F.col("url")).alias("host"), M.url_parameter(F.col("url"), "page").alias("page"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal >= 9000 THEN 10 ELSE CAST(floor(c_acctbal / 1000) + 1 AS BIGINT) END AS bucket, c_acctbal / nullif(c_nationkey, 0) AS share FROM customer")
def fn_numeric(spark, sf_dir):
    """H20, H21."""
    return read(spark, sf_dir, "customer").select("c_custkey", M.width_bucket(F.col("c_acctbal"), 0, 9000, 9).cast("long").alias("bucket"), M.safe_divide(F.col("c_acctbal"), F.col("c_nationkey")).alias("share"))


@query("SELECT s_suppkey, round(2 * 3961 * asin(sqrt(pow(sin(radians(s_nationkey * 2.0 - s_nationkey) / 2), 2) + cos(radians(CAST(s_nationkey AS DOUBLE))) * cos(radians(s_nationkey * 2.0)) * pow(sin(radians(10.0 - s_suppkey % 90) / 2), 2))), 4) AS miles FROM supplier")
def fn_haversine(spark, sf_dir):
    """H19."""
    s = read(spark, sf_dir, "supplier")
    n = F.col("s_nationkey").cast("double")
    return s.select("s_suppkey", F.round(M.haversine(n, (F.col("s_suppkey") % 90).cast("double"), n * 2, F.lit(10.0)), 4).alias("miles"))


@query("SELECT p_partkey, CASE WHEN length(t) > 3 AND t LIKE '%s' AND t NOT LIKE '%ss' THEN left(t, length(t) - 1) ELSE t END AS word FROM (SELECT p_partkey, unnest(list_filter(string_split_regex(lower(p_type), '[^a-z0-9]+'), lambda x: x <> '')) AS t FROM part)")
def fn_name_tokens(spark, sf_dir):
    """Tokens of a name without plural endings."""
    return read(spark, sf_dir, "part").select("p_partkey", F.explode(F.transform(X.name_tokens(F.lower("p_type")), X.singular)).alias("word"))


@query("SELECT doc_id, 'c_' || left(sha1(lang || '|' || source), 8) AS cid, CAST(ceil(length(text) / 3.0) AS BIGINT) AS tokens FROM documents")
def fn_content_id(spark, sf_dir):
    """H33, H34."""
    return read(spark, sf_dir, "documents").select("doc_id", X.content_id("c_", F.col("lang"), F.col("source")).alias("cid"), X.token_estimate(F.col("text")).cast("long").alias("tokens"))


@query("SELECT * EXCLUDE (n) FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def macro_deduplicate(spark, sf_dir):
    """W1."""
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return M.deduplicate(o, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")]).drop("o_totalprice")


@query("SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS n_F, count(*) FILTER (o_orderstatus = 'O') AS n_O, count(*) FILTER (o_orderstatus = 'P') AS n_P FROM orders GROUP BY 1")
def macro_pivot(spark, sf_dir):
    """W2, D7."""
    return M.pivot(read(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus", ["F", "O", "P"], "n_")


@query("SELECT p_partkey, 'p_brand' AS field_name, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'p_type', p_type FROM part UNION ALL SELECT p_partkey, 'p_size', CAST(p_size AS VARCHAR) FROM part")
def macro_unpivot(spark, sf_dir):
    """W3."""
    return M.unpivot(read(spark, sf_dir, "part"), ["p_partkey"], ["p_brand", "p_type", "p_size"])


@query("SELECT c_custkey AS key, c_mktsegment AS segment, CAST(NULL AS BIGINT) AS nation, 'customer' AS source_relation FROM customer UNION ALL SELECT s_suppkey, NULL, s_nationkey, 'supplier' FROM supplier")
def macro_union_relations(spark, sf_dir):
    """W4."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"))
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").cast("long").alias("nation"))
    return M.union_relations({"customer": c, "supplier": s})


@query("SELECT p_type AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 5")
def macro_column_values(spark, sf_dir):
    """The most frequent values."""
    return M.column_values(read(spark, sf_dir, "part"), "p_type", 5)


@query("SELECT CAST(CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-03-09', INTERVAL 1 DAY)) AS DATE) AS VARCHAR) AS date")
def macro_date_spine(spark, sf_dir):
    """H18."""
    return M.date_spine(spark, "2024-01-01", "2024-03-10").select(F.col("date").cast("string").alias("date"))


@query("SELECT 'accepted_range' AS test, count(*) FILTER (l_discount > 0.07) AS failures FROM lineitem UNION ALL SELECT 'accepted_values', count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) FROM orders UNION ALL SELECT 'relationships', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'unique', count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'not_null', count(*) FILTER (text IS NULL) FROM documents")
def macro_tests(spark, sf_dir):
    """Generic data tests and how many rows fail."""
    li, o = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    tests = {
        "accepted_range": M.accepted_range(li, "l_discount", high=0.07), "relationships": M.relationships(li, "l_orderkey", o, "o_orderkey"),
        "unique": M.unique(li, "l_orderkey", "l_linenumber"), "not_null": M.not_null(read(spark, sf_dir, "documents"), "text"),
    }
    out = M.accepted_values(o, "o_orderstatus", ["F", "O"]).agg(F.lit("accepted_values").alias("test"), F.coalesce(F.sum("n_records"), F.lit(0)).alias("failures"))
    for name, rows in tests.items():
        out = out.unionByName(rows.agg(F.lit(name).alias("test"), F.count(F.lit(1)).alias("failures")))
    return out


@query("SELECT * FROM (SELECT o_custkey, o_orderkey, o_orderdate::DATE AS d, lead(o_orderdate::DATE) OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE, o_orderkey) AS n FROM orders) WHERE d = n".replace("SELECT *", "SELECT o_custkey, o_orderkey", 1))
def macro_overlaps(spark, sf_dir):
    """Rows whose range is not over when the next begins."""
    w = Window.partitionBy("o_custkey").orderBy("d", "o_orderkey")
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("d"))
    return o.withColumn("n", F.lead("d").over(w)).filter("d = n").select("o_custkey", "o_orderkey")


# Retrieval


def _docs(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def _asked(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


_STOP = ", ".join(f"'{w}'" for w in X.STOP)
_TOKENS = f"""
idents AS (SELECT id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+(?:\\.[a-z0-9_]+)*')) AS w FROM given),
parts AS (SELECT id, w, regexp_extract_all(w, '[a-z0-9]+') AS p FROM idents),
toks AS (
  SELECT id, unnest(list_filter(p, lambda x: x NOT IN ({_STOP}))) AS token FROM parts
  UNION ALL SELECT id, unnest(list_filter(string_split(w, '.'), lambda x: contains(x, '_'))) FROM parts WHERE len(p) > 1
  UNION ALL SELECT id, w FROM parts WHERE len(p) > 1 AND contains(w, '.')
)"""


@query(f"WITH given AS (SELECT doc_id AS id, text FROM documents), {_TOKENS} SELECT id, count(*) AS n, count(DISTINCT token) AS n_distinct FROM toks GROUP BY id")
def search_tokens(spark, sf_dir):
    """The search tokens of each document."""
    return _docs(spark, sf_dir).select("id", F.explode(X.search_tokens(F.col("text"))).alias("token")).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("token").alias("n_distinct"))


_BM25 = f"""
WITH given AS (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'q' || item_id, text FROM benchmark), {_TOKENS},
filled AS (SELECT * FROM toks UNION ALL SELECT id, chr(1) FROM given WHERE id NOT IN (SELECT id FROM toks)),
tf AS (SELECT id, token, count(*) AS tf FROM filled WHERE id LIKE 'd%' GROUP BY ALL),
dl AS (SELECT id, sum(tf) AS dl FROM tf GROUP BY id), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), ask AS (SELECT id, token, count(*) AS times FROM toks WHERE id LIKE 'q%' GROUP BY ALL),
scores AS (
  SELECT CAST(ask.id[2:] AS BIGINT) AS qid, CAST(tf.id[2:] AS BIGINT) AS id,
         sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM ask JOIN tf USING (token) JOIN df USING (token) JOIN dl ON dl.id = tf.id, tot GROUP BY 1, 2
)"""


@query(_BM25 + " SELECT qid, id, round(score, 6) AS score FROM scores QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) <= 10")
def search_bm25(spark, sf_dir):
    """The ten best documents for each query."""
    return retrieval.top(retrieval.bm25(_docs(spark, sf_dir), _asked(spark, sf_dir)), 10).select("qid", "id", F.round("score", 6).alias("score"))


_DENSE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
s AS (SELECT q.vec_id AS qid, v.vec_id AS id, list_inner_product(q.e, v.e) / sqrt(list_inner_product(q.e, q.e) * list_inner_product(v.e, v.e)) AS score FROM v q, v WHERE q.vec_id % 100 = 0)"""


@query(_DENSE + " SELECT qid, id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) <= 10")
def search_dense(spark, sf_dir):
    """Exact nearest vectors of every vector whose id is divisible by 100."""
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = v.filter("id % 100 = 0").select(F.col("id").alias("qid"), "vector")
    return retrieval.dense_top(v, asked, 10).select("qid", "id", F.round("score", 6).alias("score"))


_HASHED = """
w AS (SELECT id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM given),
h AS (SELECT id, CAST('0x' || left(sha1(w), 8) AS BIGINT) AS h FROM w),
cells AS (SELECT id, h % 64 AS cell, sum(CASE WHEN (h >> 8) % 2 = 1 THEN 1.0 ELSE -1.0 END) AS v FROM h GROUP BY ALL),
norms AS (SELECT id, sqrt(sum(v * v)) AS norm FROM cells GROUP BY id)"""


@query("WITH given AS (SELECT item_id AS id, text FROM benchmark), " + _HASHED + " SELECT id, cell, round(v / norm, 6) AS value FROM cells JOIN norms USING (id) WHERE v <> 0")
def search_hashed_vectors(spark, sf_dir):
    """The hashed bag of words of each text, as its non-zero cells."""
    given = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return retrieval.hashed_vectors(given).select("id", F.posexplode("vector").alias("cell", "value")).filter("value <> 0").select("id", F.col("cell").cast("long").alias("cell"), F.round("value", 6).alias("value"))


_HYBRID = (
    _BM25
    + """, w AS (SELECT id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM given),
h AS (SELECT id, CAST('0x' || left(sha1(w), 8) AS BIGINT) AS h FROM w),
cells AS (SELECT id, h % 64 AS cell, sum(CASE WHEN (h >> 8) % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0 END) AS v FROM h GROUP BY ALL),
unit AS (SELECT id, cell, v / nullif(sqrt(sum(v * v) OVER (PARTITION BY id)), 0) AS v FROM cells),
pairs AS (SELECT q.id AS qid, d.id AS id FROM (SELECT DISTINCT id FROM cells WHERE id LIKE 'q%') q, (SELECT DISTINCT id FROM cells WHERE id LIKE 'd%') d),
dots AS (SELECT q.id AS qid, d.id, sum(q.v * d.v) AS score FROM unit q JOIN unit d USING (cell) WHERE q.id LIKE 'q%' AND d.id LIKE 'd%' GROUP BY 1, 2),
cosines AS (SELECT CAST(p.qid[2:] AS BIGINT) AS qid, CAST(p.id[2:] AS BIGINT) AS id, coalesce(score, 0) AS score FROM pairs p LEFT JOIN dots USING (qid, id)),
sparse AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM scores QUALIFY rank <= 100),
near AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM cosines QUALIFY rank <= 100),
every AS (SELECT qid, id, 1.0::DOUBLE / (60 + rank) AS part FROM sparse UNION ALL SELECT qid, id, 1.0::DOUBLE / (60 + rank) FROM near),
fused AS (SELECT qid, id, sum(part) AS score FROM every GROUP BY ALL)"""
)


@query(_HYBRID + " SELECT qid, id, round(score, 9) AS score FROM fused")
def search_rrf(spark, sf_dir):
    """Two searches fused by reciprocal ranks."""
    sparse, near = retrieval.both_lists(_docs(spark, sf_dir), _asked(spark, sf_dir))
    return retrieval.rrf(sparse, near).select("qid", "id", F.round("score", 9).alias("score"))


@query(_HYBRID + " SELECT qid, id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM fused QUALIFY rank <= 8")
def search_hybrid(spark, sf_dir):
    """BM25 and hashed vectors fused, eight documents a query."""
    return retrieval.hybrid(_docs(spark, sf_dir), _asked(spark, sf_dir)).select("qid", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents) SELECT id, n // 40 AS part, min(n) + 1 AS first_line, max(n) + 1 AS last_line, md5(string_agg(line, chr(10) ORDER BY n)) AS chunk_md5 FROM l GROUP BY 1, 2")
def search_windows(spark, sf_dir):
    """M4: documents in windows of forty lines."""
    w = retrieval.windows(_docs(spark, sf_dir))
    return w.select("id", F.col("part").cast("long").alias("part"), F.col("first_line").cast("long").alias("first_line"), F.col("last_line").cast("long").alias("last_line"), F.md5("chunk").alias("chunk_md5"))


# Linking, validation, metrics, perturbation

_MENTIONS = ["part.p_brand", "c_acctbal", "O Order Date", "order_cust_key", "lifetime values", "order num", "nothing like it", "days since previus"]


def _catalog(spark):
    names = [(f"{m}.{c}", c) for m, c in gold.columns()] + sorted({(s, s.split(".")[1]) for s, _, _, _ in gold.direct_rows()})
    return spark.createDataFrame(sorted(set(names)), "column_id string, name string")


_WORDS = "list_filter(string_split_regex(lower(regexp_replace({}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda x: x <> '')"
_SINGULAR = "CASE WHEN length(x) > 3 AND x LIKE '%s' AND x NOT LIKE '%ss' THEN left(x, length(x) - 1) ELSE x END"
_FULL = f"list_transform(list_transform(t, lambda x: {_SINGULAR}), lambda x: coalesce(map {{{', '.join(f"'{k}': '{v}'" for k, v in X.ABBREVIATIONS.items())}}}[x], x))"
_NAMES = gold._values(sorted({(f"{m}.{c}", c) for m, c in gold.columns()} | {(a, a.split(".")[1]) for a, _, _, _ in gold.direct_rows()}), "id, name")
_LINK = f"""WITH m AS (SELECT mention, t, {_FULL} AS f FROM (SELECT mention, {_WORDS.format("mention")} AS t FROM {gold._values([(x,) for x in _MENTIONS], "mention")})),
c AS (SELECT id, name, t, {_FULL} AS f FROM (SELECT id, name, {_WORDS.format("name")} AS t FROM {_NAMES})),
hits AS (
  SELECT mention, id, 1.0::DOUBLE AS score, 'exact_id' AS tier FROM m JOIN c ON lower(mention) = id
  UNION ALL SELECT mention, id, 0.97, 'exact_name' FROM m JOIN c ON lower(mention) = name
  UNION ALL SELECT mention, id, 0.93, 'surface' FROM m JOIN c ON m.t = c.t
  UNION ALL SELECT mention, id, 0.87, 'rewritten' FROM m JOIN c ON list_sort(m.f) = list_sort(c.f))"""


@query(_LINK + " SELECT mention, id AS column_id, score, tier FROM hits QUALIFY row_number() OVER (PARTITION BY mention ORDER BY score DESC, id) = 1")
def link_columns(spark, sf_dir):
    """The best column of each mention in the tiers of equal names; fuzzy ones are left to link_fuzzy."""
    m = spark.createDataFrame([(x,) for x in _MENTIONS], "mention string")
    return linking.link(m, _catalog(spark), fuzzy=False).filter("rank = 1").select("mention", "column_id", "score", "tier")


# Likeness in SQL: the longest common block of two texts, the earliest in the first and then in the second, and the same again before and behind it.
_FUZZY = (
    _LINK.replace("WITH m AS", "WITH RECURSIVE m AS", 1)
    + """, mt AS (SELECT mention, generate_subscripts(f, 1) AS i, unnest(f) AS x FROM m), ct AS (SELECT id, generate_subscripts(f, 1) AS j, unnest(f) AS y FROM c),
whole AS (SELECT mention, id, array_to_string(m.f, ' ') AS p, array_to_string(c.f, ' ') AS q, len(m.f) + len(c.f) AS n FROM m, c),
asked AS (SELECT DISTINCT x AS p, y AS q FROM mt, ct WHERE 2.0 * least(length(x), length(y)) >= 0.8 * (length(x) + length(y)) UNION SELECT p, q FROM whole),
seg AS (
  SELECT p, q, p AS a, q AS b, 0 AS k FROM asked
  UNION ALL
  SELECT p, q, ch.a, ch.b, ch.k FROM (
    SELECT p, q, unnest([{'a': substr(a, 1, i - 1), 'b': substr(b, 1, j - 1), 'k': 0}, {'a': substr(a, i + k), 'b': substr(b, j + k), 'k': 0}, {'a': '', 'b': '', 'k': k}]) AS ch FROM (
      SELECT p, q, a, b, code // 10000 AS k, 99 - (code // 100) % 100 AS i, 99 - code % 100 AS j FROM (
        SELECT p, q, a, b, list_max(flatten(list_transform(range(1, length(a) + 1), lambda i: list_transform(range(1, length(b) + 1), lambda j: (99 - i) * 100 + 99 - j + 10000 * list_max(list_filter(range(0, least(length(a) - i, length(b) - j) + 2), lambda k: substr(a, i, k) = substr(b, j, k))))))) AS code
        FROM seg WHERE length(a) > 0 AND length(b) > 0))
    WHERE k > 0)
),
ratios AS (SELECT p, q, 2.0::DOUBLE * sum(k) / (length(p) + length(q)) AS r FROM seg GROUP BY p, q),
near AS (SELECT mention, id, i, j, r FROM mt, ct, ratios WHERE p = x AND q = y AND r >= 0.8),
best AS (SELECT *, row_number() OVER (PARTITION BY mention, id, i ORDER BY r DESC, j DESC) AS by_i, row_number() OVER (PARTITION BY mention, id, j ORDER BY r DESC, i DESC) AS by_j FROM near),
paired AS (SELECT mention, id, sum(r) AS total FROM best WHERE by_i = 1 AND by_j = 1 GROUP BY 1, 2),
fuzzy AS (SELECT mention, id, 0.8::DOUBLE * (0.7::DOUBLE * (2 * total / n) + 0.3::DOUBLE * r) AS score, 'fuzzy' AS tier FROM paired JOIN whole USING (mention, id) JOIN ratios USING (p, q) WHERE score >= 0.6),
top AS (SELECT mention, id, max({'score': score, 'tier': tier}) AS b FROM (SELECT * FROM hits UNION ALL SELECT * FROM fuzzy) GROUP BY 1, 2),
ranked AS (SELECT mention, id AS column_id, round(b.score, 4) AS score, b.tier AS tier, row_number() OVER (PARTITION BY mention ORDER BY round(b.score, 4) DESC, id) AS rank FROM top)"""
)


@query(_FUZZY + " SELECT * FROM ranked WHERE tier = 'fuzzy'")
def link_fuzzy(spark, sf_dir):
    """Mentions with slips, by likeness."""
    m = spark.createDataFrame([(x,) for x in _MENTIONS], "mention string")
    return linking.link(m, _catalog(spark)).filter("tier = 'fuzzy'").withColumn("rank", F.col("rank").cast("long"))


_CLAIMS = [
    (0, "fct_orders.items_total is passed through from the history", ["e_00000001"]),
    (1, "dim_customers.lifetime_value aggregates fct_orders.items_total", ["e_00000002"]),
    (2, "dim_customers.lifetime_value is renamed", ["e_00000002"]),
    (3, "fct_orders.ghost is invented", ["e_00000001"]),
    (4, "nothing is cited", []),
    (5, "stg_orders.status feeds it", ["e_0000000x"]),
    (6, "two far edges: dim_customers.lifetime_value and stg_parts.brand", ["e_00000002", "e_00000003"]),
    (7, "stg_parts.brand is upper-cased", ["e_deadbeef"]),
    (8, "fct_orders.items_total comes unchanged from int_customer_history.items_total", ["e_0000001"]),
    (9, "the sum of fct_orders.items_total is dim_customers.lifetime_value, from part.p_brand", ["e_00000002", "e_0000000"]),
]
_LEDGER = [
    ("e_00000001", "IDENTITY", "int_customer_history.items_total", "fct_orders.items_total"),
    ("e_00000002", "AGGREGATION", "fct_orders.items_total", "dim_customers.lifetime_value"),
    ("e_00000003", "TRANSFORMATION", "part.p_brand", "stg_parts.brand"),
]


def _claims(spark):
    nodes = [(f"{m}.{c}",) for m, c in gold.columns()]
    return spark.createDataFrame(_CLAIMS, "claim int, text string, ids array<string>"), spark.createDataFrame(_LEDGER, "id string, kind string, from_col string, to_col string"), spark.createDataFrame(nodes, "node string")


_R5 = " UNION ALL ".join(f"SELECT claim, 'R5' AS rule, '{w}' AS item FROM kinds JOIN claims USING (claim) WHERE regexp_matches(lower(text), '{p}') AND NOT list_has_any(kinds, {list(ok)})" for w, p, ok in validation.KIND_WORDS)
_VALIDATE = f"""WITH RECURSIVE claims AS (SELECT * FROM (VALUES {", ".join(f"({c}, '{t}', {ids or "[]::VARCHAR[]"})" for c, t, ids in _CLAIMS)}) AS v(claim, text, ids)),
ledger AS (SELECT * FROM {gold._values(_LEDGER, "id, kind, a, b")}), nodes AS (SELECT * FROM {gold._values([(f"{m}.{c}",) for m, c in gold.columns()], "name")}),
cited AS (SELECT claim, unnest(ids) AS id FROM claims), bad AS (SELECT DISTINCT claim, id FROM cited WHERE id NOT IN (SELECT id FROM ledger)),
near AS (SELECT claim, b.id, l.id AS cand FROM bad b JOIN ledger l ON left(l.id, 2) = left(b.id, 2) AND (levenshtein(l.id, b.id) <= 1 OR length(b.id) >= 7 AND starts_with(l.id, b.id))),
fix AS (SELECT claim, id, min(cand) AS cand FROM near GROUP BY 1, 2 HAVING count(DISTINCT cand) = 1),
ok AS (SELECT c.claim, coalesce(f.cand, c.id) AS id FROM cited c LEFT JOIN fix f USING (claim, id)), edges AS (SELECT DISTINCT claim, kind, a, b FROM ok JOIN ledger USING (id)),
said AS (SELECT DISTINCT claim, lower(n) AS name FROM (SELECT claim, unnest(regexp_extract_all(text, '[A-Za-z_]\\w*(?:\\.[A-Za-z_]\\w*)+')) AS n FROM claims)),
shown AS (SELECT a AS name FROM ledger UNION SELECT b FROM ledger), kinds AS (SELECT claim, list(kind) AS kinds FROM edges GROUP BY claim),
touched AS (SELECT DISTINCT s.claim FROM said s JOIN edges e ON e.claim = s.claim AND s.name IN (e.a, e.b)),
walk AS (SELECT claim, a AS node, a AS other FROM edges UNION SELECT claim, b, b FROM edges UNION SELECT w.claim, w.node, CASE WHEN e.a = w.other THEN e.b ELSE e.a END FROM walk w JOIN edges e ON e.claim = w.claim AND w.other IN (e.a, e.b)),
parts AS (SELECT claim, count(DISTINCT low) AS n FROM (SELECT claim, node, min(other) AS low FROM walk GROUP BY 1, 2) GROUP BY claim)
SELECT CAST(claim AS BIGINT) AS claim, rule, item FROM (
SELECT claim, 'R1' AS rule, NULL AS item FROM claims WHERE len(ids) = 0 UNION ALL SELECT claim, 'R2', id FROM ok WHERE id NOT IN (SELECT id FROM ledger)
UNION ALL SELECT claim, 'R4', 'hallucinated ' || name FROM said WHERE name NOT IN (SELECT name FROM nodes) UNION ALL SELECT claim, 'R4', 'unsupported ' || name FROM said WHERE name IN (SELECT name FROM nodes) AND name NOT IN (SELECT name FROM shown)
UNION ALL {_R5} UNION ALL SELECT DISTINCT claim, 'R7', NULL FROM said WHERE claim IN (SELECT claim FROM edges) AND claim NOT IN (SELECT claim FROM touched) UNION ALL SELECT claim, 'R8', CAST(n AS VARCHAR) FROM parts WHERE n > 1)"""


@query(_VALIDATE)
def validate_claims(spark, sf_dir):
    """Q1-Q13: the failures of a set of claims."""
    claims, ledger, nodes = _claims(spark)
    return validation.validate(claims, ledger, nodes).select(F.col("claim").cast("long").alias("claim"), "rule", "item")


@query("WITH n AS (SELECT count(*) FILTER (quality = 1) AS n_pred, count(*) FILTER (toxic = 0) AS n_gold, count(*) FILTER (quality = 1 AND toxic = 0) AS n_both FROM labels) SELECT n_pred, n_gold, n_both, n_both / n_pred AS precision, n_both / n_gold AS recall, 2 * (n_both / n_pred) * (n_both / n_gold) / (n_both / n_pred + n_both / n_gold) AS f1 FROM n")
def metric_prf(spark, sf_dir):
    """S3: two sets of documents against each other."""
    lb = read(spark, sf_dir, "labels")
    s = metrics.set_scores(lb.filter("quality = 1"), lb.filter("toxic = 0"), "doc_id")
    return s.select("n_pred", "n_gold", "n_both", "precision", "recall", "f1")


@query("WITH d AS (SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS b, count(*) FILTER (quality <> 1 AND toxic <> 0) AS c FROM labels) SELECT b, c, round(CASE WHEN b + c = 0 THEN 1 ELSE least(1.0::DOUBLE, 2 * (SELECT sum(exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2.0::DOUBLE))) FROM range(0, 1000000) r(k) WHERE k <= least(b, c))) END, 9) AS p FROM d")
def metric_mcnemar(spark, sf_dir):
    """Discordant pairs and the exact p."""
    lb = read(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("a"), (F.col("toxic") != 0).alias("t"))
    m = metrics.mcnemar(lb, "a", "t")
    return spark.createDataFrame([(m["b"], m["c"], round(m["p"], 9))], "b long, c long, p double")


@query("SELECT o_orderpriority, quantile_disc(o_totalprice, 0.95) AS p95 FROM orders GROUP BY 1")
def metric_percentile(spark, sf_dir):
    """Nearest-rank percentile."""
    return metrics.percentile(read(spark, sf_dir, "orders"), "o_totalprice", 95, ["o_orderpriority"])


_DIMENSIONS = {"lang": "lang", "source": "source", "quality": "CAST(quality AS VARCHAR)", "size": "CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 5000 THEN 'middle' ELSE 'long' END", "lines": "CASE WHEN contains(text, chr(10)) THEN 'many' ELSE 'one' END", "held": "CASE WHEN doc_id % 5 = 0 THEN 'held' ELSE 'learnt' END", "first": "lower(left(text, 1))"}


@query("WITH d AS (SELECT CAST(l.toxic AS DOUBLE) AS m, " + ", ".join(f"{e} AS d_{k}" for k, e in _DIMENSIONS.items()) + " FROM labels l JOIN documents d USING (doc_id)) SELECT 'all' AS dimension, 'all' AS value, count(m) AS n, avg(m) AS mean FROM d" + "".join(f" UNION ALL SELECT '{k}', d_{k}, count(m), avg(m) FROM d GROUP BY d_{k}" for k in _DIMENSIONS))
def metric_breakdown(spark, sf_dir):
    """A metric over seven dimensions in one pass."""
    size = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 5000, "middle").otherwise("long")
    d = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents"), "doc_id").select(
        F.col("toxic").cast("double").alias("m"), "lang", "source", "quality", size.alias("size"), F.when(F.contains("text", F.lit("\n")), "many").otherwise("one").alias("lines"),
        F.when(F.col("doc_id") % 5 == 0, "held").otherwise("learnt").alias("held"), F.lower(F.substring("text", 1, 1)).alias("first"),
    )
    return metrics.breakdown(d, "m", list(_DIMENSIONS))


@query("WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY CAST('0x' || left(sha256('s|' || doc_id), 8) AS BIGINT), doc_id) AS n, count(*) OVER (PARTITION BY lang) AS total FROM documents) SELECT doc_id, lang FROM r WHERE n <= ceil(total * 0.3)")
def metric_split(spark, sf_dir):
    """Thirty of a hundred of each language, by a hash of the id."""
    return metrics.stratified_split(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang", 0.3, "s").filter("held").select("doc_id", "lang")


@query()
def metric_bootstrap(spark, sf_dir):
    """The interval of a mean."""
    return metrics.bootstrap_ci(read(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("double").alias("v")), "v")


#: Every model made of lineitem, in an order that runs.
_OF_ITEMS = [m for m in lineage.topological(models.reads()) if any("lineitem" in models.reads()[a] for a in models.ancestors(m))]


def _changed_oracle() -> str:
    """All models twice, over lineitem and over its changed twin, and each column's values compared as a bag."""
    import re

    need = [m for m in lineage.topological(models.reads()) if any(m in models.ancestors(x) for x in _OF_ITEMS)]
    twin = lambda sql: re.sub(rf"\b({'|'.join([*_OF_ITEMS, 'lineitem'])})\b(?!\.)", r"\1__b", sql)
    ctes = [f"{m} AS ({models.MODELS[m]})" for m in need] + ["lineitem__b AS (SELECT * REPLACE (l_quantity + 7.31 AS l_quantity) FROM lineitem)"] + [f"{m}__b AS ({re.sub(r'__b(?=[.])', '', twin(models.MODELS[m]))})" for m in _OF_ITEMS]
    bag = lambda c, t: f"(SELECT (count(*), sum(hash(CASE WHEN typeof({c}) IN ('DOUBLE', 'FLOAT') THEN printf('%.9e', TRY_CAST({c} AS DOUBLE) + 0.0) ELSE CAST({c} AS VARCHAR) END)::HUGEINT)) FROM {t})"
    rows = [f"SELECT '{m}' AS model, '{c}' AS \"column\" WHERE {bag(c, m)} IS DISTINCT FROM {bag(c, m + '__b')}" for m, c in gold.columns() if m in _OF_ITEMS]
    return "WITH " + ", ".join(ctes) + " " + " UNION ALL ".join(rows)


@query(_changed_oracle())
def perturb_affected(spark, sf_dir):
    """The columns of all models that change when lineitem.l_quantity does."""
    models.register(spark, sf_dir)
    li = read(spark, sf_dir, "lineitem").withColumn("__row", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    li.createOrReplaceTempView("lineitem")
    return perturb.affected(spark, "lineitem", "l_quantity", "shift", "__row", {m: models.MODELS[m] for m in _OF_ITEMS})


@query("SELECT c AS cutoff, max(o_totalprice) FILTER (o_totalprice < c) AS nearest_below, count(*) FILTER (o_totalprice = c) AS at_cutoff, min(o_totalprice) FILTER (o_totalprice > c) AS nearest_above, count(*) FILTER (o_totalprice < c) AS rows_below, count(*) FILTER (o_totalprice > c) AS rows_above FROM orders, (VALUES (50000.0::DOUBLE), (150000.0)) AS v(c) GROUP BY c")
def perturb_nearest(spark, sf_dir):
    """The values around cut-offs."""
    return perturb.nearest(read(spark, sf_dir, "orders"), "o_totalprice", [50000.0, 150000.0])


@query("SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_hourly(spark, sf_dir):
    """Hourly windows (the same expression runs over a stream with a watermark)."""
    return streams.hourly(read(spark, sf_dir, "events")).withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH:mm:ss"))


_DST = "CASE WHEN t >= TIMESTAMP '2024-03-10 10:00:00' AND t < TIMESTAMP '2024-11-03 09:00:00' THEN 7 ELSE 8 END"


@query(f"WITH e AS (SELECT event_type, DATE_TRUNC('second', TIMESTAMP '2024-01-01') + (event_id * 9 * 3600 + extract(epoch FROM ts)::BIGINT % 3600) % 31536000 * INTERVAL 1 SECOND AS t FROM events) SELECT event_type AS key, CAST(CAST(t - {_DST} * INTERVAL 1 HOUR AS DATE) AS VARCHAR) AS day, count(*) AS n FROM e GROUP BY 1, 2")
def stream_daily_counter(spark, sf_dir):
    """Events per type and day on the Pacific coast, their times spread over a year with both changes of the clock."""
    e = read(spark, sf_dir, "events")
    seconds = F.pmod(F.col("event_id") * 9 * 3600 + F.pmod(F.unix_seconds(F.col("ts").cast("timestamp")), F.lit(3600)), F.lit(31536000))
    spread = e.withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + seconds))
    return streams.daily_counter(spread).withColumn("day", F.col("day").cast("string"))


from tributary import queries_project, queries_sql  # noqa: E402, F401  (they register theirs)
