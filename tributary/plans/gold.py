"""The corpus's lineage as written down by hand-checked rows, and its expansion to pairs.

``GOLD`` lists direct edges: after a relation, each column, or ``column>output:K``
where the name changes or the kind is not identity (R rename, T transformation,
A aggregation). ``INDIRECT`` lists clause keys: model, columns, type and the
outputs they apply to (``*`` is all). A pair with a direct edge has no indirect one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = {"I": "IDENTITY", "R": "RENAME", "T": "TRANSFORMATION", "A": "AGGREGATION"}

GOLD = {
    "stg_customers": "customer c_acctbal>balance:R c_custkey>customer_id:R c_mktsegment>segment:T c_name>customer_name:T c_nationkey>nation_id:R",
    "stg_events": "events event_id event_type>event_type:T ts user_id value",
    "int_event_attribution": "stg_events event_id>click_id:R event_id user_id value>click_value:R",
    "stg_items": "lineitem l_discount>discount:R l_extendedprice>price:R l_linenumber>line_number:R l_orderkey>order_id:R l_partkey>part_id:R l_quantity>quantity:R l_returnflag>return_flag:R l_shipdate>ship_date:T l_suppkey>supplier_id:R",
    "fct_items_slim": "stg_items line_number order_id part_id quantity>quantity:T return_flag ship_date supplier_id",
    "stg_orders": "orders o_custkey>customer_id:R o_orderdate>order_date:T o_orderkey>order_id:R o_orderpriority>priority:R o_orderstatus>status:R o_totalprice>total_price:R",
    "fct_priorities": "stg_orders customer_id priority>priorities:A status>n_status:A",
    "int_adjustments": "stg_items discount>amount:T order_id>adjustment_id:T order_id price>amount:T; stg_orders order_id>adjustment_id:T order_id total_price>amount:R",
    "int_latest_order": "stg_orders customer_id order_date order_id",
    "stg_parts": "part p_brand>brand:T p_name>part_name:R p_partkey>part_id:R p_retailprice>retail_price:R p_size>size:R p_type>part_type:R",
    "int_items_enriched": "stg_items discount>net_price:T line_number order_id part_id price>net_price:T quantity; stg_parts brand size>size_class:T",
    "fct_part_performance": "int_items_enriched net_price>revenue:A net_price>unit_revenue:A order_id>big_orders:A quantity>unit_revenue:A; stg_parts brand part_id",
    "fct_top_parts": "fct_part_performance brand part_id revenue",
    "int_order_totals": "int_items_enriched net_price>items_total:A; stg_orders customer_id order_date order_id status>state:T status",
    "fct_monthly": "int_order_totals items_total>change:A items_total>revenue:A items_total>running:A order_date>month:T",
    "int_customer_history": "int_order_totals customer_id items_total n_items order_date order_date>previous_order_date:T order_id state status",
    "fct_orders": "int_customer_history customer_id items_total order_date>days_since_previous:T order_id order_number previous_order_date>days_since_previous:T state status",
    "dim_customers": "fct_orders items_total>lifetime_value:A; stg_customers customer_id customer_name>label:T segment>label:T",
    "dim_segments": "dim_customers customer_id lifetime_value lifetime_value>segment:T",
    "fct_recent": "int_latest_order customer_id order_date>days_ago:T; stg_orders order_date>days_ago:A",
}

CONSTANTS = {"int_adjustments": ["kind"], "int_order_totals": ["n_items"], "int_customer_history": ["order_number"], "dim_customers": ["n_orders", "is_frequent"]}

INDIRECT = [
    ("stg_events", "events.user_id", "FILTER", "*"),
    ("int_event_attribution", "stg_events.event_type stg_events.ts stg_events.event_id", "FILTER", "*"),
    ("int_event_attribution", "stg_events.user_id stg_events.event_type stg_events.ts", "JOIN", "*"),
    ("fct_priorities", "stg_orders.customer_id", "GROUP_BY", "*"),
    ("int_adjustments", "stg_items.return_flag stg_items.discount stg_orders.status", "FILTER", "*"),
    ("int_latest_order", "stg_orders.customer_id stg_orders.order_date stg_orders.order_id", "FILTER", "*"),
    ("int_items_enriched", "stg_items.part_id stg_parts.part_id", "JOIN", "*"),
    ("fct_part_performance", "stg_parts.part_id int_items_enriched.part_id", "JOIN", "*"),
    ("fct_part_performance", "stg_parts.part_id stg_parts.brand", "GROUP_BY", "*"),
    ("fct_part_performance", "int_items_enriched.quantity", "CONDITIONAL", "big_orders"),
    ("fct_top_parts", "fct_part_performance.revenue fct_part_performance.part_id", "SORT", "*"),
    ("int_order_totals", "int_items_enriched.order_id stg_orders.order_id", "JOIN", "*"),
    ("int_order_totals", "int_items_enriched.order_id", "GROUP_BY", "items_total n_items"),
    ("fct_monthly", "int_order_totals.order_date", "GROUP_BY", "*"),
    ("fct_monthly", "int_order_totals.order_date", "WINDOW", "change running"),
    ("int_customer_history", "int_order_totals.customer_id int_order_totals.order_date int_order_totals.order_id", "WINDOW", "order_number previous_order_date"),
    ("dim_customers", "fct_orders.customer_id stg_customers.customer_id", "JOIN", "*"),
    ("dim_customers", "fct_orders.customer_id", "GROUP_BY", "lifetime_value n_orders is_frequent"),
    ("fct_recent", "int_latest_order.customer_id dim_customers.customer_id dim_customers.n_orders", "FILTER", "*"),
]


def direct_rows() -> list[tuple[str, str, str, str]]:
    """(from, to, kind, model)."""
    out = []
    for model, text in GOLD.items():
        for group in text.split("; "):
            relation, *cols = group.split()
            for c in cols:
                source, _, rest = c.partition(">")
                output, _, kind = rest.partition(":")
                out.append((f"{relation}.{source}", f"{model}.{output or source}", KINDS[kind or "I"], model))
    return out


def columns() -> list[tuple[str, str]]:
    """(model, column), outputs without an input too."""
    made = {(m, t.split(".")[1]) for _, t, _, m in direct_rows()}
    return sorted(made | {(m, c) for m, cs in CONSTANTS.items() for c in cs})


def gold_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(direct_rows(), "`from` string, `to` string, kind string, model string")


def expand_indirect(spark: SparkSession, rows: list[tuple[str, str, str, str]] = INDIRECT) -> DataFrame:
    """(from, to, type, model): compact rows opened over keys and targets, without the pairs that a direct edge holds."""
    compact = spark.createDataFrame(rows, "model string, keys string, type string, targets string")
    cols = spark.createDataFrame(columns(), "model string, column string").groupBy("model").agg(F.collect_list("column").alias("every"))
    targets = F.when(F.col("targets") == "*", F.col("every")).otherwise(F.split("targets", " "))
    opened = compact.join(cols, "model").select("model", F.explode(F.split("keys", " ")).alias("from"), "type", targets.alias("t"))
    pairs = opened.select("from", "model", "type", F.explode("t").alias("c")).select("from", F.concat_ws(".", "model", "c").alias("to"), "type", "model").distinct()
    return pairs.join(gold_edges(spark).select("from", "to"), ["from", "to"], "left_anti")


# The same rows for SQL.


def _values(rows: list[tuple], names: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{v}'" for v in r) + ")" for r in rows) + f") AS v({names})"


def edges_cte() -> str:
    return f'direct AS (SELECT * FROM {_values(direct_rows(), "src, dst, kind, model")})'


def indirect_cte() -> str:
    compact, cols = _values(INDIRECT, "model, keys, type, targets"), _values(columns(), "model, col")
    return (
        f"cols AS (SELECT * FROM {cols}), compact AS (SELECT model, unnest(string_split(keys, ' ')) AS src, type, targets FROM {compact}), "
        "indirect AS (SELECT DISTINCT c.src, c.model || '.' || k.col AS dst, c.type, c.model FROM compact c JOIN cols k ON k.model = c.model "
        "AND (c.targets = '*' OR list_contains(string_split(c.targets, ' '), k.col)) WHERE NOT EXISTS (SELECT 1 FROM direct d WHERE d.src = c.src AND d.dst = c.model || '.' || k.col))"
    )


# Checks of a written lineage: each gives the rows that break a rule.


def check_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ends of edges that are no column."""
    ends = edges.select(F.col("from").alias("node")).union(edges.select("to")).distinct()
    return ends.join(nodes.select("node"), "node", "left_anti")


def check_duplicates(edges: DataFrame) -> DataFrame:
    """Pairs written more than once."""
    return edges.groupBy("from", "to").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def check_overlap(direct: DataFrame, indirect: DataFrame) -> DataFrame:
    """Indirect pairs that a direct edge holds."""
    return indirect.select("from", "to").distinct().join(direct.select("from", "to"), ["from", "to"], "left_semi")


def check_incoming(edges: DataFrame, nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """Columns of models that nothing leads to; ``sources`` are the raw ones."""
    return nodes.select("node").join(edges.select(F.col("to").alias("node")), "node", "left_anti").join(sources.select("node"), "node", "left_anti")


def depth_histogram(edges: DataFrame) -> DataFrame:
    """(depth, n) of the longest paths from raw columns."""
    from tributary.plans.graph import depths

    return depths(edges).groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


def trace_question(edges: DataFrame, target: str) -> dict:
    """The gold of a question about a column's origin: its inputs, all that lies above it, and where that begins."""
    from tributary.plans import graph as G

    up = G.reach(G.reversed_edges(edges), edges.sparkSession.createDataFrame([(target,)], "n string"))
    rows = {r["node"]: r["depth"] for r in up.collect()}
    first = {r["node"] for r in G.starts(edges).collect()}
    return {"target": target, "inputs": sorted(n for n, d in rows.items() if d == 1), "upstream": sorted(rows), "sources": sorted(set(rows) & first)}


def closure_without(edges: DataFrame, start: str, dropped: DataFrame | None = None) -> DataFrame:
    """(model, column) of all that a column reaches over edges, without some pairs (from, to)."""
    from tributary.plans import graph as G

    left = edges if dropped is None else edges.join(dropped.select("from", "to"), ["from", "to"], "left_anti")
    found = G.reach(left, edges.sparkSession.createDataFrame([(start,)], "n string"))
    return found.select(F.substring_index("node", ".", 1).alias("model"), F.substring_index("node", ".", -1).alias("column"))


def split_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written rows (line, from, to, kind) that can be read, and the others with what is wrong with them."""
    name = r"^[a-z_]\w*(\.[a-z_]\w*)+$"
    why = F.when(~F.coalesce(F.col("from").rlike(name), F.lit(False)), "no column to come from").when(~F.coalesce(F.col("to").rlike(name), F.lit(False)), "no column to go to").when(~F.coalesce(F.col("kind").isin(*KINDS.values()), F.lit(False)), "no such kind").when(F.col("from") == F.col("to"), "an edge to itself")
    told = rows.withColumn("problem", why)
    return told.filter("problem is null").drop("problem"), told.filter("problem is not null").select("line", "problem")


def inputs(direct: DataFrame, indirect: DataFrame) -> DataFrame:
    """(target, direct, indirect): the columns that a column is made of, and those that rule its rows, each in order."""
    rows = direct.select(F.col("to").alias("target"), F.col("from").alias("d"), F.lit(None).cast("string").alias("i")).unionByName(indirect.select(F.col("to").alias("target"), F.lit(None).cast("string").alias("d"), F.col("from").alias("i")))
    return rows.groupBy("target").agg(F.array_sort(F.collect_set("d")).alias("direct"), F.array_sort(F.collect_set("i")).alias("indirect"))


def question_gold(direct: DataFrame, every: DataFrame) -> DataFrame:
    """(target, n_inputs, n_upstream, n_sources, n_impact) of every column: the gold of questions on how it is computed, where it comes from and what it affects."""
    from tributary.plans import graph as G

    nodes = every.select(F.col("from").alias("target")).union(every.select("to")).distinct()
    up = G.reach(G.reversed_edges(direct), nodes)
    first = G.starts(direct).withColumn("first", F.lit(1))
    above = up.join(first, "node", "left").groupBy(F.col("root").alias("target")).agg(F.count_if(F.col("depth") == 1).alias("n_inputs"), F.count(F.lit(1)).alias("n_upstream"), F.count("first").alias("n_sources"))
    below = G.reach(every, nodes).groupBy(F.col("root").alias("target")).agg(F.count(F.lit(1)).alias("n_impact"))
    out = nodes.join(above, "target", "left").join(below, "target", "left")
    return out.select("target", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_inputs", "n_upstream", "n_sources", "n_impact")])
