"""Registered queries of single SQL constructs, each over whole tables of the driver."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tributary.functions import macros as M
from tributary.functions import text as X
from tributary.queries import ORACLES, QUERIES, plain, query, read

TABLES = ("orders", "customer", "lineitem", "events", "part", "supplier", "nation", "region")


def _same_sql(name: str, doc: str, sql: str) -> None:
    """A query that is the same text in both engines."""

    def run(spark, sf_dir):
        for t in TABLES:
            read(spark, sf_dir, t).createOrReplaceTempView(t)
        return plain(spark.sql(sql))

    run.__name__, run.__doc__ = name, doc
    QUERIES[name], ORACLES[name] = run, sql


_same_sql("sql_constants", "B3: arithmetic and constant columns.", "SELECT o_orderkey, o_totalprice * 2 - 1 AS twice, 'web' AS channel, CAST(NULL AS BIGINT) AS nothing, 1 + 2 AS three, current_timestamp IS NOT NULL AS clocked FROM orders")
_same_sql("sql_table_star", "B7: a table's star beside expressions.", "SELECT c.*, n.n_name, c.c_acctbal / 2 AS half FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey")
_same_sql("sql_exists", "B14: correlated EXISTS and NOT EXISTS.", "SELECT c_custkey, c_mktsegment FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000) AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")
_same_sql("sql_correlated_scalar", "B16: a correlated scalar subquery among the columns.", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS dearest, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n FROM customer c")
_same_sql("sql_between", "B18.", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount BETWEEN 0.03 AND 0.05 AND l_quantity NOT BETWEEN 10 AND 40")
_same_sql("sql_like", "B19.", "SELECT p_partkey, p_type, p_brand LIKE '%1_' AS one FROM part WHERE p_type LIKE '%E%' AND p_name NOT LIKE 'x%'")
_same_sql("sql_in_or", "B20.", "SELECT o_orderkey, o_orderstatus IN ('F', 'P') AS closed FROM orders WHERE o_orderstatus IN ('F', 'O') OR o_totalprice > 100000 AND o_orderpriority NOT IN ('1-URGENT')")
_same_sql("join_two_keys", "C3: left join on two keys.", "SELECT a.l_orderkey, a.l_linenumber, b.l_quantity AS next_quantity FROM lineitem a LEFT JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber")
_same_sql("group_positional", "D13: columns by position.", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2")
_same_sql("window_case_order", "E3: a CASE among the order keys.", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'P' THEN 0 WHEN o_orderstatus = 'O' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey) AS n FROM orders")
_same_sql("window_lead_default", "E6: LEAD with a default.", "SELECT o_orderkey, coalesce(lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), -1) AS following, lead(o_totalprice, 2, 0.0) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS second FROM orders")
_same_sql("window_join_key", "E11: a key made by a window, then joined on.", "WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) SELECT a.event_id, b.event_id AS before FROM n a JOIN n b ON a.user_id = b.user_id AND a.k = b.k + 1")
_same_sql("window_running_filter", "E12: rows up to a running total.", "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT l_orderkey, l_linenumber, l_partkey, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held FROM lineitem) t WHERE held <= 60")

@query("SELECT o_orderkey, DATE '1999-01-01' - CAST(o_orderdate AS DATE) AS days, CAST(CAST(CAST(o_orderdate AS DATE) + INTERVAL 3 MONTH AS DATE) AS VARCHAR) AS later, CAST(CAST(CAST(o_orderdate AS DATE) - INTERVAL 10 DAY AS DATE) AS VARCHAR) AS sooner, datesub('hour', o_orderdate, TIMESTAMP '1999-01-01') AS hours FROM orders")
def date_arithmetic(spark, sf_dir):
    """Days between dates, dates moved by units, seconds between timestamps."""
    o = read(spark, sf_dir, "orders")
    d = F.to_date("o_orderdate")
    return plain(o.select("o_orderkey", F.date_diff(F.to_date(F.lit("1999-01-01")), d).alias("days"), F.add_months(d, 3).alias("later"), F.date_sub(d, 10).alias("sooner"), F.expr("timestampdiff(HOUR, o_orderdate, timestamp '1999-01-01')").alias("hours")))


@query("SELECT o_custkey, len(string_agg(o_orderstatus, '')) AS n, list_sort(string_split(string_agg(o_orderpriority, ','), ','))[1] AS least FROM orders GROUP BY 1")
def agg_string_unordered(spark, sf_dir):
    """Joined texts of a group in any order, compared by what the order can't change."""
    o = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.listagg("o_orderstatus", F.lit("")).alias("s"), F.listagg("o_orderpriority", F.lit(",")).alias("p"))
    return o.select("o_custkey", F.length("s").cast("long").alias("n"), F.array_min(F.split("p", ",")).alias("least"))


@query("SELECT DISTINCT o_orderpriority, quantile_cont(o_totalprice, 0.5) OVER (PARTITION BY o_orderpriority) AS median, quantile_cont(o_totalprice, 0.9) OVER (PARTITION BY o_orderpriority) AS p90 FROM orders")
def window_percentile(spark, sf_dir):
    """Percentiles of a partition beside its rows."""
    read(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return spark.sql("SELECT DISTINCT o_orderpriority, percentile(o_totalprice, 0.5) OVER (PARTITION BY o_orderpriority) AS median, percentile(o_totalprice, 0.9) OVER (PARTITION BY o_orderpriority) AS p90 FROM orders")


@query("WITH q AS (SELECT item_id, text FROM benchmark), d AS (SELECT text, count(*) AS n, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY 1) SELECT item_id, CASE WHEN n IS NULL THEN 'unmatched' WHEN n > 1 THEN 'repeated' ELSE 'matched' END AS outcome, first AS doc_id FROM q LEFT JOIN d ON q.text = d.text")
def join_exact_text(spark, sf_dir):
    """C17: records and questions by equal text; what has no partner or several is told apart."""
    d = read(spark, sf_dir, "documents").filter("text is not null").groupBy("text").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id"))
    outcome = F.when(F.col("n").isNull(), "unmatched").when(F.col("n") > 1, "repeated").otherwise("matched")
    return read(spark, sf_dir, "benchmark").join(d, "text", "left").select("item_id", outcome.alias("outcome"), "doc_id")


@query("SELECT conv_id, turn, CASE WHEN sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) <= 400 THEN md5(text) END AS kept_md5 FROM conversations")
def fn_running_size(spark, sf_dir):
    """Texts while they fit a size together."""
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(M.running_size_guard(F.col("text"), "conv_id", "turn", 400)).alias("kept_md5"))


@query(r"SELECT doc_id, TRY_CAST(nullif(regexp_extract(replace(text, ',', ''), '(-?\d+(?:\.\d+)?)', 1), '') AS DOUBLE) AS number FROM documents")
def fn_number_in(spark, sf_dir):
    """The first number of a text."""
    return read(spark, sf_dir, "documents").select("doc_id", M.number_in(F.col("text")).alias("number"))


@query("SELECT c_custkey, coalesce(nullif(c_nationkey, 3), 0) + coalesce(c_acctbal, 0) AS added, coalesce(c_acctbal, 0) - coalesce(nullif(c_nationkey, 3), 0) AS taken FROM customer")
def fn_safe_sums(spark, sf_dir):
    """Sums in which a null is nothing."""
    n = F.nullif(F.col("c_nationkey"), F.lit(3))
    return read(spark, sf_dir, "customer").select("c_custkey", M.safe_add(n, F.col("c_acctbal")).alias("added"), M.safe_subtract(F.col("c_acctbal"), n).alias("taken"))


@query(r"WITH b AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS u FROM pages) SELECT page_id, string_split(CASE WHEN contains(u, '/') THEN regexp_replace(u, '^[^/?]*/?', '') ELSE '' END, '?')[1] AS path FROM b")
def fn_url_path(spark, sf_dir):
    """H22."""
    return read(spark, sf_dir, "pages").select("page_id", M.url_path(F.col("url")).alias("path"))


@query("SELECT c_custkey, unnest(list_filter(string_split_regex(lower(regexp_replace(c_name || 'AcctBal' || c_mktsegment, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda x: x <> '')) AS word FROM customer".replace("\\\\", "\\"))
def fn_camel_tokens(spark, sf_dir):
    """Names split at capitals and separators."""
    c = read(spark, sf_dir, "customer")
    return c.select("c_custkey", F.explode(X.name_tokens(F.concat("c_name", F.lit("AcctBal"), "c_mktsegment"))).alias("word"))


@query(r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(^|[^\w])the($|[^\w])', 'i')")
def fn_contains_word(spark, sf_dir):
    """Documents that hold a word, whatever its case."""
    return read(spark, sf_dir, "documents").filter(F.col("text").rlike(r"(?i)(^|[^\w])the($|[^\w])")).select("doc_id")


@query("SELECT a.n_name AS name, b.n_name AS other FROM nation a JOIN (SELECT n_name FROM nation UNION ALL SELECT left(n_name, length(n_name) - 1) FROM nation) b ON levenshtein(a.n_name, b.n_name) = 1")
def fn_one_edit(spark, sf_dir):
    """Names one edit apart, met where they agree with one character left out."""
    n = read(spark, sf_dir, "nation").select("n_name")
    other = n.unionByName(n.select(F.expr("left(n_name, length(n_name) - 1)").alias("n_name")))

    key = lambda df, c, i: df.withColumnRenamed("n_name", c).withColumn(i, F.monotonically_increasing_id()).withColumn("key", F.explode(X.without_one(F.col(c))))
    met = key(n, "name", "a").join(key(other, "other", "b"), "key")
    return met.select("a", "b", "name", "other").distinct().filter(F.levenshtein("name", "other") == 1).select("name", "other")


@query("SELECT vec_id, len(embedding) AS dims, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS square, list_position(embedding, list_max(embedding)) AS top, len(list_filter(embedding, lambda x: x > 0)) AS positive FROM embeddings")
def fn_arrays(spark, sf_dir):
    """Arrays as values, by higher-order functions."""
    e, v = read(spark, sf_dir, "embeddings"), F.col("embedding")
    square = F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return e.select("vec_id", F.size(v).cast("long").alias("dims"), F.round(square, 6).alias("square"), F.array_position(v, F.array_max(v)).alias("top"), F.size(F.filter(v, lambda x: x > 0)).cast("long").alias("positive"))


@query("SELECT c_custkey AS key_c_custkey, c_name AS key_c_name FROM customer")
def macro_star(spark, sf_dir):
    """All columns but some, with a prefix."""
    c = read(spark, sf_dir, "customer")
    return c.select(M.star(c, ["c_nationkey", "c_acctbal", "c_mktsegment"], "key_"))


@query("SELECT doc_id, nullif(text, '') IS NULL AS no_text, nullif(lang, '') AS lang FROM documents")
def macro_nullcheck(spark, sf_dir):
    """Empty texts as nulls."""
    return M.nullcheck(read(spark, sf_dir, "documents")).select("doc_id", F.col("text").isNull().alias("no_text"), "lang")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, max(o_totalprice) AS dearest FROM orders GROUP BY 1, 2")
def macro_group_by(spark, sf_dir):
    """Aggregates by the first columns."""
    return M.group_by(read(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", "o_totalprice"), 2, F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("dearest"))


@query("""
SELECT 'at_least_one' AS test, (SELECT count(*) FROM (SELECT count(text) AS n FROM documents) WHERE n = 0) AS failures
UNION ALL SELECT 'not_constant', (SELECT count(*) FROM (SELECT count(DISTINCT l_linestatus) AS n FROM lineitem) WHERE n <= 1)
UNION ALL SELECT 'not_empty_string', (SELECT count(*) FROM documents WHERE trim(text, ' ') = '')
UNION ALL SELECT 'cardinality_equality', (SELECT count(*) FROM (SELECT o_custkey AS v, count(*) AS n FROM orders GROUP BY 1) a FULL JOIN (SELECT c_custkey AS v, count(*) AS n FROM customer GROUP BY 1) b ON a.v = b.v WHERE a.n IS DISTINCT FROM b.n)
UNION ALL SELECT 'equality', (SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT ALL SELECT c_custkey FROM customer)) + (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT ALL SELECT o_custkey FROM orders))
UNION ALL SELECT 'equal_rowcount', (SELECT count(*) FROM (SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1) a FULL JOIN (SELECT l_linestatus AS s, count(*) AS n FROM lineitem GROUP BY 1) b ON a.s = b.s WHERE coalesce(a.n, 0) <> coalesce(b.n, 0))
UNION ALL SELECT 'fewer_rows_than', CASE WHEN (SELECT count(*) FROM orders) >= (SELECT count(*) FROM lineitem) THEN 1 ELSE 0 END
UNION ALL SELECT 'expression_is_true', (SELECT count(*) FROM lineitem WHERE NOT coalesce(l_discount < 0.05 OR l_quantity > 10, false))
UNION ALL SELECT 'not_accepted_values', (SELECT count(DISTINCT o_orderpriority) FROM orders WHERE o_orderpriority IN ('5-LOW', 'none'))
UNION ALL SELECT 'sequential_values', (SELECT count(*) FROM (SELECT l_linenumber - lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS d FROM lineitem) WHERE d <> 1)
UNION ALL SELECT 'recency', (SELECT count(*) FROM (SELECT max(o_orderdate) AS m FROM orders) WHERE m < TIMESTAMP '2020-01-01')
UNION ALL SELECT 'not_null_proportion', (SELECT count(*) FROM (SELECT avg(CASE WHEN text IS NOT NULL THEN 1.0 ELSE 0 END) AS p FROM documents) WHERE p < 0.9)
""")
def macro_more_tests(spark, sf_dir):
    """The other generic data tests and how many rows or groups fail."""
    o, li, d, c = (read(spark, sf_dir, t) for t in ("orders", "lineitem", "documents", "customer"))
    tests = {
        "at_least_one": M.at_least_one(d, "text"), "not_constant": M.not_constant(li, "l_linestatus"), "not_empty_string": M.not_empty_string(d, "text"),
        "cardinality_equality": M.cardinality_equality(o, "o_custkey", c, "c_custkey"), "equality": M.equality(o.select("o_custkey"), c.select(F.col("c_custkey").alias("o_custkey"))),
        "equal_rowcount": M.equal_rowcount(o.select(F.col("o_orderstatus").alias("s")), li.select(F.col("l_linestatus").alias("s")), ["s"]), "fewer_rows_than": M.fewer_rows_than(o, li),
        "expression_is_true": M.expression_is_true(li, "l_discount < 0.05 or l_quantity > 10"), "not_accepted_values": M.not_accepted_values(o, "o_orderpriority", ["5-LOW", "none"]),
        "sequential_values": M.broken_sequence(li, "l_linenumber", ["l_orderkey"]), "recency": M.recency(o, "o_orderdate", F.lit("2020-01-01").cast("timestamp")),
        "not_null_proportion": M.not_null_proportion(d, "text").filter("proportion < 0.9"),
    }
    out = None
    for name, rows in tests.items():
        part = rows.agg(F.lit(name).alias("test"), F.count(F.lit(1)).alias("failures"))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT conv_id, max(turn) FILTER (held <= 300) AS last_turn FROM (SELECT conv_id, turn, sum(ceil(length(text) / 3.0)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS held FROM conversations) GROUP BY 1")
def fn_prefix_under_cap(spark, sf_dir):
    """how far a conversation goes within a number of tokens."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    held = read(spark, sf_dir, "conversations").withColumn("held", F.sum(X.token_estimate(F.col("text"))).over(w))
    return held.groupBy("conv_id").agg(F.max(F.when(F.col("held") <= 300, F.col("turn"))).alias("last_turn"))
