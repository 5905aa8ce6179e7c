"""Registered queries over a project's columns, lineage and prose."""

from __future__ import annotations

from pyspark.sql import functions as F

from tributary.operators import cards, linking, mentions, perturb
from tributary.plans import gold, graph, models
from tributary.queries import _D, _EVERY, _FULL, _I, _NAMES, _WORDS, _all, _catalog, _direct, corpus_lineage, query, read

_DECLARED = [("dim_customers", "lifetime_value", "All that a customer paid"), ("fct_orders", "state", "Open, closed or partial"), ("fct_orders", "ghost", "Declared and never built"), ("stg_items", "price", "")]


@query(f"""WITH {_D}, {_I}, typed AS (SELECT model, col, CASE WHEN col LIKE '%_id' THEN 'bigint' ELSE 'string' END AS type FROM cols), said AS (SELECT * FROM {gold._values(_DECLARED, "model, col, description")}),
both_ AS (SELECT coalesce(t.model, s.model) AS model, coalesce(t.col, s.col) AS col, type, description FROM typed t FULL JOIN said s ON t.model = s.model AND t.col = s.col)
SELECT model, col AS "column", 'column ' || model || '.' || col || coalesce(' (' || type || ')', '') || coalesce(': ' || nullif(trim(description), ''), '') AS text,
       (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM direct) d WHERE d.dst = model || '.' || col) AS n_in, (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM direct) d WHERE d.src = model || '.' || col) AS n_out FROM both_""")
def project_cards(spark, sf_dir):
    """M6: a card for each column that the catalog or a declaration knows."""
    catalog = spark.createDataFrame([(m, c, "bigint" if c.endswith("_id") else "string") for m, c in gold.columns()], "model string, column string, type string")
    return cards.column_cards(catalog, spark.createDataFrame(_DECLARED, "model string, column string, description string"), _direct(spark, sf_dir))


@query(r"""WITH t AS (SELECT n_nationkey AS id, 'before ' || n_name || chr(10) || '# ' || n_name || chr(10) || 'of region ' || n_regionkey || chr(10) || '## More on ' || left(n_name, 3) || chr(10) || 'last' AS text FROM nation),
l AS (SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM t),
p AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^#{1,6}\s') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY n ROWS UNBOUNDED PRECEDING) AS part FROM l)
SELECT id, part, CASE WHEN part > 0 THEN regexp_replace(arg_min(line, n), '^#+\s*', '') ELSE '' END AS title, min(n) AS first_line, max(n) AS last_line, md5(string_agg(line, chr(10) ORDER BY n)) AS text_md5 FROM p GROUP BY id, part""".replace("\\\\", "\\"))
def project_sections(spark, sf_dir):
    """Texts in sections, one for each heading."""
    n = read(spark, sf_dir, "nation")
    text = F.concat(F.lit("before "), "n_name", F.lit("\n# "), "n_name", F.lit("\nof region "), F.col("n_regionkey").cast("string"), F.lit("\n## More on "), F.substring("n_name", 1, 3), F.lit("\nlast"))
    s = cards.sections(n.select(F.col("n_nationkey").alias("id"), text.alias("text")))
    return s.select("id", "part", "title", F.col("first_line").cast("long").alias("first_line"), F.col("last_line").cast("long").alias("last_line"), F.md5("text").alias("text_md5"))


_KINDS = "SELECT DISTINCT 'column' AS kind, id AS owner, 'column ' || id AS text FROM " + _NAMES + " UNION SELECT 'document', 'd' || doc_id, text FROM documents WHERE trim(text, ' ') <> '' UNION SELECT 'question', 'q' || item_id, text FROM benchmark WHERE trim(text, ' ') <> ''"


@query(f"WITH k AS ({_KINDS}) SELECT kind, count(*) AS n, count(DISTINCT 'c_' || left(sha1(kind || '|' || owner || '|' || text), 8)) AS n_ids FROM k WHERE kind IN ('column', 'question') GROUP BY kind")
def project_chunks(spark, sf_dir):
    """Chunks of several kinds under stable ids, and a mask of kinds."""
    c = _catalog(spark).select(F.col("column_id").alias("owner"), F.concat(F.lit("column "), "column_id").alias("text"))
    d = read(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("owner"), "text")
    q = read(spark, sf_dir, "benchmark").select(F.concat(F.lit("q"), "item_id").alias("owner"), "text")
    made = cards.of_kinds(cards.project_chunks(column=c, document=d, question=q), "column", "question")
    return made.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_ids"))


_SHORT = "list_transform(t, lambda x: coalesce(map {" + _FULL.split("map {", 1)[1].split("}", 1)[0] + "}[x], x))"
_DOTTED_ASKED = ["dim_customers.lifetime_value", "stg_items.qty", "fct_orders.items_tot", "stg_orders.cust_id", "dim_customers.nothing", "no_model.column", "fct_monthly.rev", "plain words"]


@query(f"""WITH m AS (SELECT mention, lower(trim(mention)) AS low, split_part(lower(trim(mention)), '.', 1) AS model, {_SHORT} AS want FROM (SELECT mention, {_WORDS.format("split_part(lower(trim(mention)), '.', 2)")} AS t FROM {gold._values([(x,) for x in _DOTTED_ASKED], "mention")}) WHERE regexp_matches(lower(trim(mention)), '^[a-z_][a-z0-9_]*[.][a-z_][a-z0-9_]*$')),
c AS (SELECT id, split_part(id, '.', 1) AS model, {_SHORT} AS have FROM (SELECT id, {_WORDS.format("name")} AS t FROM {_NAMES})),
met AS (SELECT mention, id, CASE WHEN low = id THEN 0 WHEN have = want OR list_filter(have, lambda x: x <> 'usd') = want THEN 1 ELSE 2 END AS b FROM m JOIN c USING (model)),
best AS (SELECT mention, min(b) AS b FROM met GROUP BY 1)
SELECT mention, id AS column_id, CASE b WHEN 0 THEN 'exact' ELSE 'abbreviation' END AS how FROM met JOIN best USING (mention, b) WHERE b < 2 UNION ALL SELECT mention, NULL, 'none' FROM best WHERE b = 2""")
def link_dotted(spark, sf_dir):
    """Dotted ids, by themselves or by short forms alone."""
    return linking.dotted(spark.createDataFrame([(x,) for x in _DOTTED_ASKED], "mention string"), _catalog(spark))


_SAID = ["order date", "lifetime value of customers", "items total", "size class", "state", "unknown thing", "customer id"]


@query(f"""WITH m AS (SELECT mention, {_WORDS.format("mention")} AS a FROM {gold._values([(x,) for x in _SAID], "mention")}), c AS (SELECT id, {_WORDS.format("name")} AS b FROM {_NAMES}),
s AS (SELECT mention, id, CASE WHEN a = b THEN 1.0::DOUBLE ELSE round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 4) END AS score FROM m, c WHERE len(list_intersect(a, b)) > 0)
SELECT mention, id AS column_id, score, row_number() OVER (PARTITION BY mention ORDER BY score DESC, id) AS rank FROM s WHERE score >= 0.5""")
def link_baseline(spark, sf_dir):
    """The plain linker to compare with."""
    out = linking.baseline(spark.createDataFrame([(x,) for x in _SAID], "mention string"), _catalog(spark))
    return out.select("mention", "column_id", "score", F.col("rank").cast("long").alias("rank"))


_PROSE = [
    (0, "fct_orders.items_total comes from stg_orders.status, but not from stg_parts.brand."),
    (1, "dim_customers.label, which never reads stg_items.price, is built from stg_customers.segment."),
    (2, "It uses stg_orders.priority rather than stg_orders.total_price. fct_monthly.revenue isn't affected."),
    (3, "stg_events.value is not null and feeds int_event_attribution.click_value, see models/x.sql"),
    (4, "Not only stg_items.quantity but fct_items_slim.quantity changes; no other_model.ghost does."),
    (5, "fct_orders.state column does not change while stg_orders.status does."),
    (6, "Without null values stg_parts.size reaches fct_top_parts.brand, excluding stg_parts.size_code."),
    (7, "Nothing here."),
]
_L = lambda *w: "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in w) + ")"


@query(f"""WITH nodes AS (SELECT DISTINCT id AS tok FROM {_NAMES}), texts AS (SELECT * FROM (VALUES {", ".join(f"({i}, '" + t.replace("'", "''") + "')" for i, t in _PROSE)}) AS v(id, text)),
s AS (SELECT id, unnest(list_zip(range(0, 99)[:len(ss)], ss)) AS z FROM (SELECT id, string_split_regex(regexp_replace(lower(text), '\\S*/\\S*|\\b[\\w.]+\\.(?:sql|yml|yaml|csv|py|md|json|txt)\\b', ' ', 'g'), '[.!?;]+(\\s|$)') AS ss FROM texts)),
k AS (SELECT id, z[1] AS sentence, regexp_extract_all(z[2], '[a-z_]\\w*(?:\\.[a-z_]\\w*)+|[a-z0-9_'']+|[^\\sa-z0-9_'']') AS ts FROM s),
toks AS (SELECT id, sentence, generate_subscripts(ts, 1) AS pos, unnest(ts) AS tok FROM k),
a AS (SELECT *, coalesce(lead(tok) OVER w, '') AS t1, coalesce(lead(tok, 2) OVER w, '') AS t2, coalesce(lead(tok, 3) OVER w, '') AS t3 FROM toks WINDOW w AS (PARTITION BY id, sentence ORDER BY pos)),
b AS (SELECT *, tok = ',' AND t1 IN {_L(*mentions.RELATIVES)} AS opens, sum(CASE WHEN tok = ',' THEN 1 ELSE 0 END) OVER w AS commas, sum(CASE WHEN tok IN {_L(*mentions.TURNS)} OR tok = 'instead' AND t1 <> 'of' THEN 1 ELSE 0 END) OVER w AS turns FROM a WINDOW w AS (PARTITION BY id, sentence ORDER BY pos ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER w AS opened, last_value(CASE WHEN opens THEN commas END IGNORE NULLS) OVER w AS at_comma, last_value(CASE WHEN opens THEN turns END IGNORE NULLS) OVER w AS at_turn FROM b WINDOW w AS (PARTITION BY id, sentence ORDER BY pos ROWS UNBOUNDED PRECEDING)),
d AS (SELECT c.*, turns || '-' || CASE WHEN at_comma = commas AND at_turn = turns THEN 'r' || opened ELSE 'm' END AS clause, CASE WHEN n.tok IS NOT NULL THEN 'column' WHEN regexp_matches(c.tok, '^\\w*_\\w*\\.\\w') THEN 'unknown' END AS kind FROM c LEFT JOIN nodes n ON n.tok = c.tok),
e AS (SELECT *, lead(clause) OVER l AS c1, lead(clause, 2) OVER l AS c2, lead(clause, 3) OVER l AS c3, first_value(CASE WHEN tok IN {_L(*mentions.VALUE_WORDS)} THEN pos END IGNORE NULLS) OVER o AS value_at, first_value(CASE WHEN kind IS NOT NULL THEN pos END IGNORE NULLS) OVER o AS mention_at FROM d WINDOW l AS (PARTITION BY id, sentence ORDER BY pos), o AS (PARTITION BY id, sentence, clause ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
f AS (SELECT *, value_at IS NOT NULL AND (mention_at IS NULL OR value_at < mention_at) AS about FROM e),
g AS (SELECT *, max(CASE WHEN NOT about AND (tok IN {_L(*mentions.DENIALS)} AND NOT (tok = 'not' AND t1 = 'only') OR contains(tok, 'n''t') OR tok || ' ' || t1 IN {_L(*mentions.DENIAL_PAIRS)}) THEN 1 ELSE 0 END) OVER (PARTITION BY id, sentence, clause ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  CASE WHEN t1 IN ('itself', 'column') THEN (t2 IN {_L(*mentions.AFTER_ONE)} AND c2 = clause) OR (t2 || ' ' || t3 IN {_L(*mentions.AFTER_TWO)} AND c3 = clause) ELSE (t1 IN {_L(*mentions.AFTER_ONE)} AND c1 = clause) OR (t1 || ' ' || t2 IN {_L(*mentions.AFTER_TWO)} AND c2 = clause) END AS behind FROM f)
SELECT CAST(id AS BIGINT) AS id, tok AS node, kind, min(CASE WHEN coalesce(before, 0) = 1 OR coalesce(behind, false) AND NOT about THEN 1 ELSE 0 END) = 1 AS negated FROM g WHERE kind IS NOT NULL GROUP BY ALL""")
def prose_mentions(spark, sf_dir):
    """What prose says of which columns, clause by clause."""
    nodes = _catalog(spark).select(F.col("column_id").alias("node"), F.lit("column").alias("kind"))
    return mentions.kept_nodes(mentions.mentions(spark.createDataFrame(_PROSE, "id long, text string"), nodes))


@query("SELECT item_id, CASE WHEN p AND e THEN 'both' WHEN p THEN 'P' WHEN e THEN 'E' END AS cue FROM (SELECT item_id, regexp_matches(q, '\\b(comes? from|computed|calculated|derived|origin(ally)?|source)\\b') AS p, regexp_matches(q, '\\b(affect(s|ed)?|change[sd]?|impact|show up|depends? on|downstream|in the lineage|feeds? into)\\b') AS e FROM (SELECT item_id, lower(CASE item_id % 4 WHEN 0 THEN 'Where does ' || left(text, 9) || ' come from?' WHEN 1 THEN 'What does it affect? ' || left(text, 9) WHEN 2 THEN 'Which source feeds into ' || left(text, 9) ELSE text END) AS q FROM benchmark))")
def prose_wording(spark, sf_dir):
    """What the words of a question ask for."""
    b = read(spark, sf_dir, "benchmark")
    short = F.substring("text", 1, 9)
    q = F.when(F.col("item_id") % 4 == 0, F.concat(F.lit("Where does "), short, F.lit(" come from?"))).when(F.col("item_id") % 4 == 1, F.concat(F.lit("What does it affect? "), short)).when(F.col("item_id") % 4 == 2, F.concat(F.lit("Which source feeds into "), short)).otherwise(F.col("text"))
    return b.select("item_id", mentions.wording(q).alias("cue"))


@query(f"WITH RECURSIVE {_D}, walk AS (SELECT dst AS node, 0 AS depth FROM direct WHERE dst NOT IN (SELECT src FROM direct) UNION SELECT d.src, w.depth + 1 FROM walk w JOIN direct d ON d.dst = w.node) SELECT node, CAST(max(depth) AS BIGINT) AS depth FROM walk GROUP BY node")
def graph_heights(spark, sf_dir):
    """The longest path that leaves each column."""
    return graph.heights(_direct(spark, sf_dir)).select("node", F.col("depth").cast("long").alias("depth"))


@query(f"WITH {_D}, {_I}, d AS (SELECT dst, string_agg(src, ' ' ORDER BY src) AS x FROM (SELECT DISTINCT src, dst FROM direct) GROUP BY 1), i AS (SELECT dst, string_agg(src, ' ' ORDER BY src) AS x FROM (SELECT DISTINCT src, dst FROM indirect) GROUP BY 1) SELECT coalesce(d.dst, i.dst) AS target, coalesce(d.x, '') AS direct, coalesce(i.x, '') AS indirect FROM d FULL JOIN i ON d.dst = i.dst")
def graph_inputs(spark, sf_dir):
    """What each column is made of, and what rules its rows."""
    direct, indirect, _ = corpus_lineage(spark, sf_dir)
    return gold.inputs(direct, indirect).select("target", F.array_join("direct", " ").alias("direct"), F.array_join("indirect", " ").alias("indirect"))


@query(f"""WITH RECURSIVE {_EVERY}, nodes AS (SELECT src AS n FROM every UNION SELECT dst FROM every), up AS (SELECT n AS root, n AS node FROM nodes UNION SELECT u.root, d.src FROM up u JOIN direct d ON d.dst = u.node), down AS (SELECT n AS root, n AS node FROM nodes UNION SELECT w.root, e.dst FROM down w JOIN every e ON e.src = w.node)
SELECT n AS target, (SELECT count(DISTINCT src) FROM direct WHERE dst = n) AS n_inputs, (SELECT count(*) - 1 FROM up WHERE root = n) AS n_upstream, (SELECT count(*) FROM up WHERE root = n AND node <> n AND node IN (SELECT src FROM direct) AND node NOT IN (SELECT dst FROM direct)) AS n_sources, (SELECT count(*) - 1 FROM down WHERE root = n) AS n_impact FROM nodes""")
def gold_questions(spark, sf_dir):
    """The gold of questions about every column."""
    return gold.question_gold(_direct(spark, sf_dir), _all(spark, sf_dir))


@query(f"WITH RECURSIVE {_EVERY}, starts AS (SELECT DISTINCT src AS n FROM direct WHERE src NOT IN (SELECT dst FROM direct)), a AS (SELECT n AS root, n AS node FROM starts UNION SELECT a.root, d.dst FROM a JOIN direct d ON d.src = a.node), b AS (SELECT n AS root, n AS node FROM starts UNION SELECT b.root, e.dst FROM b JOIN every e ON e.src = b.node) SELECT n AS node, (SELECT count(*) - 1 FROM a WHERE root = n) AS n_direct, (SELECT count(*) - 1 FROM b WHERE root = n) AS n_all FROM starts")
def graph_indirect_reach(spark, sf_dir):
    """What raw columns reach by values, and by values and rows."""
    value, every = _direct(spark, sf_dir), _all(spark, sf_dir)
    first = graph.starts(value)
    count = lambda e, name: graph.reach(e, first).groupBy(F.col("root").alias("node")).agg(F.count(F.lit(1)).alias(name))
    return first.join(count(value, "n_direct"), "node", "left").join(count(every, "n_all"), "node", "left").select("node", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_direct", "n_all")])


@query(f"WITH {_D}, {_I}, pairs AS (SELECT DISTINCT src, dst FROM indirect) SELECT 'endpoints' AS test, (SELECT count(*) FROM (SELECT dst AS n FROM direct UNION SELECT dst FROM indirect) WHERE n NOT IN (SELECT model || '.' || col FROM cols)) AS n UNION ALL SELECT 'duplicates', (SELECT count(*) FROM (SELECT 1 FROM direct GROUP BY src, dst HAVING count(*) > 1)) UNION ALL SELECT 'overlap', (SELECT count(*) FROM pairs JOIN direct USING (src, dst)) UNION ALL SELECT 'incoming', (SELECT count(*) FROM cols WHERE model || '.' || col NOT IN (SELECT dst FROM direct))")
def gold_checks(spark, sf_dir):
    """What is wrong with a written lineage, rule by rule; constant columns have nothing that leads to them."""
    edges, rest = gold.gold_edges(spark), gold.expand_indirect(spark)
    nodes = spark.createDataFrame([(f"{m}.{c}",) for m, c in gold.columns()], "node string")
    raw = edges.select(F.col("from").alias("node")).join(nodes, "node", "left_anti")
    every = edges.select("from", "to").unionByName(rest.select("from", "to"))
    tests = {"endpoints": gold.check_endpoints(every, nodes.unionByName(raw).distinct()), "duplicates": gold.check_duplicates(edges), "overlap": gold.check_overlap(edges, rest), "incoming": gold.check_incoming(edges, nodes, raw)}
    out = None
    for name, rows in tests.items():
        part = rows.agg(F.lit(name).alias("test"), F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


_WRITTEN = [(1, "a.b", "c.d", "RENAME"), (2, "a", "c.d", "RENAME"), (3, "a.b", "", "RENAME"), (4, "a.b", "c.d", "COPY"), (5, "a.b", "a.b", "IDENTITY"), (6, "x.y", "c.e", "AGGREGATION")]


@query(f"SELECT CAST(line AS BIGINT) AS line, CASE WHEN NOT regexp_matches(src, '^[a-z_][a-z0-9_]*([.][a-z_][a-z0-9_]*)+$') THEN 'no column to come from' WHEN NOT regexp_matches(dst, '^[a-z_][a-z0-9_]*([.][a-z_][a-z0-9_]*)+$') THEN 'no column to go to' WHEN kind NOT IN ('IDENTITY', 'RENAME', 'TRANSFORMATION', 'AGGREGATION') THEN 'no such kind' WHEN src = dst THEN 'an edge to itself' END AS problem FROM {gold._values(_WRITTEN, 'line, src, dst, kind')} WHERE problem IS NOT NULL")
def gold_bad_rows(spark, sf_dir):
    """R2: written rows that can't be read are told and not raised."""
    return gold.split_rows(spark.createDataFrame(_WRITTEN, "line long, `from` string, `to` string, kind string"))[1]


@query(f"WITH RECURSIVE {_EVERY}, left_ AS (SELECT * FROM every WHERE NOT (src = 'stg_items.price' AND dst = 'int_items_enriched.net_price')), walk AS (SELECT 'lineitem.l_extendedprice' AS node UNION SELECT e.dst FROM walk w JOIN left_ e ON e.src = w.node) SELECT split_part(node, '.', 1) AS model, split_part(node, '.', 2) AS \"column\" FROM walk WHERE node <> 'lineitem.l_extendedprice'")
def gold_closure_without(spark, sf_dir):
    """What a column reaches when some edges are taken out."""
    gone = spark.createDataFrame([("stg_items.price", "int_items_enriched.net_price")], "`from` string, `to` string")
    return gold.closure_without(_all(spark, sf_dir), "lineitem.l_extendedprice", gone)


@query("""WITH top2 AS (SELECT o_orderpriority AS v, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) AS k FROM orders GROUP BY 1)
SELECT 'relabel' AS mode, CAST(sum(o_custkey + 1000003) AS DOUBLE) AS total FROM orders UNION ALL SELECT 'scale', sum(o_custkey * 3) FROM orders UNION ALL SELECT 'shift', round(sum(o_totalprice + 7.31), 2) FROM orders UNION ALL SELECT 'scale_price', round(sum(o_totalprice * 1.5), 2) FROM orders
UNION ALL SELECT 'remap_existing', count(*) FROM orders WHERE o_orderpriority IN (SELECT v FROM top2 WHERE k <= 2) UNION ALL SELECT 'remap_new', count(*) FROM orders WHERE o_orderpriority = (SELECT v FROM top2 WHERE k = 1) UNION ALL SELECT 'shuffle', round(sum(o_totalprice), 2) FROM orders
UNION ALL SELECT 'temporal', sum(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 37) FROM orders""")
def perturb_modes(spark, sf_dir):
    """The modes whose sums don't depend on a draw."""
    o = read(spark, sf_dir, "orders")
    change = lambda column, mode: perturb.perturbed(o, column, mode, "o_orderkey")
    second = [r["v"] for r in o.groupBy(F.col("o_orderpriority").alias("v")).count().orderBy(F.desc("count"), "v").limit(2).collect()][1]
    rows = {
        "relabel": change("o_custkey", "relabel").agg(F.sum("o_custkey").cast("double")), "scale": change("o_custkey", "scale").agg(F.sum("o_custkey").cast("double")),
        "shift": change("o_totalprice", "shift").agg(F.round(F.sum("o_totalprice"), 2)), "scale_price": change("o_totalprice", "scale").agg(F.round(F.sum("o_totalprice"), 2)),
        "remap_existing": change("o_orderpriority", "remap_existing").agg(F.count_if(F.col("o_orderpriority") == second).cast("double")),
        "remap_new": change("o_orderpriority", "remap_new").agg(F.count_if(F.col("o_orderpriority") == perturb.NEW_WORD).cast("double")),
        "shuffle": change("o_totalprice", "shuffle").agg(F.round(F.sum("o_totalprice"), 2)),
        "temporal": change("o_orderdate", "shift").agg(F.sum(F.unix_date(F.to_date("o_orderdate"))).cast("double")),
    }
    out = None
    for mode, df in rows.items():
        part = df.toDF("total").select(F.lit(mode).alias("mode"), "total")
        out = part if out is None else out.unionByName(part)
    return out
