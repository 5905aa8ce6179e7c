"""Rules over cited claims: each takes DataFrames and gives the failures (claim, rule, item).

``claims``: claim (int), text, ids (array of cited ids). ``ledger``: id, kind
(edge kind or type), from_col, to_col. ``nodes``: node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions.text import without_one
from tributary.plans.graph import components

MIN_PREFIX_HEX = 5
#: A dotted name in prose: parts of letters, digits and underscores, none beginning with a digit, that no path or file leads up to (group 1).
NAME = r"(?:^|[^\w./-])([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+)"

# Words about a kind, and the kinds of edges that make them true.
KIND_WORDS = (
    ("aggregation", r"\baggregat\w*", ("AGGREGATION",)),
    ("sum/count/avg", r"\b(sum|sums|summed|summing|count|counts|counted|avg|average[sd]?)\b", ("AGGREGATION", "TRANSFORMATION")),
    ("rename", r"\brenam\w*", ("RENAME",)),
    ("identity", r"\b(identity|unchanged|as-is|same (value|column)s?|pass(es|ed)? through|passed straight through)\b", ("IDENTITY", "RENAME")),
    ("transformation", r"\b(transform\w*|computed?|computes|calculat\w*)\b", ("TRANSFORMATION", "AGGREGATION")),
)


def _failures(df: DataFrame, rule: str, item: Column) -> DataFrame:
    return df.select("claim", F.lit(rule).alias("rule"), item.cast("string").alias("item"))


def _cited(claims: DataFrame) -> DataFrame:
    return claims.select("claim", "text", F.explode("ids").alias("id"))


def cites(claims: DataFrame) -> DataFrame:
    """Every claim cites something."""
    return _failures(claims.filter(F.coalesce(F.size("ids"), F.lit(0)) <= 0), "R1", F.lit(None))


def in_ledger(claims: DataFrame, ledger: DataFrame) -> DataFrame:
    """R2: every cited id was given out."""
    return _failures(_cited(claims).join(ledger.select("id"), "id", "left_anti"), "R2", F.col("id"))


def repairs(claims: DataFrame, ledger: DataFrame) -> DataFrame:
    """(claim, id, repaired): a bad id for which one given id stands alone: same prefix, and one edit away or begun by five hex digits or more."""
    bad = _cited(claims).join(ledger.select("id"), "id", "left_anti").distinct()
    given = ledger.select(F.col("id").alias("cand")).distinct()
    # One edit apart: both have a text with one character less in common. Begun: the first characters are the same.
    left, right = (df.withColumn("key", F.explode(without_one(F.col(c)))) for df, c in ((bad, "id"), (given, "cand")))
    edited = left.join(right, "key").filter(F.levenshtein("id", "cand") <= 1).select("claim", "id", "cand")
    head = MIN_PREFIX_HEX + 2
    begun = bad.filter(F.length("id") >= head).join(given, F.substring("id", 1, head) == F.substring("cand", 1, head)).filter(F.col("cand").startswith(F.col("id"))).select("claim", "id", "cand")
    near = edited.unionByName(begun).filter(F.substring("id", 1, 2) == F.substring("cand", 1, 2))
    one = near.groupBy("claim", "id").agg(F.count_distinct("cand").alias("n"), F.min("cand").alias("repaired"))
    return one.filter("n = 1").select("claim", "id", "repaired")


def names(claims: DataFrame) -> DataFrame:
    """(claim, name): dotted names in the text, lower case."""
    found = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(NAME), F.lit(1)), F.lower))
    return claims.select("claim", F.explode(found).alias("name")).filter(~F.col("name").rlike(r"\.(sql|csv|yml|yaml|md)$"))


def known_names(claims: DataFrame, ledger: DataFrame, nodes: DataFrame) -> DataFrame:
    """A name is a node, and one that the evidence holds."""
    said = names(claims)
    real = nodes.select(F.lower("node").alias("name")).distinct()
    shown = ledger.select(F.lower("from_col").alias("name")).union(ledger.select(F.lower("to_col"))).distinct()
    unknown = _failures(said.join(real, "name", "left_anti"), "R4", F.concat(F.lit("hallucinated "), "name"))
    unseen = _failures(said.join(real, "name", "left_semi").join(shown, "name", "left_anti"), "R4", F.concat(F.lit("unsupported "), "name"))
    return unknown.unionByName(unseen)


def kind_words(claims: DataFrame, ledger: DataFrame) -> DataFrame:
    """Words about a kind need a cited edge of such a kind."""
    kinds = _cited(claims).join(ledger.select("id", "kind"), "id").groupBy("claim").agg(F.collect_set("kind").alias("kinds"))
    have = claims.select("claim", F.lower("text").alias("t")).join(kinds, "claim")
    said = F.array(*[F.when(F.col("t").rlike(p) & ~F.arrays_overlap("kinds", F.array(*[F.lit(k) for k in ok])), F.lit(w)) for w, p, ok in KIND_WORDS])
    return _failures(have.select("claim", F.explode(F.array_compact(said)).alias("w")), "R5", F.col("w"))


def relevance(claims: DataFrame, ledger: DataFrame) -> DataFrame:
    """A claim with names cites an edge that touches one of them."""
    ends = _cited(claims).join(ledger, "id").select("claim", F.explode(F.array(F.lower("from_col"), F.lower("to_col"))).alias("name"))
    said = names(claims)
    touched = said.join(ends.distinct(), ["claim", "name"], "left_semi").select("claim").distinct()
    cited = _cited(claims).join(ledger.select("id"), "id", "left_semi").select("claim").distinct()
    return _failures(said.select("claim").distinct().join(cited, "claim", "left_semi").join(touched, "claim", "left_anti"), "R7", F.lit(None))


def connectivity(claims: DataFrame, ledger: DataFrame) -> DataFrame:
    """The edges that a claim cites hang together."""
    e = _cited(claims).join(ledger, "id").select("claim", F.concat_ws("|", F.col("claim").cast("string"), F.lower("from_col")).alias("from"), F.concat_ws("|", F.col("claim").cast("string"), F.lower("to_col")).alias("to"))
    parts = components(e.select("from", "to")).select(F.substring_index("node", "|", 1).cast("int").alias("claim"), "component").groupBy("claim").agg(F.count_distinct("component").alias("n"))
    return _failures(parts.filter("n > 1"), "R8", F.col("n"))


def validate(claims: DataFrame, ledger: DataFrame, nodes: DataFrame) -> DataFrame:
    """All failures, ids repaired first where one repair stands alone."""
    fix = repairs(claims, ledger).withColumnRenamed("id", "bad").withColumnRenamed("claim", "in_claim")
    ids = _cited(claims).join(fix, (F.col("in_claim") == F.col("claim")) & (F.col("id") == F.col("bad")), "left").select("claim", F.coalesce("repaired", "id").alias("id"))
    fixed = claims.drop("ids").join(ids.groupBy("claim").agg(F.collect_list("id").alias("ids")), "claim", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))
    out = cites(fixed)
    for rule in (in_ledger(fixed, ledger), known_names(fixed, ledger, nodes), kind_words(fixed, ledger), relevance(fixed, ledger), connectivity(fixed, ledger)):
        out = out.unionByName(rule)
    return out


def salvage(claims: DataFrame, failures: DataFrame) -> DataFrame:
    """The claims that pass."""
    return claims.join(failures.select("claim").distinct(), "claim", "left_anti")


#: A file of a project in prose, with its folders, and "line 3", "lines 3-5", "lines 3 to 5" (the numbers are groups 1 and 2).
PATH = r"(?i)(?:^|[^\w./-])((?:[\w.-]+/)*[\w.-]*\w\.(?:sql|csv|ya?ml))(?!\w)"
LINES = r"(?i)\blines?\s+(\d+)(?:\s*(?:[-–]|to)\s*(\d+))?"


def prose_references(claims: DataFrame, ledger: DataFrame) -> DataFrame:
    """A file or a line that a claim mentions is one that it cites; the ledger has file, first and last line here."""
    cited = _cited(claims).join(ledger.select("id", "file", "first_line", "last_line"), "id")
    files = claims.select("claim", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(PATH), F.lit(1)))).alias("said"))
    match = (files["claim"] == cited["claim"]) & ((F.col("file") == F.col("said")) | F.col("file").endswith(F.concat(F.lit("/"), "said")))
    no_file = _failures(files.join(cited, match, "left_anti"), "R6", F.col("said"))
    spans = claims.select("claim", F.explode(F.regexp_extract_all("text", F.lit(LINES), F.lit(0))).alias("said"))
    a = F.regexp_extract("said", LINES, 1).cast("int")
    b = F.nullif(F.regexp_extract("said", LINES, 2), F.lit("")).cast("int")
    spans = spans.withColumn("a", a).withColumn("b", F.coalesce(b, a))
    inside = (spans["claim"] == cited["claim"]) & (F.col("first_line") <= F.col("a")) & (F.col("b") <= F.col("last_line"))
    return no_file.unionByName(_failures(spans.join(cited, inside, "left_anti"), "R6", F.col("said")))


def verdict(text: Column) -> Column:
    """yes, no or null, from the first sentence of a text."""
    first = F.lower(F.element_at(F.split(F.trim(text), r"(?<=[.!?])\s"), 1))
    return F.when(first.rlike(r"^yes\b"), "yes").when(first.rlike(r"^no\b|\b(not|never|cannot|doesn't|don't)\b"), "no").when(first.rlike(r"\b(reach|affect|feed|flow|impact)(es|s)?\b"), "yes")


def verdicts(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """A claim that cites a reachability fact (id, reaches) doesn't state its opposite."""
    said = _cited(claims).join(facts.select("id", "reaches"), "id").withColumn("said", verdict(F.col("text")))
    return _failures(said.filter(F.col("said") != F.when(F.col("reaches"), "yes").otherwise("no")), "R9", F.col("id"))
