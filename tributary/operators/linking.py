"""Linking words to columns: exact, then normalised names, then fuzzy likeness."""

from __future__ import annotations

import difflib
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.functions.text import name_tokens, rewritten

# The scores of the tiers and the limits between them.
EXACT_ID, EXACT_NAME, SURFACE, REWRITTEN, FUZZY_MAX = 1.00, 0.97, 0.93, 0.87, 0.80
NO_MATCH, AMBIGUOUS_GAP = 0.60, 0.05
#: Two tokens go together from this ratio of shared characters on.
TOKEN_RATIO = 0.8


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of characters in matching blocks, longest first (Ratcliff and Obershelp)."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def close_tokens(left: DataFrame, right: DataFrame) -> DataFrame:
    """(x, y, r): pairs of the distinct tokens of two one-column tables whose ratio reaches ``TOKEN_RATIO``.

    At such a ratio two tokens have some pair of neighbouring characters in
    common, ends counted, so only tokens that share one are compared.
    """

    def grams(df: DataFrame, name: str) -> DataFrame:
        t = df.toDF(name).filter(F.length(name) > 0).distinct()
        edged = F.concat(F.lit("\u0002"), name, F.lit("\u0003"))
        return t.select(name, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(name) + 1), lambda p: F.substring(edged, p, F.lit(2))))).alias("gram"))

    met = grams(left, "x").join(grams(right, "y"), "gram").select("x", "y").distinct()
    short, both = F.least(F.length("x"), F.length("y")), F.length("x") + F.length("y")
    return met.filter(2 * short >= TOKEN_RATIO * both).withColumn("r", ratio("x", "y")).filter(F.col("r") >= TOKEN_RATIO)


def fuzzy_scores(mentions: DataFrame, columns: DataFrame) -> DataFrame:
    """(mention, column_id, score) from ``NO_MATCH`` on: 0.8 of (0.7 token overlap + 0.3 ratio of the whole).

    Both tables have ``plain``, the tokens. Tokens go together best first (ties:
    the later ones first), each once; without such a pair no score reaches the
    limit, so candidates come from the pairs alone.
    """
    m = mentions.select("mention", F.size("plain").alias("na"), F.array_join("plain", " ").alias("a"), F.posexplode("plain").alias("i", "x"))
    c = columns.select("column_id", F.size("plain").alias("nb"), F.array_join("plain", " ").alias("b"), F.posexplode("plain").alias("j", "y"))
    hits = m.join(close_tokens(m.select("x"), c.select("y")), "x").join(c, "y")
    per = hits.groupBy("mention", "column_id").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.first("a").alias("a"), F.first("b").alias("b"), F.sort_array(F.collect_list(F.struct("r", "i", "j")), asc=False).alias("pairs"))
    none = F.array().cast("array<int>")
    start = F.struct(none.alias("left"), none.alias("right"), F.lit(0.0).alias("total"))

    def take(acc, p):
        free = ~F.array_contains(acc["left"], p["i"]) & ~F.array_contains(acc["right"], p["j"])
        return F.when(free, F.struct(F.array_append(acc["left"], p["i"]).alias("left"), F.array_append(acc["right"], p["j"]).alias("right"), (acc["total"] + p["r"]).alias("total"))).otherwise(acc)

    overlap = 2 * F.aggregate("pairs", start, take)["total"] / (F.col("na") + F.col("nb"))
    able = per.withColumn("overlap", overlap).filter(FUZZY_MAX * (0.7 * F.col("overlap") + 0.3) >= NO_MATCH)
    return able.withColumn("score", FUZZY_MAX * (0.7 * F.col("overlap") + 0.3 * ratio("a", "b"))).filter(F.col("score") >= NO_MATCH).select("mention", "column_id", "score")


def _tokens(df: DataFrame, source: str) -> DataFrame:
    t = name_tokens(F.col(source))
    return df.withColumn("surface", t).withColumn("plain", F.transform(t, rewritten))


def link(mentions: DataFrame, columns: DataFrame, fuzzy: bool = True) -> DataFrame:
    """(mention, column_id, score, tier, rank): candidates from 0.60 on for each mention, best first.

    ``columns`` has column_id and name. Tiers: the id itself, the name itself,
    equal tokens, equal tokens in full forms (in any order), and, if asked for,
    fuzzy. Equal-name tiers are equality joins. A column counts with its best tier.
    """
    m = _tokens(mentions.select("mention").distinct(), "mention")
    c = _tokens(columns.select(F.lower("column_id").alias("column_id"), F.lower("name").alias("name")), "name")
    low = F.lower(F.trim("mention"))
    hits = [
        m.join(c, low == F.col("column_id")).select("mention", "column_id", F.lit(EXACT_ID).alias("score"), F.lit("exact_id").alias("tier")),
        m.join(c, low == F.col("name")).select("mention", "column_id", F.lit(EXACT_NAME), F.lit("exact_name")),
        m.alias("m").join(c.alias("c"), F.col("m.surface") == F.col("c.surface")).select("mention", "column_id", F.lit(SURFACE), F.lit("surface")),
        m.alias("m").join(c.alias("c"), F.array_sort("m.plain") == F.array_sort("c.plain")).select("mention", "column_id", F.lit(REWRITTEN), F.lit("rewritten")),
    ]
    if fuzzy:
        hits.append(fuzzy_scores(m, c).withColumn("tier", F.lit("fuzzy")))
    every = reduce(DataFrame.unionByName, [h.toDF("mention", "column_id", "score", "tier") for h in hits])
    best = every.groupBy("mention", "column_id").agg(F.max(F.struct("score", "tier")).alias("b")).select("mention", "column_id", F.round("b.score", 4).alias("score"), "b.tier")
    w = Window.partitionBy("mention").orderBy(F.desc("score"), "column_id")
    return best.withColumn("rank", F.row_number().over(w))


def ambiguous(candidates: DataFrame) -> DataFrame:
    """(mention, ambiguous): whether the second candidate is within 0.05 of the first."""
    w = Window.partitionBy("mention").orderBy("rank")
    gap = candidates.withColumn("next", F.lead("score").over(w)).filter("rank = 1")
    return gap.select("mention", F.coalesce(F.col("score") - F.col("next") < AMBIGUOUS_GAP, F.lit(False)).alias("ambiguous"))


def link_metrics(candidates: DataFrame, gold: DataFrame) -> DataFrame:
    """top1 and top3 over (mention, column_id) gold rows, and no_match over mentions whose gold is null."""
    first = candidates.filter("rank <= 3").select("mention", F.col("column_id").alias("got"), "rank")
    hit = gold.filter("column_id is not null").join(first, "mention", "left").groupBy("mention").agg(
        F.max(((F.col("got") == F.col("column_id")) & (F.col("rank") == 1)).cast("int")).alias("t1"), F.max((F.col("got") == F.col("column_id")).cast("int")).alias("t3")
    )
    none = gold.filter("column_id is null").join(first.select("mention").distinct().withColumn("any", F.lit(1)), "mention", "left")
    a = hit.agg(F.avg(F.coalesce("t1", F.lit(0))).alias("top1"), F.avg(F.coalesce("t3", F.lit(0))).alias("top3"))
    return a.crossJoin(none.agg(F.avg(F.col("any").isNull().cast("double")).alias("no_match")))  # one row each


def qualified(mentions: DataFrame, columns: DataFrame) -> DataFrame:
    """(mention, column_id): "<column> in|of|from <model>" in words; the right part must be one model's name, the left one of its columns.

    Both sides are equality joins on full forms of the words.
    """
    key = lambda c: F.array_join(F.transform(name_tokens(c), rewritten), " ")
    said = mentions.select("mention", F.explode(F.array(F.lit(" in "), F.lit(" of "), F.lit(" from "))).alias("q")).filter(F.lower("mention").contains(F.col("q")))
    said = said.select("mention", key(F.expr("split_part(lower(mention), q, 1)")).alias("left"), key(F.regexp_replace(F.expr("split_part(lower(mention), q, 2)"), r"\b(the|a|an)\b", "")).alias("right"))
    have = columns.select("column_id", key(F.col("name")).alias("left"), key(F.element_at(F.split("column_id", r"\."), -2)).alias("right"))
    return said.join(have, ["left", "right"]).select("mention", "column_id").distinct()


# What a phrase form ends at, words without weight in a name, and the numbers of the search stage.
PHRASE_ENDS = ("per", "by", "for", "on", "in", "of", "from")
WEAK = ("usd",)
SEARCH_BASE, SEARCH_SPAN, SEARCH_COSINE, SEARCH_DEPTH, RRF_TOP = 0.50, 0.30, 0.695, 10, 2 / 61
#: Heads of phrases, and the word that takes their place at the end.
PHRASES = (("P1", "number of", "count"), ("P2", "how many", "count"), ("P3", "count of", "count"), ("P4", "total", "total"))


def phrase_forms(mentions: DataFrame) -> DataFrame:
    """(mention, rule, form): the words themselves (rule null), and a form for each phrase rule whose head the words hold: "number of open orders per day" also reads "open orders count per day"."""
    words = F.array_join(name_tokens(F.col("mention")), " ")
    ends = "|".join(PHRASE_ENDS)
    rules = []
    for rule, head, tail in PHRASES:
        pattern = rf"^(.*?)\b{head} ((?:(?!(?:{ends})\b)\w+(?: |$))+)(.*)$"
        made = F.trim(F.regexp_replace(F.regexp_replace(words, pattern, rf"$1$2 {tail} $3"), " +", " "))
        rules.append(F.when(words.rlike(pattern), F.struct(F.lit(rule).alias("rule"), made.alias("form"))))
    every = F.array_compact(F.array(F.struct(F.lit(None).cast("string").alias("rule"), words.alias("form")), *rules))
    return mentions.select("mention", F.explode(every).alias("x")).select("mention", "x.*")


def _short_forms(text):
    """Tokens with short forms written out and nothing else changed: all that a dotted id may leave to be read."""
    from tributary.functions.text import ABBREVIATIONS

    known = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    return F.transform(name_tokens(text), lambda t: F.coalesce(known[t], t))


def dotted(mentions: DataFrame, columns: DataFrame) -> DataFrame:
    """(mention, column_id, how) of mentions "model.column" whose model exists: the column itself (exact), else the model's columns of equal full forms, units left out on the column's side (abbreviation), else none."""
    m = mentions.select("mention", F.lower(F.trim("mention")).alias("low")).filter(F.col("low").rlike(r"^[a-z_]\w*\.[a-z_]\w*$")).select("mention", "low", F.substring_index("low", ".", 1).alias("model"), _short_forms(F.substring_index("low", ".", -1)).alias("want"))
    c = columns.select(F.lower("column_id").alias("column_id"), F.substring_index(F.lower("column_id"), ".", 1).alias("model"), _short_forms(F.col("name")).alias("have"))
    met = m.join(c, "model")
    full = (F.col("have") == F.col("want")) | (F.filter("have", lambda t: ~t.isin(*WEAK)) == F.col("want"))
    how = F.when(F.col("low") == F.col("column_id"), "exact").when(full, "abbreviation")
    seen = met.select("mention", "column_id", how.alias("how"))
    best = seen.groupBy("mention").agg(F.min(F.when(F.col("how") == "exact", 0).when(F.col("how") == "abbreviation", 1).otherwise(2)).alias("b"))
    chosen = seen.join(best, "mention").filter((F.col("b") == 0) & (F.col("how") == "exact") | (F.col("b") == 1) & (F.col("how") == "abbreviation")).select("mention", "column_id", "how")
    return chosen.unionByName(best.filter("b = 2").select("mention", F.lit(None).cast("string").alias("column_id"), F.lit("none").alias("how")))


def search_candidates(mentions: DataFrame, cards: DataFrame, cosine: float = SEARCH_COSINE) -> DataFrame:
    """(mention, column_id, score, cosine): the search stage: of the first ten cards (id, text) by BM25 and vectors fused, those close enough, at 0.50 + 0.30 of the fused score's share of the best there can be."""
    from tributary.operators import retrieval

    asked = mentions.select(F.col("mention").alias("qid"), F.col("mention").alias("text")).distinct()
    sparse, near = retrieval.both_lists(cards.select("id", "text"), asked)
    fused = retrieval.top(retrieval.rrf(sparse, near), SEARCH_DEPTH)
    close = near.select("qid", "id", F.col("score").alias("cosine")).filter(F.col("cosine") >= cosine)
    return fused.join(close, ["qid", "id"]).select(F.col("qid").alias("mention"), F.col("id").alias("column_id"), F.round(SEARCH_BASE + SEARCH_SPAN * F.least(F.col("score") / RRF_TOP, F.lit(1.0)), 4).alias("score"), F.round("cosine", 4).alias("cosine"))


def with_search(linked: DataFrame, searched: DataFrame) -> DataFrame:
    """(mention, column_id, score, tier, rank): the linker's candidates and, for mentions without one of equal names, those of the search."""
    sure = linked.filter("tier <> 'fuzzy'").select("mention").distinct()
    more = searched.join(sure, "mention", "left_anti").filter(F.col("score") >= NO_MATCH).select("mention", "column_id", "score", F.lit("search").alias("tier"))
    every = linked.select("mention", "column_id", "score", "tier").unionByName(more)
    best = every.groupBy("mention", "column_id").agg(F.max(F.struct("score", "tier")).alias("b")).select("mention", "column_id", "b.*")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("mention").orderBy(F.desc("score"), "column_id")))


def least_cosine(searched: DataFrame, negatives: DataFrame, step: float = 0.005) -> DataFrame:
    """(n, top, least): the highest cosine that a mention of no column reaches, and the next multiple of ``step`` above it, from which on the search stage may speak."""
    top = searched.join(negatives.select("mention"), "mention", "left_semi").agg(F.count_distinct("mention").alias("n"), F.coalesce(F.max("cosine"), F.lit(0.0)).alias("top"))
    return top.withColumn("least", F.round((F.floor(F.col("top") / step) + 1) * step, 6))


def score_spread(linked: DataFrame, gold: DataFrame) -> DataFrame:
    """(positive, n, low, median, high) of the best score per mention, for mentions with and without a column in (mention, column_id)."""
    best = linked.groupBy("mention").agg(F.max("score").alias("best"))
    rows = gold.groupBy("mention").agg(F.max(F.col("column_id").isNotNull()).alias("positive")).join(best, "mention", "left").withColumn("best", F.coalesce("best", F.lit(0.0)))
    cut = lambda q: F.expr(f"percentile_disc({q}) within group (order by best)")
    return rows.groupBy("positive").agg(F.count(F.lit(1)).alias("n"), F.min("best").alias("low"), cut(0.5).alias("median"), F.max("best").alias("high"))


def baseline(mentions: DataFrame, columns: DataFrame) -> DataFrame:
    """(mention, column_id, score, rank): the plain linker to compare with: the name itself, else the share of common words, from one half on."""
    m = mentions.select("mention", name_tokens(F.col("mention")).alias("a")).distinct()
    c = columns.select("column_id", name_tokens(F.col("name")).alias("b"))
    met = m.select("mention", "a", F.explode(F.array_distinct("a")).alias("w")).join(c.select("column_id", "b", F.explode(F.array_distinct("b")).alias("w")), "w").select("mention", "column_id", "a", "b").distinct()
    share = F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b"))
    scored = met.select("mention", "column_id", F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.round(share, 4)).alias("score")).filter("score >= 0.5")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("mention").orderBy(F.desc("score"), "column_id")))


def cases(columns: DataFrame) -> DataFrame:
    """(mention, column_id, variant): ways to write each column, and made-up names that are none (column_id null)."""
    from tributary.functions.text import ABBREVIATIONS

    short = F.create_map(*[F.lit(x) for k, v in ABBREVIATIONS.items() if k not in ("percentage",) for x in (v, k)])
    words = name_tokens(F.col("name"))
    ways = {
        "id": F.col("column_id"), "name": F.col("name"), "spaced": F.array_join(words, " "), "shortened": F.array_join(F.transform(words, lambda w: F.coalesce(short[w], w)), "_"),
        "camel": F.concat(F.element_at(words, 1), F.array_join(F.transform(F.slice(words, 2, 99), F.initcap), "")), "plural": F.concat(F.array_join(words, " "), F.lit("s")),
        "qualified": F.concat(F.array_join(words, " "), F.lit(" in "), F.regexp_replace(F.substring_index("column_id", ".", 1), "_", " ")),
    }
    rows = columns.select("column_id", F.explode(F.array(*[F.struct(F.lit(k).alias("variant"), v.alias("mention")) for k, v in ways.items()])).alias("x"))
    none = columns.select(F.lit(None).cast("string").alias("column_id"), F.struct(F.lit("none").alias("variant"), F.concat(F.lit("qx"), F.substring(F.sha1("column_id"), 1, 6)).alias("mention")).alias("x"))
    return rows.unionByName(none).select("x.mention", "column_id", "x.variant").distinct()
