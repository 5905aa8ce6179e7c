"""Columns that prose mentions, affirms or denies, and the scores of answers, as tables.

A text is opened to tokens; a sentence falls into clauses (at words that turn it,
and at ", which ... ,"), and a mention is denied by a word of denial before it in
its clause, or right behind it. Windows over (text, sentence, clause) say so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.operators.metrics import prf

# Words that part clauses, that deny, and that a denial may be about instead.
TURNS = ("but", "however", "whereas", "while", "including", "plus")
RELATIVES = ("which", "that", "who")
DENIALS = ("not", "no", "never", "without", "neither", "nor", "except", "excluding")
DENIAL_PAIRS = ("rather than", "instead of", "other than")
AFTER_ONE = ("isn't", "aren't", "wasn't", "doesn't", "didn't", "never")
AFTER_TWO = ("is not", "are not", "was not", "does not", "did not", "is never", "no longer", "has no")
VALUE_WORDS = ("null", "nullable", "empty", "zero", "negative", "unique", "missing", "blank")

#: A token: a dotted name, a word, or one sign.
TOKEN = r"[a-z_]\w*(?:\.[a-z_]\w*)+|[a-z0-9_']+|[^\sa-z0-9_']"
_SPEECH = r"\S*/\S*|\b[\w.]+\.(?:sql|yml|yaml|csv|py|md|json|txt)\b"


def tokens(texts: DataFrame) -> DataFrame:
    """(id, sentence, pos, tok) of (id, text), lower case; paths and file names are left out."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.translate("text", "’\"", "'")), _SPEECH, " "), r"\b(e\.g|i\.e|etc|vs|cf|al)\.", " ")
    sentences = texts.select("id", F.posexplode(F.split(plain, r"[.!?;]+(?=\s|$)")).alias("sentence", "s"))
    return sentences.select("id", "sentence", F.posexplode(F.regexp_extract_all("s", F.lit(f"({TOKEN})"), F.lit(1))).alias("pos", "tok"))


def clauses(toks: DataFrame) -> DataFrame:
    """Adds ``clause``, a text that is the same for the tokens of one clause of a sentence."""
    w = Window.partitionBy("id", "sentence").orderBy("pos")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    ahead = F.coalesce(F.lead("tok").over(w), F.lit(""))
    comma, turn = F.col("tok") == ",", F.col("tok").isin(*TURNS) | ((F.col("tok") == "instead") & (ahead != "of"))
    marked = toks.withColumns({"opens": comma & ahead.isin(*RELATIVES), "comma": comma.cast("int"), "turn": turn.cast("int")})
    counted = marked.withColumns({"commas": F.sum("comma").over(upto), "turns": F.sum("turn").over(upto), "opened": F.sum(F.col("opens").cast("int")).over(upto)})
    begun = counted.withColumns({"at": F.last(F.when(F.col("opens"), F.col("commas")), True).over(upto), "turned": F.last(F.when(F.col("opens"), F.col("turns")), True).over(upto)})
    # Within a relative clause no comma stands since its own, and nothing has turned since.
    within = (F.col("at") == F.col("commas")) & (F.col("turned") == F.col("turns"))
    name = F.concat_ws("-", F.col("turns").cast("string"), F.when(F.coalesce(within, F.lit(False)), F.concat(F.lit("r"), F.col("opened").cast("string"))).otherwise("m"))
    return begun.select("id", "sentence", "pos", "tok", name.alias("clause"))


def mentions(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, node, kind, negated) of each mention, in (id, text), of (node, kind); dotted names of no node, which have an underscore before the dot, are ``unknown``."""
    toks = clauses(tokens(texts)).join(F.broadcast(nodes.select(F.lower("node").alias("tok"), "kind").distinct()), "tok", "left")  # a project's columns and models
    guess = F.when(F.col("tok").rlike(r"^\w*_\w*\.\w"), "unknown")
    toks = toks.withColumn("kind", F.coalesce("kind", guess))
    line = Window.partitionBy("id", "sentence").orderBy("pos")
    own = Window.partitionBy("id", "sentence", "clause").orderBy("pos")
    before, after = own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(1, Window.unboundedFollowing)
    nxt = [F.coalesce(F.lead("tok", k).over(line), F.lit("")) for k in (1, 2, 3)]
    same = [F.coalesce(F.lead("clause", k).over(line) == F.col("clause"), F.lit(False)) for k in (1, 2, 3)]
    seen = toks.withColumns({f"t{k + 1}": nxt[k] for k in range(3)} | {f"c{k + 1}": same[k] for k in range(3)})
    seen = seen.withColumns({"value_at": F.first(F.when(F.col("tok").isin(*VALUE_WORDS), F.col("pos")), True).over(after), "mention_at": F.first(F.when(F.col("kind").isNotNull(), F.col("pos")), True).over(after)})
    # "is not null" says something of a value and nothing of the lineage.
    about_value = F.col("value_at").isNotNull() & (F.col("mention_at").isNull() | (F.col("value_at") < F.col("mention_at")))
    denies = (F.col("tok").isin(*DENIALS) & ~((F.col("tok") == "not") & (F.col("t1") == "only"))) | F.col("tok").contains("n't") | F.concat_ws(" ", "tok", "t1").isin(*DENIAL_PAIRS)
    seen = seen.withColumn("denied", F.coalesce(F.max((denies & ~about_value).cast("int")).over(before), F.lit(0)) == 1)
    skip = F.col("t1").isin("itself", "column")
    one, two = F.when(skip, F.col("t2")).otherwise(F.col("t1")), F.when(skip, F.concat_ws(" ", "t2", "t3")).otherwise(F.concat_ws(" ", "t1", "t2"))
    in_one, in_two = F.when(skip, F.col("c2")).otherwise(F.col("c1")), F.when(skip, F.col("c3")).otherwise(F.col("c2"))
    behind = ((one.isin(*AFTER_ONE) & in_one) | (two.isin(*AFTER_TWO) & in_two)) & ~about_value
    return seen.filter("kind is not null").select("id", F.col("tok").alias("node"), "kind", (F.col("denied") | behind).alias("negated"))


def kept_nodes(found: DataFrame) -> DataFrame:
    """(id, node, kind, negated): each node of a text once; it is negated where every mention of it is."""
    return found.groupBy("id", "node", "kind").agg(F.min(F.col("negated").cast("int")).alias("n")).select("id", "node", "kind", (F.col("n") == 1).alias("negated"))


_PROVENANCE = r"\b(comes? from|computed|calculated|derived|origin(ally)?|source)\b"
_EFFECT = r"\b(affect(s|ed)?|change[sd]?|impact|show up|depends? on|downstream|in the lineage|feeds? into)\b"


def wording(question: Column) -> Column:
    """P of where from, E of what it affects, both, or null."""
    p, e = F.lower(question).rlike(_PROVENANCE), F.lower(question).rlike(_EFFECT)
    return F.when(p & e, "both").when(p, "P").when(e, "E")


def mode(subtype: Column) -> Column:
    """Whether a question's gold follows values alone (direct) or rows too (all); null where it has none."""
    return F.when(subtype.isin("upstream", "computed", "ambiguous", "multi_part", "false_premise"), "direct").when(subtype.isin("downstream", "yesno"), "all")


def predictions(records: DataFrame, view: str = "validated") -> DataFrame:
    """(id, kind, text, claims) of records (id, answer, validated, augmented, error), each an answer struct (refused, text, claims): the draft, what rules left of it, or that with what was added."""
    own = {"raw": F.col("answer"), "validated": F.coalesce("validated", "answer"), "augmented": F.coalesce("augmented", "validated", "answer")}[view]
    a = records.select("id", own.alias("a"), "error")
    kind = F.when(F.col("error").isNotNull() | F.col("a").isNull(), "error").when(F.col("a.refused"), "refused").otherwise("answered")
    return a.select("id", kind.alias("kind"), F.concat_ws(" ", "a.text", F.transform("a.claims", lambda c: c["text"])).alias("text"), F.coalesce("a.claims", F.array().cast(records.schema["answer"].dataType["claims"].dataType)).alias("claims"))


def checked_citations(cites: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, cite, verdict) of citations (id, cite, file, first_line, last_line, word) against files' lines (file, n, text): ok, no_file, no_lines or no_word. Each citation is read again from the text, whatever a validator said."""
    per = lines.groupBy("file").agg(F.max("n").alias("n_lines"))
    span = cites.join(lines, (cites["file"] == lines["file"]) & lines["n"].between(cites["first_line"], cites["last_line"]), "left").groupBy("id", "cite", cites["file"].alias("f"), "first_line", "last_line", "word").agg(F.concat_ws("\n", F.collect_list("text")).alias("cited"))
    held = span.join(per, span["f"] == per["file"], "left")
    has = F.regexp_like(F.lower("cited"), F.concat(F.lit(r"(^|[^\w])"), F.lower("word"), F.lit(r"($|[^\w])")))
    verdict = F.when(F.col("n_lines").isNull(), "no_file").when((F.col("first_line") < 1) | (F.col("last_line") > F.col("n_lines")) | (F.col("first_line") > F.col("last_line")), "no_lines").when(~has, "no_word").otherwise("ok")
    return held.select("id", "cite", verdict.alias("verdict"))


def scored(questions: DataFrame, preds: DataFrame, found: DataFrame) -> DataFrame:
    """One row per question (id, subtype, gold array of nodes): kind of answer, mode, precision, recall and F1 of the columns that it affirms, how many unknown names it has, and for a false premise (``premise``) whether it is rejected, asserted or left out."""
    k = kept_nodes(found)
    per = k.groupBy("id").agg(
        F.collect_set(F.when((F.col("kind") == "column") & ~F.col("negated"), F.col("node"))).alias("affirmed"),
        F.collect_set(F.when((F.col("kind") == "column") & F.col("negated"), F.col("node"))).alias("denied"),
        F.count_if(F.col("kind") == "unknown").alias("n_unknown"),
    )
    none = F.array().cast("array<string>")
    rows = questions.join(preds.select("id", F.col("kind").alias("answer_kind")), "id", "left").join(per, "id", "left")
    rows = rows.withColumns({"affirmed": F.coalesce("affirmed", none), "denied": F.coalesce("denied", none), "n_unknown": F.coalesce("n_unknown", F.lit(0).cast("long")), "answer_kind": F.coalesce("answer_kind", F.lit("error"))})
    p, r, f = prf(F.col("affirmed"), F.col("gold"))
    answered = F.col("answer_kind") == "answered"
    able = answered & F.col("gold").isNotNull()
    premise = F.when(F.col("premise").isNull(), F.lit(None).cast("string")).when(answered & F.array_contains("denied", F.col("premise")), "rejected").when(answered & F.array_contains("affirmed", F.col("premise")), "asserted").otherwise("silent")
    return rows.select("id", "subtype", "answer_kind", mode(F.col("subtype")).alias("mode"), F.when(able, p).alias("precision"), F.when(able, r).alias("recall"), F.when(able, f).otherwise(F.when(F.col("gold").isNotNull(), 0.0)).alias("f1"), "n_unknown", premise.alias("premise_outcome"))


def interpreted(texts: DataFrame) -> DataFrame:
    """(id, said, taken) of "Interpreted A as B." at an answer's start, in their last two parts."""
    short = lambda c: F.substring_index(F.lower(F.translate(c, "\"`", "")), ".", -2)
    pattern = r"Interpreted\s+(\S+)\s+as\s+(\S+?)\.(?=\s|$)"
    got = texts.filter(F.col("text").rlike(pattern))
    return got.select("id", short(F.regexp_extract("text", pattern, 1)).alias("said"), short(F.regexp_extract("text", pattern, 2)).alias("taken"))


def sheet_means(sheet: DataFrame) -> DataFrame:
    """(system, n, mean) of (system, fact, right): the mean over facts of the share of answers that have it."""
    per = sheet.groupBy("system", "fact").agg(F.avg(F.col("right").cast("double")).alias("share"))
    return per.groupBy("system").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("share"), 6).alias("mean"))


def removed_claims(before: DataFrame, after: DataFrame, failures: DataFrame, gold: DataFrame) -> DataFrame:
    """(rule, n, n_right) of the claims (id, claim, node) that rules (id, claim, rule) took out: how many, and how many of them named a gold node (id, node)."""
    gone = before.join(after.select("id", "claim").distinct(), ["id", "claim"], "left_anti")
    right = gone.join(gold.select("id", "node").distinct(), ["id", "node"], "left_semi").select("id", "claim").distinct().withColumn("right", F.lit(1))
    told = gone.select("id", "claim").distinct().join(failures.select("id", "claim", "rule").distinct(), ["id", "claim"]).join(right, ["id", "claim"], "left")
    return told.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.count("right").alias("n_right"))


def same_records(a: DataFrame, b: DataFrame, volatile: tuple[str, ...] = ()) -> DataFrame:
    """Rows, without the columns that may differ from run to run, that only one of two sets of records has."""
    x, y = a.drop(*volatile), b.drop(*volatile)
    return x.exceptAll(y).withColumn("only", F.lit("a")).unionByName(y.exceptAll(x).withColumn("only", F.lit("b")))


def fresh_latency(records: DataFrame) -> DataFrame:
    """(n, p50, p95) of the seconds of records (seconds, calls array of (cached)) with a call, none of them from a cache."""
    fresh = records.filter((F.size("calls") > 0) & ~F.exists("calls", lambda c: c["cached"]))
    cut = lambda q: F.expr(f"percentile_disc({q}) within group (order by seconds)")
    return fresh.agg(F.count(F.lit(1)).alias("n"), cut(0.5).alias("p50"), cut(0.95).alias("p95"))
