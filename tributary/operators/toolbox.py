"""Tools over a graph as tables: checked arguments, a log of calls with the ids that they gave out, drafts with citations, and what fits a budget of tokens."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.functions.text import content_id, token_estimate

AMBIGUOUS_GAP, MOST_CANDIDATES = 0.05, 3


class BadArgument(ValueError):
    """An argument that a tool can't take; ``name`` says which."""

    def __init__(self, name: str, why: str):
        super().__init__(f"{name}: {why}")
        self.name = name


def argument(given: Mapping[str, object], name: str, kind: type, default=None, low: int | None = None, high: int | None = None):
    """One argument in its kind: texts of numbers and booleans are read, numbers are held between ``low`` and ``high``, all else is refused."""
    value = given.get(name, default)
    if value is None:
        if default is None and name not in given:
            raise BadArgument(name, "is missing")
        return default
    if kind is bool:
        told = {"true": True, "false": False, "1": True, "0": False}.get(str(value).strip().lower())
        if told is None:
            raise BadArgument(name, f"{value!r} is neither true nor false")
        return told
    if kind is int:
        try:
            number = int(str(value).strip())
        except ValueError:
            raise BadArgument(name, f"{value!r} is no whole number") from None
        number = number if high is None else min(number, high)
        return number if low is None else max(number, low)
    if kind is str:
        text = str(value).strip()
        if not text:
            raise BadArgument(name, "is empty")
        return text
    raise BadArgument(name, f"no way to read a {kind.__name__}")


def edge_records(cited: DataFrame) -> DataFrame:
    """(id, from, to, kind, file, first_line, last_line, level, text) of cited edges: a stable id of its content, and one line that says it."""
    at = F.when(F.col("level") == "model", F.col("file")).otherwise(F.concat("file", F.lit(":"), F.col("first_line").cast("string"), F.when(F.col("first_line") < F.col("last_line"), F.concat(F.lit("-"), F.col("last_line").cast("string"))).otherwise("")))
    return cited.select(content_id("e_", F.col("from"), F.col("to"), F.col("kind")).alias("id"), "from", "to", "kind", "file", "first_line", "last_line", "level", F.concat("from", F.lit(" -> "), "to", F.lit(" ["), "kind", F.lit("] "), at).alias("text"))


@dataclass
class Toolbox:
    """Tools by name. Each call is logged, refused or not; ids that a result gives out go into the ledger, once, with the call that gave them first."""

    spark: SparkSession
    tools: dict[str, Callable[[Mapping[str, object]], DataFrame]]
    log: list[tuple[int, str, str, bool, int]] = field(default_factory=list)
    given: dict[str, int] = field(default_factory=dict)

    def call(self, name: str, arguments: Mapping[str, object], most: int = 1000) -> DataFrame | str:
        """A tool's first rows, which are what a caller sees, or the words of its refusal."""
        n = len(self.log) + 1
        tool = self.tools.get(name)
        try:
            if tool is None:
                raise BadArgument("tool", f"{name!r} is not one of {', '.join(sorted(self.tools))}")
            result = tool(arguments).limit(most)
            rows = result.collect()
        except BadArgument as e:
            self.log.append((n, name, str(e), False, 0))
            return str(e)
        for r in rows:
            if "id" in r.__fields__ and r["id"]:
                self.given.setdefault(r["id"], n)
        self.log.append((n, name, "", True, len(rows)))
        return self.spark.createDataFrame(rows, result.schema)

    def calls(self) -> DataFrame:
        return self.spark.createDataFrame(self.log, "n int, tool string, refusal string, ok boolean, n_rows int")

    def ledger(self) -> DataFrame:
        return self.spark.createDataFrame(list(self.given.items()), "id string, n int")


def ids_in(payloads: DataFrame) -> DataFrame:
    """(n, id): the ids of edges, facts, models and chunks that a payload (n, text) shows."""
    return payloads.select("n", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b([esrc]_[0-9a-f]{8})\b"), F.lit(1)))).alias("id"))


def ambiguity(candidates: DataFrame, question: str, downstream: str | None = None) -> dict | None:
    """What to do with candidates (column_id, score, rank) that are as good: nothing where the question names one of them, the end of their chain where they lie on one (``downstream``), each of them up to three, else ask."""
    rows = candidates.orderBy("rank").limit(200).collect()
    tie = [r["column_id"] for r in rows if r["score"] >= rows[0]["score"] - AMBIGUOUS_GAP - 1e-9]
    if len(tie) < 2 or sum(c.lower() in question.lower() for c in tie) == 1:
        return None
    if downstream:
        return {"mode": "chain", "candidates": tie, "downstream": downstream}
    return {"mode": "per_candidate" if len(tie) <= MOST_CANDIDATES else "clarification", "candidates": tie}


def unknown_columns(mentioned: DataFrame, columns: DataFrame) -> DataFrame:
    """(node, closest): dotted names of models that exist but hold no such column, with up to three of the model's nearest names. An answer about one is refused before any tool is called."""
    c = columns.select(F.lower("column_id").alias("column_id"), F.substring_index(F.lower("column_id"), ".", 1).alias("model"))
    m = mentioned.select(F.lower("node").alias("node")).distinct().join(c.select(F.col("column_id").alias("node")), "node", "left_anti")
    met = m.withColumn("model", F.substring_index("node", ".", 1)).join(c, "model")
    w = Window.partitionBy("node").orderBy(F.levenshtein("node", "column_id"), "column_id")
    near = met.withColumn("k", F.row_number().over(w)).filter("k <= 3")
    return near.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "column_id"))), lambda x: x["column_id"]).alias("closest"))


def with_citations(claims: DataFrame, ledger: DataFrame) -> DataFrame:
    """(claim, text, edges, others, citations) of a draft (claim, text, ids): ids once and in order, edges apart, and for each id that was given out what it cites (id, file, first_line, last_line, level)."""
    ids = claims.select("claim", "text", F.array_distinct(F.filter(F.transform("ids", lambda x: F.trim(x)), lambda x: x != "")).alias("ids"))
    opened = ids.select("claim", F.posexplode("ids").alias("k", "id")).join(ledger.select("id", F.struct("id", "file", "first_line", "last_line", "level").alias("c")), "id")
    cites = opened.groupBy("claim").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda x: x["c"]).alias("citations"))
    held = ids.join(cites, "claim", "left")
    return held.select("claim", "text", F.filter("ids", lambda x: x.startswith("e_")).alias("edges"), F.filter("ids", lambda x: ~x.startswith("e_")).alias("others"), "citations")


def rendered(answer: DataFrame) -> DataFrame:
    """(claim, line): each claim with what it cites in brackets: a file and lines, a file alone, a check of the graph, or an id that nothing is known of."""

    def mark(c):
        lines = F.when(c["first_line"] < c["last_line"], F.concat(c["first_line"].cast("string"), F.lit("-"), c["last_line"].cast("string"))).otherwise(c["first_line"].cast("string"))
        return F.concat(F.lit("["), c["file"], F.when(c["level"] == "model", "").otherwise(F.concat(F.lit(":"), lines)), F.lit("]"))

    none = F.array().cast("array<string>")
    known = F.coalesce(F.transform("citations", lambda c: c["id"]), none)
    rest = F.filter(F.concat("edges", "others"), lambda x: ~F.array_contains(known, x))
    marks = F.array_distinct(F.concat(F.coalesce(F.transform("citations", mark), none), F.transform(rest, lambda x: F.when(x.startswith("r_"), F.lit("[graph check]")).otherwise(F.concat(F.lit("[?"), x, F.lit("]"))))))
    return answer.select("claim", F.concat(F.lit("- "), F.trim("text"), F.lit(" "), F.when(F.size(marks) == 0, "[no citation]").otherwise(F.array_join(marks, " "))).alias("line"))


def compacted(messages: DataFrame, cap: int) -> DataFrame:
    """Messages (n, kind, full, short, shortest) of one talk as ``content`` and ``level``: tool results get shorter, oldest first, to level 1 and then 2, as far as the talk's tokens need it to fit ``cap``; ``fits`` says whether it does."""
    size = {c: token_estimate(F.col(c)) for c in ("full", "short", "shortest")}
    w, every = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()  # one talk's messages
    able = F.col("kind") == "tool"
    won = messages.withColumns({"s0": size["full"], "g1": F.when(able, F.greatest(size["full"] - size["short"], F.lit(0))).otherwise(0), "g2": F.when(able, F.greatest(F.least(size["full"], size["short"]) - size["shortest"], F.lit(0))).otherwise(0)})
    won = won.withColumns({"total": F.sum("s0").over(every), "all1": F.sum("g1").over(every), "u1": F.sum("g1").over(w) - F.col("g1"), "u2": F.sum("g2").over(w) - F.col("g2")})
    need = F.col("total") - cap
    level = F.when(~able, 0).when((need - F.col("all1") > F.col("u2")) & (F.col("g2") > 0), 2).when((need > F.col("u1")) & (F.col("g1") > 0), 1).otherwise(0)
    out = won.withColumn("level", level).withColumn("content", F.when(F.col("level") == 2, F.col("shortest")).when(F.col("level") == 1, F.col("short")).otherwise(F.col("full")))
    return out.withColumn("fits", F.sum(token_estimate(F.col("content"))).over(every) <= cap).select("n", "kind", "level", "content", "fits")


def on_disk(cites: DataFrame, files: DataFrame) -> DataFrame:
    """(id, problem) of citations (id, file, first_line, last_line, sha, word) that don't hold in files (file, text): no such file, no such lines, another excerpt (SHA-1), or without the word."""
    rows = cites.join(files, "file", "left").withColumn("lines", F.split("text", "\n"))
    part = F.array_join(F.slice("lines", F.col("first_line"), F.greatest(F.col("last_line") - F.col("first_line") + 1, F.lit(0))), "\n")
    ok = (F.col("first_line") >= 1) & (F.col("first_line") <= F.col("last_line")) & (F.col("last_line") <= F.size("lines"))
    has = F.regexp_like(F.lower("part"), F.concat(F.lit(r"(^|[^\w])"), F.lower("word"), F.lit(r"($|[^\w])")))
    rows = rows.withColumn("part", F.when(ok, part))
    problem = F.when(F.col("text").isNull(), "no such file").when(~ok, "no such lines").when(F.col("sha").isNotNull() & (F.sha1("part") != F.col("sha")), "another excerpt").when(F.col("word").isNotNull() & ~has, "the word is not there")
    return rows.select("id", problem.alias("problem")).filter("problem is not null")


def explained(edges: DataFrame, cites: DataFrame) -> DataFrame:
    """Edges (from, to, kind) beside what was checked of them (from, to, kind, file, first_line, last_line, level, problem)."""
    return edges.join(cites, ["from", "to", "kind"], "left").withColumn("checked", F.when(F.col("file").isNull(), "not cited").otherwise(F.coalesce("problem", F.lit("ok"))))


def regenerate(failures: DataFrame, room: int) -> DataFrame:
    """(rule, line): the failures (rule, line) that a second try is told of, in the order of the rules, as far as their tokens fit."""
    w = Window.orderBy("rule", "line").rowsBetween(Window.unboundedPreceding, 0)  # one answer's failures
    return failures.distinct().withColumn("held", F.sum(token_estimate(F.col("line"))).over(w)).filter(F.col("held") <= room).select("rule", "line")


def named_models(questions: DataFrame, models: DataFrame) -> DataFrame:
    """(id, model): models that a question (id, text) names as words, of overlapping names the longest only."""
    q = questions.select("id", F.regexp_replace(F.lower("text"), "_", " ").alias("t"))
    m = models.select("model", F.regexp_replace(F.lower("model"), "_", " ").alias("words"))
    first = lambda c: F.substring_index(c, " ", 1)
    toks = q.select("id", "t", F.explode(F.array_distinct(F.split("t", r"[^\w]+"))).alias("w"))
    hit = toks.join(m.withColumn("w", first(F.col("words"))), "w").filter(F.regexp_like("t", F.concat(F.lit(r"(^|[^\w])"), "words", F.lit(r"($|[^\w])")))).select("id", "model", "words")
    longer = hit.select("id", F.col("words").alias("other"))
    inside = hit.join(longer, "id").filter((F.length("other") > F.length("words")) & F.contains("other", F.col("words"))).select("id", "model").distinct()
    return hit.select("id", "model").join(inside, ["id", "model"], "left_anti").distinct()


def redacted(texts: DataFrame) -> DataFrame:
    """(id, text) with the values of what is named a password, token, secret or key starred out."""
    return texts.select("id", F.regexp_replace("text", r"(?i)\b(password|passwd|token|secret|api[_-]?key)(\s*[:=]\s*)(\"[^\"]*\"|'[^']*'|\S+)", "$1$2***").alias("text"))


def run_manifest(spark: SparkSession, system: str, records: DataFrame, settings: Mapping[str, str]) -> DataFrame:
    """One row on a run: its system, how many records it has, a hash of them whatever their order, and its settings."""
    rows = records.select(F.xxhash64(*records.columns).cast("decimal(38,0)").alias("h"))
    one = rows.agg(F.count(F.lit(1)).alias("n_records"), F.sha2(F.coalesce(F.sum("h"), F.lit(0)).cast("string"), 256).alias("records_hash"))
    return one.select(F.lit(system).alias("system"), "n_records", "records_hash", F.create_map(*[F.lit(x) for kv in sorted(settings.items()) for x in kv]).alias("settings"), F.lit(spark.version).alias("engine"))


def reach_facts(closure: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, from_col, to_col, reaches, hops): for each asked pair (from_col, to_col) whether a closure (root, node, depth) holds it, as a fact with an id of its own."""
    c = closure.select(F.col("root").alias("from_col"), F.col("node").alias("to_col"), F.col("depth").alias("hops"))
    held = pairs.select("from_col", "to_col").distinct().join(c, ["from_col", "to_col"], "left")
    return held.select(content_id("r_", F.col("from_col"), F.col("to_col")).alias("id"), "from_col", "to_col", F.col("hops").isNotNull().alias("reaches"), "hops")


def pool_gaps(pools: DataFrame, need: DataFrame) -> DataFrame:
    """(bucket, n, need): buckets of questions with fewer than they need."""
    have = pools.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    return need.join(have, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "need").filter("n < need")


def inventory(columns: DataFrame, models: DataFrame, exposures: DataFrame, parts: DataFrame) -> DataFrame:
    """(node, kind) of a project's columns, models, exposures and named query parts, lower case; a name of two kinds has the first of these."""
    kinds = ((columns, "column_id", "column"), (models, "model", "model"), (exposures, "exposure", "exposure"), (parts, "part", "part"))
    rows = None
    for k, (df, c, kind) in enumerate(kinds):
        part = df.select(F.lower(c).alias("node"), F.lit(kind).alias("kind"), F.lit(k).alias("k"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("node").agg(F.min_by("kind", "k").alias("kind"))


def worst_first(report: DataFrame) -> DataFrame:
    """Models of a report (model, quality, ...) with what was read worst at the top."""
    rank = F.when(F.col("quality") == "FAILED", 0).when(F.col("quality") == "FULL", 2).otherwise(1)
    return report.orderBy(rank, "model")


def badges(runs: DataFrame) -> DataFrame:
    """(run, verdict, checked): what an answer says (yes, no, found, refused, error) and how its claims stood up (all, some, none, no claims)."""
    verdict = F.when(F.col("error").isNotNull(), "error").when(F.col("refused"), "refused").otherwise(F.coalesce("reach_verdict", F.lit("found")))
    checked = F.when(F.col("n_claims") == 0, "no claims").when(F.col("n_failed") == 0, "all").when(F.col("n_failed") < F.col("n_claims"), "some").otherwise("none")
    return runs.select("run", verdict.alias("verdict"), checked.alias("checked"))
