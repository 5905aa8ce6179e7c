"""Search chunks of a project: cards of columns, segments of models, descriptions and sections, each with the lines that it cites."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.functions.text import content_id
from tributary.operators.chunks import segments


def column_cards(catalog: DataFrame, declared: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(model, column, text, n_in, n_out): one card for each column that the catalog (model, column, type) or a declaration (model, column, description) knows.

    Graph facts ride beside the text and are no part of what is searched.
    """
    c = catalog.select(F.lower("model").alias("model"), F.lower("column").alias("column"), "type").distinct()
    d = declared.select(F.lower("model").alias("model"), F.lower("column").alias("column"), "description").groupBy("model", "column").agg(F.max("description").alias("description"))
    both = c.join(d, ["model", "column"], "full")
    kind, said = F.coalesce(F.concat(F.lit(" ("), "type", F.lit(")")), F.lit("")), F.coalesce(F.concat(F.lit(": "), F.nullif(F.trim("description"), F.lit(""))), F.lit(""))
    cards = both.select("model", "column", F.concat(F.lit("column "), "model", F.lit("."), "column", kind, said).alias("text"))
    if edges is None:
        return cards.withColumns({"n_in": F.lit(0).cast("long"), "n_out": F.lit(0).cast("long")})
    e = edges.select("from", "to").distinct()
    ends = e.select(F.col("to").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(e.select(F.col("from").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    facts = ends.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))
    held = cards.join(facts, F.col("node") == F.concat_ws(".", "model", "column"), "left").drop("node")
    return held.withColumns({n: F.coalesce(n, F.lit(0).cast("long")) for n in ("n_in", "n_out")})


def parser_only(edges: DataFrame, cards: DataFrame) -> DataFrame:
    """(model, n): columns that only the walk over the models knows, per model."""
    made = edges.select(F.col("to").alias("id")).distinct().join(cards.select(F.concat_ws(".", "model", "column").alias("id")), "id", "left_anti")
    return made.groupBy(F.substring_index("id", ".", 1).alias("model")).agg(F.count(F.lit(1)).alias("n"))


def model_segments(models: DataFrame) -> DataFrame:
    """(model, label, first_line, last_line, text) of (model, sql): the parts between the model's named queries."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for m, sql in zip(f["model"], f["sql"], strict=True):
                lines = (sql or "").split("\n")
                rows += [(m, label, a, b, "\n".join(lines[a - 1 : b])) for a, b, label in segments(sql or "")]
            yield pd.DataFrame(rows, columns=["model", "label", "first_line", "last_line", "text"])

    return models.select("model", "sql").mapInPandas(run, "model string, label string, first_line int, last_line int, text string")


def sections(docs: DataFrame) -> DataFrame:
    """(id, part, title, first_line, last_line, text) of (id, text): a part for each heading line, and one for what stands before the first."""
    rows = docs.select("id", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("head", F.col("line").rlike(r"^#{1,6}\s").cast("int"))
    w = Window.partitionBy("id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    parts = rows.withColumn("part", F.sum("head").over(w)).groupBy("id", "part").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("ls"))
    text = F.array_join(F.transform("ls", lambda x: x["line"]), "\n")
    title = F.when(F.col("part") > 0, F.regexp_replace(F.col("ls")[0]["line"], r"^#+\s*", "")).otherwise("")
    out = parts.select("id", "part", title.alias("title"), (F.col("ls")[0]["n"] + 1).alias("first_line"), (F.element_at("ls", -1)["n"] + 1).alias("last_line"), text.alias("text"))
    return out.filter(F.trim("text") != "")


def project_chunks(**kinds: DataFrame) -> DataFrame:
    """(id, kind, owner, text) of tables (owner, text), one for each kind; equal chunks are one."""
    rows = [df.select(F.lit(k).alias("kind"), "owner", "text") for k, df in kinds.items()]
    every = reduce(DataFrame.unionByName, rows).filter(F.trim("text") != "").distinct()
    return every.select(content_id("c_", F.col("kind"), F.col("owner"), F.col("text")).alias("id"), "kind", "owner", "text")


def of_kinds(chunks: DataFrame, *kinds: str) -> DataFrame:
    """The chunks of some kinds; of all, where none is named."""
    return chunks.filter(F.col("kind").isin(*kinds)) if kinds else chunks


def entry_lines(text: str, *path: str) -> tuple[int, int] | None:
    """Lines (first, last) of a YAML entry: list items are named by their ``name``, other steps by their key, each within the one before."""
    rows = text.split("\n")
    first, last, depth = 0, len(rows), -1
    for step in path:
        found = None
        for i in range(first, last):
            m = re.match(r"(\s*)(-\s+)?(?:name:\s*)?[\"']?([\w.]+)[\"']?\s*(:?)", rows[i])
            if not m or len(m[1]) <= depth or m[3] != step or not (m[4] or "name:" in rows[i]):
                continue
            found, depth = i, len(m[1])
            break
        if found is None:
            return None
        first = found
        last = next((j for j in range(found + 1, last) if rows[j].strip() and len(rows[j]) - len(rows[j].lstrip()) <= depth and not (depth == 0 and rows[j].startswith("- ") and not rows[found].lstrip().startswith("-"))), last)
    while last > first + 1 and not rows[last - 1].strip():
        last -= 1
    return first + 1, last


def cited(chunks: DataFrame, entries: DataFrame, seeds: DataFrame, models: DataFrame) -> DataFrame:
    """Adds (file, first_line, last_line, level) to (id, kind, owner): a declared entry's lines, else a seed's header, else the model's whole text.

    ``entries`` is (owner, file, first_line, last_line), ``seeds`` (model, file) and
    ``models`` (model, file, n_lines). Null where none is known.
    """
    model = F.substring_index("owner", ".", 1)
    e = entries.select("owner", F.struct("file", "first_line", "last_line", F.lit("entry").alias("level")).alias("by_entry"))
    s = seeds.select(F.col("model").alias("m1"), F.struct("file", F.lit(1).alias("first_line"), F.lit(1).alias("last_line"), F.lit("header").alias("level")).alias("by_seed"))
    w = models.select(F.col("model").alias("m2"), F.struct("file", F.lit(1).alias("first_line"), F.col("n_lines").cast("int").alias("last_line"), F.lit("model").alias("level")).alias("by_model"))
    held = chunks.join(e, "owner", "left").join(s, model == F.col("m1"), "left").join(w, model == F.col("m2"), "left")
    return held.select(*[held[c] for c in chunks.columns], F.coalesce("by_entry", "by_seed", "by_model").alias("at")).select(*chunks.columns, "at.*")


def holds_owner(text: Column, owner: Column) -> Column:
    """Whether a cited text holds the last part of an owner's name as a word."""
    return F.regexp_like(F.lower(text), F.concat(F.lit(r"(^|[^\w])"), F.lower(F.substring_index(owner, ".", -1)), F.lit(r"($|[^\w])")))


def citation_audit(cited_texts: DataFrame) -> DataFrame:
    """(kind, n, n_held) of (kind, owner, cited): how many citations hold what they are about."""
    return cited_texts.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(holds_owner(F.col("cited"), F.col("owner")), F.lit(False))).alias("n_held"))


def level_counts(edges: DataFrame) -> DataFrame:
    """(level, n, percent) of cited edges."""
    n = edges.groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(edges.agg(F.count(F.lit(1)).alias("total"))).select("level", "n", F.round(100 * F.col("n") / F.col("total"), 2).alias("percent"))  # one row


def hits(found: DataFrame, chunks: DataFrame, clip: int = 600) -> DataFrame:
    """(qid, rank, id, kind, owner, text, clipped): what a search shows of its hits."""
    text = F.col("text")
    cut = F.length(text) > clip
    return found.select("qid", "id", "rank").join(chunks, "id").select("qid", "rank", "id", "kind", "owner", F.when(cut, F.concat(F.substring(text, 1, clip), F.lit("…"))).otherwise(text).alias("text"), cut.alias("clipped"))
