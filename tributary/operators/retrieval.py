"""Search: BM25, exact vector search, a hashed embedder and rank fusion, over DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tributary.functions.text import search_tokens
from tributary.tables import written

K1, B = 1.5, 0.75
RRF_K, DEPTH = 60, 100
DIM = 64
#: A document without a token has this one, so it counts in the average length.
EMPTY = "\u0000empty"


def bm25(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, id, score): every document with a score above zero for each of (qid, text).

    Lucene's variant: idf ln(1 + (N - df + 0.5) / (df + 0.5)), tf over tf + k1 (1 - b + b dl / avgdl);
    a token that a query repeats counts as often.
    """
    asked = queries.select("qid", F.explode(search_tokens(F.col("text"))).alias("token")).groupBy("qid", "token").agg(F.count(F.lit(1)).alias("times"))
    rows = token_table(docs)
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    # Only tokens that a query has are counted per document, so only they are shuffled.
    opened = rows.select("id", "dl", F.explode("toks").alias("token"))
    terms = written(opened.join(asked.select("token").distinct(), "token").groupBy("id", "dl", "token").agg(F.count(F.lit(1)).alias("tf")), "terms")
    df = terms.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    hits = terms.join(asked.join(df, "token"), "token").crossJoin(F.broadcast(totals))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("times") * idf * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("qid", "id").agg(F.sum(part).alias("score")).filter("score > 0")


def token_table(docs: DataFrame) -> DataFrame:
    """(id, toks, dl), written: the index of a search, each text tokenised once."""
    rows = docs.select("id", search_tokens(F.col("text")).alias("toks"))
    filled = F.when(F.size("toks") == 0, F.array(F.lit(EMPTY))).otherwise(F.col("toks"))
    return written(rows, "tokens").select("id", filled.alias("toks"), F.greatest(F.size("toks"), F.lit(1)).alias("dl"))


def top(scores: DataFrame, k: int) -> DataFrame:
    """Adds ``rank`` from 1 by score (rounded, so that ties are ties), then id, and keeps the first k of each query."""
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "id")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def dense_top(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, rank) by cosine, exact: each task scans its rows in blocks against all queries and keeps the best k.

    The query set goes to every task: it is stated, and refused above 100,000 numbers per dimension.
    """
    asked = queries.select("qid", "vector").collect()
    if len(asked) > 100_000:
        raise ValueError("too many queries for one scan")
    qid = [r["qid"] for r in asked]
    q = np.array([r["vector"] for r in asked], np.float64).reshape(len(asked), -1)
    q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in ("id",)} | {"qid": queries.schema["qid"].dataType.simpleString()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), np.float64).reshape(len(batch), -1)
            if not len(x) or not len(q):
                continue
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            s = q @ x.T
            n = min(k, len(x))
            # One more than k where scores tie at the cut is settled by the global order, so keep all ties.
            cut = -np.partition(-s, n - 1, axis=1)[:, n - 1 : n]
            a, b = np.nonzero(s >= cut - 1e-9)
            yield pa.RecordBatch.from_arrays([pa.array([qid[i] for i in a]), batch.column(0).take(pa.array(b)), pa.array(s[a, b])], ["qid", "id", "score"])

    found = vectors.select("id", "vector").mapInArrow(run, f"qid {kinds['qid']}, id {kinds['id']}, score double")
    return top(found, k)


def hashed_vectors(docs: DataFrame, dim: int = DIM) -> DataFrame:
    """(id, vector): a hashed bag of words of unit length; each word adds or takes one in its bucket."""
    words = docs.select("id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0))).alias("w"))
    h = F.conv(F.substring(F.sha1("w"), 1, 8), 16, 10).cast("long")
    cells = words.select("id", (h % dim).cast("int").alias("cell"), F.when(F.shiftright(h, 8) % 2 == 1, 1.0).otherwise(-1.0).alias("one"))
    sums = cells.groupBy("id", "cell").agg(F.sum("one").alias("v")).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("cell", "v"))).alias("m"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    value = lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)) / F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0)
    return sums.select("id", F.array(*[value(i) for i in range(dim)]).alias("vector"))


def rrf(*lists: DataFrame, k: int = RRF_K, depth: int = DEPTH) -> DataFrame:
    """(qid, id, score): reciprocal rank fusion of ranked lists (qid, id, rank)."""
    every = None
    for ranked in lists:
        part = ranked.filter(F.col("rank") <= depth).select("qid", "id", (1.0 / (k + F.col("rank"))).alias("part"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("qid", "id").agg(F.sum("part").alias("score"))


def both_lists(docs: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first ``DEPTH`` documents of each query by BM25, and by the cosine of hashed vectors."""
    asked = hashed_vectors(queries.select(F.col("qid").alias("id"), "text")).select(F.col("id").alias("qid"), "vector")
    return top(bm25(docs, queries), DEPTH), dense_top(hashed_vectors(docs), asked, DEPTH)


def hybrid(docs: DataFrame, queries: DataFrame, k: int = 8) -> DataFrame:
    """(qid, id, score, rank) of BM25 and hashed vectors fused."""
    return top(rrf(*both_lists(docs, queries)), k)


def windows(docs: DataFrame, lines: int = 40) -> DataFrame:
    """(id, part, first_line, last_line, chunk): texts in windows of lines, never cut inside one."""
    rows = docs.select("id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    parts = rows.groupBy("id", F.floor(F.col("n") / lines).cast("int").alias("part")).agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("ls"))
    return parts.select("id", "part", (F.col("ls")[0]["n"] + 1).alias("first_line"), (F.element_at("ls", -1)["n"] + 1).alias("last_line"), F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("chunk"))


def recall_at(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """The share of (qid, id) gold pairs that stand among the first k."""
    hit = gold.join(ranked.filter(F.col("rank") <= k).select("qid", "id", F.lit(1.0).alias("hit")), ["qid", "id"], "left")
    return hit.agg(F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 6).alias("recall"))
