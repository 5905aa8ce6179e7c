"""Substring dedup by sliding spans of sentences.

A text is cut after the least word of every ``WINDOW`` words in a row: ends of
sentences and lines come first, then the words' own hashes decide. So pieces
have ``WINDOW`` words at most (the first and last up to twice as many), and the
cuts inside a passage, but for its outer ``WINDOW`` words, don't depend on what
surrounds it: each passage of over 50 words holds a run. Every run of
several consecutive pieces that reaches a number of words is hashed, the hashes
meet in one global sort, and pieces covered by a repeated run go, unless
the run is its first occurrence (smallest document id, then position).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tributary.llm.common import claim, partitions, prepare, stored

#: A run has at least this many pieces and words.
MIN_PIECES, MIN_WORDS = 2, 20
#: Words in a row of which one at least ends a piece; 4 * WINDOW + MIN_WORDS - 3 words in a row hold a run.
WINDOW = 8

_WORD = re.compile(r"\s*\S+\s*")
_BASES = tuple(np.uint64(b) for b in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
_INVERSES = tuple(np.uint64(pow(int(b), -1, 2**64)) for b in _BASES)


def pieces(text: str) -> tuple[list[int], list[int], list[int]]:
    """(ends, words, hashes): where each piece ends in the text, its words and the hash of them.

    Pieces follow each other without gaps; trailing white space belongs to a piece.
    """
    digest, size = xxhash.xxh3_64_intdigest, len(text)
    spans = [(m.group(), m.end()) for m in _WORD.finditer(text)]
    tokens = [x.strip() for x, _ in spans]
    n = len(tokens)
    cuts: list[int] = []  # words that end a piece
    if n > WINDOW:
        # White space at the outer border of a passage can differ, so can its last word's rank.
        later = [x[-1] not in ".!?" and "\n" not in y[len(y.rstrip()) :] for x, (y, _) in zip(tokens, spans, strict=True)]
        rank = np.array([digest(x) for x in tokens], np.uint64) >> np.uint64(1) | np.array(later, np.uint64) << np.uint64(63)
        least = np.lib.stride_tricks.sliding_window_view(rank, WINDOW)[:, ::-1].argmin(axis=1)
        cuts = np.unique(np.arange(n - WINDOW + 1) + WINDOW - 1 - least).tolist()
    if not cuts or cuts[-1] < n - 1:
        cuts.append(n - 1)
    starts = [0, *(c + 1 for c in cuts[:-1])]
    ends = [spans[c][1] for c in cuts[:-1]] + [size]
    return ends, [c + 1 - a for a, c in zip(starts, cuts, strict=True)], [digest(" ".join(tokens[a : c + 1])) for a, c in zip(starts, cuts, strict=True)]


def runs(words: list[int], min_pieces: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last piece of each run: the shortest that starts at each piece, and that ends at each."""
    n = len(words)
    if n < min_pieces:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.concatenate([[0], np.cumsum(words)])
    k = np.arange(n)
    last = np.maximum(np.searchsorted(before, before[:-1] + min_words) - 1, k + min_pieces - 1)
    first = np.minimum(np.searchsorted(before, before[1:] - min_words, side="right") - 1, k - min_pieces + 1)
    a, b = np.concatenate([k[last < n], first[first >= 0]]), np.concatenate([last[last < n], k[first >= 0]])
    both = np.unique(a * n + b)
    return both // n, both % n


def run_hashes(hashes: list[int], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each run, from prefix sums of the pieces' hashes times powers of an odd base."""
    h = np.array(hashes, np.uint64)
    out = []
    for base, inverse in zip(_BASES, _INVERSES, strict=True):
        ones = np.ones(1, np.uint64)
        up = np.cumprod(np.concatenate([ones, np.full(len(h) - 1, base)]))
        down = np.cumprod(np.concatenate([ones, np.full(len(h) - 1, inverse)]))
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up)])
        x = (prefix[b + 1] - prefix[a]) * down[a] + (b - a + 1).astype(np.uint64)
        x ^= x >> np.uint64(31)
        out.append(x * _BASES[1])
    return out[0], out[1]


def _span_rows(min_pieces: int, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("sentence_dedup", dict)
        for batch in batches:
            cols: list[list[np.ndarray]] = [[] for _ in range(6)]
            for row, text in enumerate(batch.column(1).to_pylist()):
                ends, words, hashes = pieces(text or "")
                a, b = runs(words, min_pieces, min_words)
                if not len(a):
                    continue
                h, g = run_hashes(hashes, a, b)
                g = (g >> np.uint64(32)).astype(np.uint32).view(np.int32)
                order = np.lexsort((a, g, h))
                again = np.zeros(len(a), bool)
                s = (h[order][1:] == h[order][:-1]) & (g[order][1:] == g[order][:-1])
                again[order[1:]] = s
                e = np.array([0, *ends], np.int32)
                for c, v in zip(cols, (np.full(len(a), row), h.view(np.int64), g, e[a], e[b + 1], again), strict=True):
                    c.append(v)
            if cols[0]:
                row, h, g, start, end, again = (np.concatenate(c) for c in cols)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *map(pa.array, (h, g, start, end, again))], ["id", "h", "g", "start", "end", "again"])

    return run


def _not_first(keys: int):
    """Rows (``keys`` columns, id, start, end, again, ...) in order of the keys and id: adds ``other``, whether a run isn't of its keys' smallest id or comes again in a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = None  # a row of one: keys and smallest id of the last keys
        for batch in batches:
            if not len(batch):
                continue
            cols = [batch.column(i).to_numpy() for i in range(keys)]
            ids = batch.column(keys)
            if lead is not None:
                cols = [np.concatenate([old, new]) for old, new in zip(lead[0], cols, strict=True)]
                ids = pa.concat_arrays([lead[1], ids])
            n = np.arange(len(ids))
            new = np.ones(len(ids), bool)
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
            heads = np.maximum.accumulate(np.where(new, n, 0))
            other = pc.not_equal(ids, ids.take(pa.array(heads))).slice(len(ids) - len(batch))
            lead = [c[-1:] for c in cols], ids.take(pa.array(heads[-1:]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pc.or_(other, batch.column(keys + 3))], [*batch.schema.names, "other"])

    return run


#: Of so many documents the runs of one are counted to find hashes of many rows, and the rows of a hash that one task may always sort.
COUNTED_ONE_IN, SORTED_TOGETHER = 32, 20_000


def _later(spans: DataFrame, some: DataFrame, kind: str) -> DataFrame:
    """(id, start, end) of the runs that aren't their hash's first occurrence.

    A hash of many rows (a very common passage; estimated from ``some``, which
    decides the deal and never the result) is dealt out by the documents' hashes:
    rows that aren't first in their own deal are later for sure, and only the
    first documents of the deals meet.
    """
    spark = spans.sparkSession
    counts = stored(some.groupBy("h").agg((F.count(F.lit(1)) * COUNTED_ONE_IN).alias("n")), "counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    deals = partitions(spark)
    hot = stored(counts.filter(F.col("n") > max(SORTED_TOGETHER, total // (4 * deals))).select("h", F.lit(True).alias("hot")), "hot")  # at most 4 x partitions hashes
    row = f"h long, g int, id {kind}, start int, end int, again boolean"
    if hot.isEmpty():
        found = spans.repartition("h").sortWithinPartitions("h", "g", "id").select("h", "g", "id", "start", "end", "again").mapInArrow(_not_first(2), f"{row}, other boolean")
        return found.filter("other").select("id", "start", "end")
    dealt = spans.join(F.broadcast(hot), "h", "left").withColumn("deal", F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(deals))).otherwise(0).cast("int"))
    keys = ["h", "g", "deal"]
    first = dealt.select(*keys, "id", "start", "end", "again", F.coalesce("hot", F.lit(False)).alias("hot")).repartition("h", "deal").sortWithinPartitions(*keys, "id")
    told = stored(first.mapInArrow(_not_first(3), f"h long, g int, deal int, id {kind}, start int, end int, again boolean, hot boolean, other boolean").filter("other or hot"), "told")
    open_ = told.filter("not other").select("h", "g", "id", "start", "end", "again").repartition("h").sortWithinPartitions("h", "g", "id")
    late = open_.mapInArrow(_not_first(2), f"{row}, other boolean").filter("other")
    return told.filter("other").select("id", "start", "end").unionByName(late.select("id", "start", "end"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_pieces: int = MIN_PIECES, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, start, end): characters of each repeated run that isn't its first occurrence, merged within a text.

    Null and empty texts have none. Rows without an id take no part; rows that
    repeat an id are one document.
    """
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col))
    spans_of = lambda some: some.mapInArrow(_span_rows(min_pieces, min_words), f"id {kind}, h long, g int, start int, end int, again boolean")
    found = _later(spans_of(rows), spans_of(rows.filter(F.pmod(F.xxhash64("id"), F.lit(COUNTED_ONE_IN)) == 0)), kind)
    w = Window.partitionBy("id").orderBy("start", "end")
    reached = F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    opened = found.withColumn("opens", (F.col("start") > reached).cast("int"))
    islands = opened.withColumn("island", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def without_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, text, removed): each row of ``docs`` as a struct, its text without the spans, and the spans cut."""
    cuts = spans.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts")).withColumnRenamed("id", "cut_id")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("key"))
    held = rows.join(cuts, F.col("key") == F.col("cut_id"), "left")
    text = F.col("row").getField(text_col)
    # Kept stretches run from each cut's end to the next cut's start.
    starts = F.concat(F.array(F.lit(0)), F.transform("cuts", lambda c: c["end"]))
    ends = F.concat(F.transform("cuts", lambda c: c["start"]), F.array(F.char_length(text)))
    kept = F.zip_with(starts, ends, lambda s, e: F.substring(text, s + 1, e - s))
    return held.select("row", F.when(F.col("cuts").isNull(), text).otherwise(F.array_join(kept, "")).alias("new_text"), F.coalesce("cuts", F.array().cast("array<struct<start:int,end:int>>")).alias("removed"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every repeated span but its first cut from the text; all rows and columns stay.

    A text made of repeated spans only becomes empty. ``n_chars`` follows the
    new text where the table has such a column.
    """
    cut = without_spans(docs, repeated_spans(docs, id_col, text_col), id_col, text_col)
    new = {text_col: F.col("new_text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.size("removed") == 0, F.col("row.n_chars")).otherwise(F.char_length("new_text").cast(kind))
    return cut.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def substring_report(docs: DataFrame) -> DataFrame:
    """One row per document: its new text and the spans (start, end in characters) that were cut."""
    cut = without_spans(docs.select("doc_id", "text"), repeated_spans(docs))
    return cut.select("row.doc_id", F.col("new_text").alias("text"), (F.size("removed") > 0).alias("changed"), "removed", F.coalesce(F.aggregate("removed", F.lit(0), lambda a, x: a + x["end"] - x["start"]), F.lit(0)).alias("n_removed"))
