"""Best-fit packing planned on a histogram of lengths.

The plan looks at counts per length only (at most ``capacity`` numbers, however
many documents there are): best-fit decreasing takes whole groups of equal bins
at a time. It yields slots (length, first rank, count, first sequence, offset);
documents take them by their rank within their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tributary.llm.common import partitions, prepare, stored
from tributary.llm.tokens import word_ids

CAPACITY = 2048
END_ID = 0


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first_rank, count, first_sequence, offset), ranks from 0 within each length.

    Best fit, longest first: an item goes to the open bin with the least room
    that still holds it. Bins filled alike form a group that is only split, so
    work and slots follow the number of lengths, not of items.
    """
    slots = []
    rooms: dict[int, list[tuple[int, int]]] = {}  # room left -> groups (first sequence, bins)
    next_sequence = 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit {capacity}")
        for room in sorted(r for r in rooms if r >= length):
            pending = rooms.pop(room)
            while left and room >= length:  # bins of this room, filled as often as they take the length
                taken, over = [], []
                for first, bins in pending:
                    n = min(bins, left)
                    if n:
                        slots.append((length, rank, n, first, capacity - room))
                        rank, left = rank + n, left - n
                        taken.append((first, n))
                    if bins > n:
                        over.append((first + n, bins - n))
                if over:
                    rooms.setdefault(room, []).extend(over)
                pending, room = taken, room - length
            if pending and room:
                rooms.setdefault(room, []).extend(pending)
            if not left:
                break
        if left:
            each = capacity // length
            for bins, items in ((left // each, each), (1 if left % each else 0, left % each)):
                if bins:
                    for i in range(items):
                        slots.append((length, rank, bins, next_sequence, i * length))
                        rank += bins
                    if capacity - items * length:
                        rooms.setdefault(capacity - items * length, []).append((next_sequence, bins))
                    next_sequence += bins
    return slots


def _piece_rows(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(path, True)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            owner, piece, start, length, ids = [], [], [], [], []
            tokens, starts = encoder.ids(batch.column(1))
            for row, (a, b) in enumerate(zip(starts.tolist(), starts[1:].tolist(), strict=False)):
                data, n = tokens[a:b].tobytes() + end, b - a + 1
                edges = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for k, (x, y) in enumerate(zip(edges, edges[1:], strict=False)):
                    owner.append(row)
                    piece.append(k)
                    start.append(x)
                    length.append(y - x)
                    ids.append(data[4 * x : 4 * y])
            cols = [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "piece", "start", "length", "ids"])

    return run


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, ids): each document's ids and id 0, cut where longer than ``capacity``.

    ``ids`` holds little-endian unsigned 32-bit ids. The first piece is the one
    that may be shorter. Null and empty texts give one piece of length 1. Rows
    that repeat, and rows without an id, give pieces like any other.
    """
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(_piece_rows(tokenizer, capacity), f"id {kind}, piece int, start long, length long, ids binary")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` from 1 to ``capacity``; other columns ride along.

    Ranks within a length come from two steps: within a part of the rows (dealt
    by a hash, so a common length is shared by all tasks), and the sum of the
    counts of earlier parts. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    names = pieces.columns
    rows = stored(pieces.select(F.struct(*names).alias("row"), F.col("length").alias("len"), F.monotonically_increasing_id().alias("at")), "pieces")
    parts = partitions(spark)
    # Ids of rows in the stored table are values, so the deal and the ranks stay the same however often a task runs.
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("at"), F.lit(parts)))
    counts = stored(dealt.groupBy("len", "part").agg(F.count(F.lit(1)).alias("n")), "lengths")
    totals = {r["len"]: r["n"] for r in counts.groupBy("len").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    slots = plan(totals, capacity)
    before = Window.partitionBy("len").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("len", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = dealt.withColumn("r", F.row_number().over(Window.partitionBy("len", "part").orderBy("at")) - 1).join(bases.hint("merge"), ["len", "part"])
    schema = "slot_len long, first_rank long, n long, first_sequence long, slot_offset long"
    planned = spark.createDataFrame(slots, schema)
    rank = F.col("base") + F.col("r")
    # The plan's rows follow the number of lengths, so its size is bounded by the capacity.
    hit = (F.col("len") == F.col("slot_len")) & (rank >= F.col("first_rank")) & (rank < F.col("first_rank") + F.col("n"))
    placed = ranked.join(F.broadcast(planned), hit)
    return placed.select("row.*", (F.col("first_sequence") + rank - F.col("first_rank")).alias("sequence_id"), F.col("slot_offset").alias("offset"))


def packed_report(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The contract's columns, one row per piece."""
    pieces = token_pieces(docs, tokenizer).select(F.col("id").alias("doc_id"), "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(pieces)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids) of packed pieces that carry ``ids``: at most ``capacity`` tokens each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "id", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"), F.expr("transform(p, x -> x.id)").alias("doc_ids"))


def check_no_overlap(pieces: Iterator[tuple[int, int, int]], capacity: int = CAPACITY) -> int:
    """Number of sequences of (sequence_id, offset, length) rows; raises where they overlap, leave gaps or overflow."""
    by: dict[int, list[tuple[int, int]]] = {}
    for s, o, n in pieces:
        by.setdefault(s, []).append((o, n))
    for s, parts in by.items():
        at = 0
        for o, n in sorted(parts):
            if o != at:
                raise ValueError(f"sequence {s}: a piece at {o}, expected at {at}")
            at += n
        if at > capacity:
            raise ValueError(f"sequence {s} holds {at}")
    return len(by)
