"""Exact dedup by composable polynomial fingerprints and chunkwise comparison.

A text's fingerprint is its polynomial hash modulo two primes over the
normalised UTF-8 bytes, together with its length. Fingerprints compose:
``hash(xy) = hash(x) * B**len(y) + hash(y)``, so the chunks of a huge text are
hashed by different tasks and combined in any grouping. Texts with equal
fingerprints are then compared chunk by chunk with the group's first text; a
text that differs (a collision) goes into a further round, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import claim, handed, prepare, squeezed, stored

PRIMES = (2147483647, 2147483629)
BASE = 1_000_003
#: Bytes hashed by one dot product: terms stay below 2**64.
CHUNK = 4096
#: Texts above this go to tasks in slices of this many bytes.
SLICE = 8 << 20
#: Members of a fingerprint group that one copy of its first text serves.
PER_SALT = 256
#: Bytes compared at once.
COMPARE = 64 << 10


def _powers(prime: int) -> np.ndarray:
    out = np.empty(CHUNK, np.uint64)
    x = 1
    for i in range(CHUNK - 1, -1, -1):
        out[i] = x
        x = x * BASE % prime
    return out


_POWERS = [_powers(p) for p in PRIMES]
_SHIFTS = [pow(BASE, CHUNK, p) for p in PRIMES]


def combine(left: tuple[int, int, int], right: tuple[int, int, int]) -> tuple[int, int, int]:
    """Fingerprint of two texts one after the other, from (h1, h2, bytes) of each."""
    h = [(x * pow(BASE, right[2], p) + y) % p for x, y, p in zip(left[:2], right[:2], PRIMES, strict=True)]
    return h[0], h[1], left[2] + right[2]


def fingerprint(data: bytes) -> tuple[int, int, int]:
    """(h1, h2, bytes) of one text, hashing its chunks together and combining them in order."""
    raw = np.frombuffer(data, np.uint8).astype(np.uint64)
    raw += np.uint64(1)
    whole = len(raw) // CHUNK
    out = []
    for p, powers, shift in zip(PRIMES, _POWERS, _SHIFTS, strict=True):
        h = 0
        if whole:
            for x in (raw[: whole * CHUNK].reshape(whole, CHUNK) @ powers).tolist():
                h = (h * shift + x) % p
        tail = raw[whole * CHUNK :]
        if len(tail):
            h = (h * pow(BASE, len(tail), p) + int(tail @ powers[CHUNK - len(tail) :])) % p
        out.append(h)
    return out[0], out[1], len(raw)


def _hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the last column (binary) by h1, h2, bytes and the shifts s1, s2 that a text before it needs."""
    claim("exact_dedup", dict)
    for batch in batches:
        marks = [fingerprint(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
        marks = [(*m, *(pow(BASE, m[2], p) for p in PRIMES)) for m in marks]
        cols = [batch.column(i) for i in range(batch.num_columns - 1)]
        cols += [pa.array([m[i] for m in marks], pa.int64()) for i in range(5)]
        yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names[:-1], "h1", "h2", "bytes", "s1", "s2"])


def fingerprints(texts: DataFrame) -> DataFrame:
    """(id, sha, raw_bytes, data binary) -> (id, sha, h1, h2, bytes), one row per row.

    Texts above ``SLICE`` bytes are dealt out in slices, hashed in parallel and
    combined by length-shifted arithmetic. ``raw_bytes`` is an upper bound of
    the bytes of ``data``; short texts are never looked at for slices.
    """
    kind = texts.schema["id"].dataType.simpleString()
    marks = "h1 long, h2 long, bytes long, s1 long, s2 long"
    small = texts.filter(f"raw_bytes <= {SLICE}").select("id", "sha", "data").mapInArrow(_hash_rows, f"id {kind}, sha string, {marks}").drop("s1", "s2")
    slices = F.greatest(F.lit(1), F.ceil(F.octet_length("data") / F.lit(SLICE)).cast("int"))
    sliced = (
        texts.filter(f"raw_bytes > {SLICE}")
        .select("id", "sha", F.monotonically_increasing_id().alias("row"), "data")
        .select("id", "sha", "row", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"), "data")
        .select("id", "sha", "row", "slice", F.col("data").substr(F.col("slice") * SLICE + 1, F.lit(SLICE)).alias("data"))
        .repartition(F.col("row"), F.col("slice"))
        .mapInArrow(_hash_rows, f"id {kind}, sha string, row long, slice int, {marks}")
    )

    def joined(i: int):
        zero, p = F.lit(0).cast("long"), F.lit(PRIMES[i])
        return F.aggregate("parts", zero, lambda acc, x: (acc * x[f"s{i + 1}"] + x[f"h{i + 1}"]) % p).alias(f"h{i + 1}")

    huge = (
        sliced.groupBy("id", "sha", "row")
        .agg(F.array_sort(F.collect_list(F.struct("slice", "h1", "h2", "bytes", "s1", "s2"))).alias("parts"))
        .select("id", "sha", joined(0), joined(1), F.aggregate("parts", F.lit(0).cast("long"), lambda acc, x: acc + x["bytes"]).alias("bytes"))
    )
    return small.unionByName(huge)


def same(left: bytes, right: bytes) -> bool:
    """Chunkwise comparison that ends at the first chunk that differs."""
    if len(left) != len(right):
        return False
    return all(left[i : i + COMPARE] == right[i : i + COMPARE] for i in range(0, len(left), COMPARE))


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (h1, h2, bytes, salt, first the group's text): one text is held at a time."""
    key, held = None, b""
    for batch in batches:
        h1, h2, size, salt, member, data = (batch.column(i) for i in (0, 1, 2, 3, 4, 5))
        equal, keep = [], []
        for i, (row, is_member) in enumerate(zip(zip(h1.to_pylist(), h2.to_pylist(), size.to_pylist(), salt.to_pylist(), strict=True), member.to_pylist(), strict=True)):
            if not is_member:
                key, held = row, data[i].as_py()
                continue
            keep.append(i)
            equal.append(row == key and same(held, data[i].as_py()))
        rows = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(i).take(rows) for i in (0, 1, 2, 6, 7)), pa.array(equal, pa.bool_())], ["h1", "h2", "bytes", "id", "sha", "equal"])


def _compared(members: DataFrame, texts: DataFrame) -> DataFrame:
    """members: (id, sha, h1, h2, bytes, first, first_sha, n), distinct. Adds ``equal`` to each, by its text."""
    kind = members.schema["id"].dataType.simpleString()
    m = members.withColumnsRenamed({"id": "mid", "sha": "msha"})
    own = texts.join(m, F.col("id").eqNullSafe(F.col("mid")) & (F.col("sha") == F.col("msha"))).drop("mid", "msha")
    salts = F.ceil(F.col("n") / PER_SALT).cast("int")
    place = lambda salt, member: F.struct(salt.cast("int").alias("salt"), F.lit(member).alias("member"))
    is_first = F.col("id").eqNullSafe(F.col("first")) & (F.col("sha") == F.col("first_sha"))
    copies = F.when(is_first, F.transform(F.sequence(F.lit(0), salts - 1), lambda s: place(s, False))).otherwise(F.array().cast("array<struct<salt:int,member:boolean>>"))
    dealt = own.withColumn("at", F.explode(F.concat(F.array(place(F.pmod(F.xxhash64("id", "sha"), salts), True)), copies)))
    return (
        dealt.select("h1", "h2", "bytes", "at.salt", "at.member", "data", "id", "sha")
        .repartition("h1", "h2", "bytes", "salt")
        .sortWithinPartitions("h1", "h2", "bytes", "salt", "member")
        .mapInArrow(_stream, f"h1 long, h2 long, bytes long, id {kind}, sha string, equal boolean")
    )


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of equal texts, one row per row of ``docs``.

    Returns (id, sha, keep_id, group_size): ``sha`` is the SHA-256 of the
    normalised text, ``keep_id`` the smallest id of the class. Null texts are
    empty texts. Null ids count in ``group_size`` and are the class's id only
    where it has no other. Rows that repeat id and text give a row each, of the
    same class. An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    norm = squeezed(F.col(text_col))
    raw = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).alias("raw_bytes")
    texts = docs.select(F.col(id_col).alias("id"), raw, norm.cast("binary").alias("data")).select("id", F.sha2("data", 256).alias("sha"), "raw_bytes", "data")
    all_rows = stored(fingerprints(texts), "fp")
    group = ["h1", "h2", "bytes"]
    counted = all_rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("id", "sha"), F.struct(F.col("id").isNull(), "id", "sha")).alias("lead"))
    total = all_rows.count()
    many = counted.filter("n > 1").select(*group, "n", F.col("lead.id").alias("first"), F.col("lead.sha").alias("first_sha"))
    open_rows = handed(all_rows, many, group, "n", total).select("id", "sha", *group, "first", "first_sha", "n").distinct()
    done, turn = [], 0
    while True:
        seen = stored(_compared(open_rows, texts), f"same{turn}")
        equal = seen.filter("equal").select("id", "sha", *group).distinct()
        done.append(equal.withColumn("turn", F.lit(turn)))
        other = seen.filter("not equal").select("id", "sha", *group).distinct()
        if other.isEmpty():
            break
        lead = other.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("id", "sha"), F.struct(F.col("id").isNull(), "id", "sha")).alias("lead"))
        lead = lead.select(*group, "n", F.col("lead.id").alias("first"), F.col("lead.sha").alias("first_sha"))
        open_rows, turn = stored(handed(other, lead, group, "n", total), f"open{turn}"), turn + 1
    if turn == 0:  # no two texts share a fingerprint without being equal
        return handed(all_rows, counted.select(*group, "n", F.col("lead.id").alias("keep_id")), group, "n", total).select("id", "sha", "keep_id", F.col("n").alias("group_size"))
    classes = reduce(DataFrame.unionByName, done).withColumnsRenamed({"id": "cid", "sha": "csha"}).drop(*group)
    tagged = all_rows.join(classes, F.col("id").eqNullSafe(F.col("cid")) & (F.col("sha") == F.col("csha")), "left").withColumn("turn", F.coalesce("turn", F.lit(0)))
    tagged = stored(tagged.select("id", "sha", *group, "turn"), "classes")
    sizes = tagged.groupBy(*group, "turn").agg(F.count(F.lit(1)).alias("group_size"), F.min("id").alias("keep_id"))
    return handed(tagged, sizes, [*group, "turn"], "group_size", total).select("id", "sha", "keep_id", "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of equal texts the one with the smallest id, with all their columns.

    Rows that repeat id and text count as one document and one of them stays.
    """
    keep = exact_classes(docs, id_col, text_col).filter(F.col("id").eqNullSafe(F.col("keep_id"))).select(F.col("id").alias("kid"), F.col("sha").alias("ksha")).distinct()
    rows = docs.select(F.col(id_col).alias("id"), F.sha2(squeezed(F.col(text_col)).cast("binary"), 256).alias("sha"), F.struct(*docs.columns).alias("row"))
    kept = rows.join(keep, F.col("id").eqNullSafe(F.col("kid")) & (F.col("sha") == F.col("ksha")))
    return kept.groupBy("id", "sha").agg(F.first("row").alias("row")).select("row.*")


def exact_dedup_report(docs: DataFrame) -> DataFrame:
    """The contract's columns, one row per document."""
    c = exact_classes(docs)
    return c.select(F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))
