"""Token-id files: frequency-ranked ids, variable length in whole bytes, control bytes apart.

A file holds blocks. A block (little-endian) is::

    magic "TID1", documents u32, values u32, control bytes u32, data bytes u32,
    doc ids i64[documents], starts i64[documents], lengths u32[documents],
    control bytes, data bytes, "\\n"

Values are ranks: rank 0 is the corpus's most frequent id. Two control bits per
value (four values a byte, lowest bits first) give its length less one, and the
data bytes follow little-endian. ``ranks`` beside the files lists the ids by
rank. Files are cut by ranges of the document id, and by their tokens where a
range holds many, and are named in their order.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.common import fresh_path, prepare
from tributary.llm.tokens import word_ids

MAGIC = b"TID1"
HEAD = struct.Struct("<4sIIII")
END_ID = 1
#: Documents of a range of ids, about, and tokens after which a range goes on in a further file: files are read whole, so this bounds a reader's memory (with the longest document).
DOCS_PER_FILE, TOKENS_PER_FILE = 8000, 1 << 25
#: Values in a block.
BLOCK = 1 << 19

#: For each control byte the lengths of its four values.
_LENGTHS = np.array([[(c >> (2 * i)) % 4 + 1 for i in range(4)] for c in range(256)], np.uint8)
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    v = values.astype("<u4")
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    codes[: len(v)] = size - 1
    control = codes.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values: lengths by table lookup, then one gather of four bytes a value."""
    size = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(size, dtype=np.int64)
    padded = np.frombuffer(data + b"\0\0\0", np.uint8)
    at = ends - size
    out = np.zeros(n, np.uint32)
    for i in range(4):
        out |= padded[at + i].astype(np.uint32) << np.uint32(8 * i)
    return out & _MASKS[size]


def write_block(docs: list[tuple[int, int, np.ndarray]]) -> bytes:
    """docs: (doc id, start, ranks)."""
    values = np.concatenate([d[2] for d in docs])
    control, data = encode_values(values)
    head = HEAD.pack(MAGIC, len(docs), len(values), len(control), len(data))
    cols = [np.array([d[0] for d in docs], "<i8"), np.array([d[1] for d in docs], "<i8"), np.array([len(d[2]) for d in docs], "<u4")]
    return b"".join([head, *(c.tobytes() for c in cols), control, data])


def read_blocks(content: memoryview) -> Iterator[tuple[int, int, np.ndarray]]:
    """(doc id, start, ranks) of each document of a file."""
    at = 0
    while at < len(content):
        magic, docs, values, controls, size = HEAD.unpack_from(content, at)
        if magic != MAGIC:
            raise ValueError(f"no block at byte {at}")
        at += HEAD.size
        ids = np.frombuffer(content, "<i8", docs, at)
        starts = np.frombuffer(content, "<i8", docs, at + 8 * docs)
        lengths = np.frombuffer(content, "<u4", docs, at + 16 * docs)
        at += 20 * docs
        ranks = decode_values(bytes(content[at : at + controls]), bytes(content[at + controls : at + controls + size]), values)
        at += controls + size + 1  # and the line's end
        place = 0
        for i, s, n in zip(ids.tolist(), starts.tolist(), lengths.tolist(), strict=True):
            yield i, s, ranks[place : place + n]
            place += n


def _tokenised(path: str, bounds: np.ndarray):
    """(id, text) -> (shard, id, n, ids as 16-bit where the vocabulary allows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(path, False)
        kind = np.dtype("<u2" if encoder.library.get_vocab_size() <= 1 << 16 else "<u4")
        end = np.array([END_ID], kind).tobytes()
        for batch in batches:
            tokens, starts = encoder.ids(batch.column(1))
            data, w = tokens.astype(kind).tobytes(), kind.itemsize
            blobs = [data[a * w : b * w] + end for a, b in zip(starts.tolist(), starts[1:].tolist(), strict=False)]
            shard = np.searchsorted(bounds, batch.column(0).to_numpy(zero_copy_only=False), side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shard), batch.column(0), pa.array([len(b) // w for b in blobs], pa.int64()), pa.array(blobs, pa.binary())], ["shard", "id", "n", "ids"])

    return run


def _offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``off``, the ids before a document in its shard, and the file of the shard that it is in, to rows sorted by shard and id."""
    shard, total = None, 0
    for batch in batches:
        off = []
        for s, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if s != shard:
                shard, total = s, 0
            off.append(total)
            total += n
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(off, pa.int64()), pa.array([x // TOKENS_PER_FILE for x in off], pa.int32())], ["shard", "id", "n", "ids", "off", "part"])


def _counted(kind: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["token", "n"])

    return run


def _blocks(kind: str, rank: np.ndarray, base: dict[int, int]):
    """(shard, part, id, off, ids) -> (shard, part, block); a block holds documents of one file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, values, file = [], 0, None

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in file), pa.array([write_block(held)], pa.binary())], ["shard", "part", "block"])

        for batch in batches:
            for s, part, i, off, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and ((s, part) != file or values >= BLOCK):
                    yield flush()
                    held, values = [], 0
                file = s, part
                held.append((i, base[s] + off, rank[np.frombuffer(ids, kind)]))
                values += len(held[-1][2])
        if held:
            yield flush()

    return run


def write_token_files(docs: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text") -> dict[int, int]:
    """Write the files under ``path`` in ascending id order; returns the ids before each shard.

    Null texts are empty (their one id is the end id). Rows without an id have
    no place in the order and are refused. Rows that repeat an id follow each
    other. An empty table gives no file.
    """
    from tokenizers import Tokenizer

    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    n, nulls = rows.agg(F.count(F.lit(1)), F.count_if(F.col("id").isNull())).first()
    if nulls:
        raise ValueError(f"{nulls} documents have no id")
    shards = max(1, -(-n // DOCS_PER_FILE))
    # As many numbers as files; repeated ids make shards unequal but never wrong.
    bounds = sorted(set(rows.agg(F.percentile_approx("id", [i / shards for i in range(1, shards)], 10 * shards)).first()[0] or [])) if shards > 1 and n else []
    size = Tokenizer.from_file(tokenizer).get_vocab_size()
    kind = "<u2" if size <= 1 << 16 else "<u4"
    order = ["shard", "id"]
    ids = (
        rows.mapInArrow(_tokenised(tokenizer, np.array(bounds, np.int64)), "shard int, id long, n long, ids binary")
        .repartitionById(len(bounds) + 1, "shard")  # a task for each file
        .sortWithinPartitions(*order)
        .mapInArrow(_offsets, "shard int, id long, n long, ids binary, off long, part int")
    )
    place = fresh_path(spark, "token-ids")
    ids.write.option("compression", "zstd").partitionBy("shard").parquet(place)
    table = spark.read.schema("id long, n long, ids binary, off long, part int, shard int").parquet(place)
    freq = table.select("ids").mapInArrow(_counted(kind, size), "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()  # at most the vocabulary
    by_rank = [t for _, t in sorted((-r["n"], r["token"]) for r in freq)]
    rank = np.zeros(size, np.uint32)
    rank[by_rank] = np.arange(len(by_rank))
    totals = {r["shard"]: r["n"] for r in table.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a number for each file
    base, at = {}, 0
    for s in sorted(totals):
        base[s], at = at, at + totals[s]
    blocks = table.select("shard", "part", "id", "off", "ids").mapInArrow(_blocks(kind, rank, base), "shard int, part int, block binary")
    blocks.select("shard", "part", F.col("block").cast("string").alias("value")).write.partitionBy("shard", "part").option("lineSep", "\n").text(f"{path}/files")
    spark.createDataFrame([(i, t) for i, t in enumerate(by_rank)], "rank int, token int").coalesce(1).write.parquet(f"{path}/ranks")
    return base


def _decoded(tokens: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                rows = ((d, s, tokens[r].tobytes()) for d, s, r in read_blocks(memoryview(batch.column(0)[i].as_buffer()).cast("B")))
                while part := list(islice(rows, 500)):
                    ids, starts, data = zip(*part, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(data, pa.binary())], ["id", "start", "ids"])

    return run


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, ids): every document of the files, ids as little-endian unsigned 32-bit."""
    prepare(spark)
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()  # at most the vocabulary
    tokens = np.array([r["token"] for r in ranks] or [0], "<u4")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(f"{path}/files")
    return files.select("content").mapInArrow(_decoded(tokens), "id long, start long, ids binary")


def token_file_report(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The contract's columns: the files are written to the shared folder and read back."""
    spark = docs.sparkSession
    path = fresh_path(spark, "token-files")
    write_token_files(docs, tokenizer, path)
    back = read_token_files(spark, path)
    return back.select(F.col("id").alias("doc_id"), "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
