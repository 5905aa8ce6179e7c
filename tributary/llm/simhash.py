"""SimHash near-dedup: fingerprints over word shingles, linked by pivot distance tables.

Distinct fingerprints meet where they agree on some of their bit blocks: two
fingerprints within ``bits`` differing bits leave all but ``bits`` blocks
unchanged, so every pair to find shares a key. Within a key a table of Hamming
distances to many reference fingerprints (pivots) is computed once; by the
triangle inequality a pair whose distances to some pivot differ by more than
``bits`` is discarded, and only the survivors are compared bit by bit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import claim, handed, prepare, stored
from tributary.llm.components import connected_components

SEED = 42
BITS = 2
#: Blocks of 16 bits; two of four stay unchanged within two differing bits.
BLOCKS = 4
PIVOTS = 32
#: Distinct fingerprints that one key's table may hold; larger keys go another exact way.
MAX_TABLE = 4096
#: Shingles whose hashes are counted at once.
COUNTED = 1 << 16

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_PIVOTS = np.random.default_rng(20).integers(0, 2**64, PIVOTS, np.uint64)


def simhash(text: str | None, words: int = 3) -> int:
    """64 bits: bit b is set where over half of the shingles' XXH64 have it. No word: zero."""
    tokens = (text or "").encode().translate(_LOWER).split()
    if not tokens:
        return 0
    line = b" ".join(tokens)
    ends, at = [], -1
    for t in tokens:
        at += len(t) + 1
        ends.append(at)
    if len(tokens) <= words:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        starts = [0, *(e + 1 for e in ends[: len(tokens) - words])]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts, ends[words - 1 :], strict=True)]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), COUNTED):
        part = np.array(hashes[i : i + COUNTED], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprint_rows(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("simhash", dict)
        for batch in batches:
            marks = np.array([simhash(x, words) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks.view(np.int64))], ["id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp long): the 64 bits of each text. Null texts are empty."""
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(_fingerprint_rows(words), f"id {kind}, fp long")


def _links(fps: np.ndarray, bits: int) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of the links among distinct fingerprints (positions in ``fps``)."""
    table = np.bitwise_count(fps[:, None] ^ _PIVOTS[None, :]).astype(np.int8)
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order]
    root = list(range(len(fps)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    until = np.searchsorted(table[:, 0], table[:, 0] + bits, side="right")  # the first coordinate bounds the window
    for i in range(len(fps)):
        near = np.flatnonzero(np.abs(table[i + 1 : until[i]] - table[i]).max(axis=1, initial=0) <= bits) + i + 1
        for j in near[np.bitwise_count(fps[near] ^ fps[i]) <= bits].tolist():
            a, b = find(i), find(j)
            if a != b:
                root[b] = a
                yield int(order[i]), int(order[j])


def _linked(bits: int):
    """Rows (combo, key, fp) sorted by key: edges between fingerprints of a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, []

        def flush(out: list) -> None:
            fps = np.unique(np.concatenate(held)) if len(held) > 1 else held[0]
            if len(fps) > 1:
                out += [(int(fps[i]), int(fps[j])) for i, j in _links(fps.astype(np.uint64) if fps.dtype != np.uint64 else fps, bits)]

        def table(out: list) -> pa.RecordBatch:
            pair = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["fa", "fb"])

        for batch in batches:
            combo, key = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            fp = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(fp):
                continue
            cut = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (combo[1:] != combo[:-1])) + 1).tolist(), len(fp)]
            out: list = []
            for a, b in zip(cut, cut[1:], strict=False):
                k = (int(combo[a]), int(key[a]))
                if k != held_key:
                    if held:
                        flush(out)
                    held_key, held = k, []
                held.append(fp[a:b])
            if out:
                yield table(out)
        out = []
        if held:
            flush(out)
        if out:
            yield table(out)

    return run


def _keys(fps: DataFrame, bits: int, blocks: int) -> DataFrame:
    """A row (combo, key, fp) for each choice of blocks that ``bits`` differences can leave unchanged."""
    width = 64 // blocks
    masks = []
    for chosen in combinations(range(blocks), blocks - bits):
        m = 0
        for b in chosen:
            hi = 64 if b == blocks - 1 else (b + 1) * width
            m |= ((1 << hi) - 1) ^ ((1 << (b * width)) - 1)
        masks.append(m - 2**64 if m >= 2**63 else m)
    rows = F.array(*[F.struct(F.lit(i).alias("combo"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
    return fps.select("fp", F.explode(rows).alias("k")).select("k.combo", "k.key", "fp")


def _by_neighbours(fps: DataFrame) -> DataFrame:
    """Edges among fingerprints of crowded keys: those within one flip of a value are within two of each other.

    Each emits itself and its 64 flips; a value gathers 65 fingerprints at most, linked to their smallest.
    """
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << b) - (2**64 if b == 63 else 0))) for b in range(64)])
    near = fps.select("fp", F.explode(flips).alias("value"))
    low = near.groupBy("value").agg(F.min("fp").alias("fa"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return near.join(low, "value").filter("fa <> fp").select("fa", F.col("fp").alias("fb"))


def linked_fingerprints(fps: DataFrame, bits: int = BITS, blocks: int = BLOCKS, max_table: int = MAX_TABLE) -> DataFrame:
    """Edges (fa, fb) that connect all distinct fingerprints ``fp`` linked at ``bits`` or fewer differing bits."""
    if bits != 2:
        raise ValueError("the way for crowded keys holds for two differing bits")
    keys = _keys(fps, bits, blocks)
    crowded = stored(keys.groupBy("combo", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_table).select("combo", "key"), "crowded")
    some = not crowded.isEmpty()
    rows = keys.join(crowded, ["combo", "key"], "left_anti") if some else keys
    found = rows.repartition("combo", "key").sortWithinPartitions("combo", "key").mapInArrow(_linked(bits), "fa long, fb long")
    if some:
        found = found.unionByName(_by_neighbours(keys.join(crowded, ["combo", "key"], "left_semi").select("fp").distinct()))
    return found


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp, component), one row per row: the smallest id reachable by links.

    Null and empty texts have fingerprint zero and link like any other. Rows
    without an id link others but are never a component's name (null where a
    component has no id at all). Repeated rows give a row each. An empty table
    gives an empty result.
    """
    marks = stored(fingerprints(docs, id_col, text_col, words), "simhash")
    distinct = stored(marks.groupBy("fp").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")), "simfp")
    total = marks.count()
    cc = connected_components(linked_fingerprints(distinct.select("fp")))
    named = stored(distinct.join(cc, F.col("fp") == F.col("node"), "left").select("fp", "low", "n", F.coalesce("component", "fp").alias("root")), "simcc")
    name = named.groupBy("root").agg(F.min("low").alias("component"), F.count(F.lit(1)).alias("fps"))
    facts = handed(named.select("fp", "n", "root"), name, ["root"], "fps", total)
    return handed(marks, facts.select("fp", "n", "component"), ["fp"], "n", total).select("id", "fp", "component")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the row with the smallest id, with all their columns.

    Rows that repeat that id and fingerprint count as one document and one of them stays.
    """
    keep = near_classes(docs, id_col, text_col, words).filter(F.col("id").eqNullSafe(F.col("component"))).select(F.col("id").alias("kid")).distinct()
    rows = docs.select(F.col(id_col).alias("id"), F.struct(*docs.columns).alias("row"))
    kept = rows.join(keep, F.col("id").eqNullSafe(F.col("kid")))
    return kept.groupBy("id").agg(F.first("row").alias("row")).select("row.*")


def near_dedup_report(docs: DataFrame) -> DataFrame:
    """The contract's columns, one row per document."""
    c = near_classes(docs)
    return c.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


# Near copies by a similarity of shingle sets: too many bits differ for every pair to share bit blocks, so wide
# fingerprints give many keys, and the shingle sets themselves decide.

#: 64-bit words of a wide fingerprint, and the keys drawn from its bits and bits of a key for a table of few rows.
WIDE, KEYS, KEY_BITS = 8, 64, 16
#: Rows that a key value holds of evenly spread texts; more rows in all take longer keys, and more of them for the same recall.
ROWS_PER_KEY = 16
#: Likelihood that a bit is the same in two texts of similarity 0.8.
SAME_BIT = 0.86
#: Words of the fingerprint that key rows carry, and their differing bits up to which a pair is looked at: at 0.8 some 19 of 128 differ, with a deviation of 4.
CARRIED, RADIUS = 2, 30
#: Differing bits of the whole wide fingerprint up to which a pair's shingle sets are looked at: 77 on average at 0.8 with a deviation of 8 (more in tiny texts), some 140 at 0.5.
WIDE_RADIUS = 116
#: One row in so many is counted to find keys of many rows, which are then dealt into blocks; and members of a cluster in a block.
COUNTED_ONE_IN, CLUSTER_BLOCK = 8, 256
#: Rows of a key that each row is compared with in the first round, beside the key's first; the second compares all.
NEIGHBOURS = 32

_MIX = np.random.default_rng(21).integers(0, 2**63, WIDE, np.uint64) * np.uint64(2) + np.uint64(1)


def key_plan(rows: int) -> tuple[int, int]:
    """(keys, bits of a key) for a table of so many rows: a pair at 0.8 shares about ``KEYS * SAME_BIT ** KEY_BITS`` keys at every size."""
    bits = max(KEY_BITS, min(48, math.ceil(math.log2(max(1, rows) / ROWS_PER_KEY))))
    return math.ceil(KEYS * SAME_BIT ** (KEY_BITS - bits)), bits


@lru_cache(maxsize=4)
def _chosen(keys: int, bits: int) -> np.ndarray:
    """The bits of each key: different ones within a key, and all bits used alike."""
    out, at = np.empty((keys, bits), np.int64), 0
    order = np.zeros(0, np.int64)
    for k in range(keys):
        if len(order) < bits:
            order, at = np.random.default_rng([22, at]).permutation(64 * WIDE), at + 1
        out[k], order = order[:bits], order[bits:]
    return out


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Distinct XXH64 of the lower-cased word shingles, sorted; a text of fewer words is one shingle, one of none has none."""
    tokens = (text or "").encode().translate(_LOWER).split()
    if not tokens:
        return np.zeros(0, np.uint64)
    line = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest, n = xxhash.xxh64_intdigest, max(1, len(tokens) - words + 1)
    spans = zip(starts[:n].tolist(), ends[min(words, len(tokens)) - 1 :].tolist(), strict=True)
    return np.unique(np.array([digest(line[a:b], SEED) for a, b in spans], np.uint64))


def wide_simhash(hashes: np.ndarray) -> np.ndarray:
    """``WIDE`` words: bit b of a word is set where over half of the (mixed) hashes have it."""
    counts = np.zeros(64 * WIDE, np.int64)
    for i in range(0, len(hashes), 255 * 32):
        part = hashes[i : i + 255 * 32]
        mixed = (part[:, None] ^ (part[:, None] >> np.uint64(29))) * _MIX[None, :]
        mixed ^= mixed >> np.uint64(32)
        bits = np.unpackbits(mixed.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little")
        for j in range(0, len(part), 255):  # sums of 255 bits fit a byte
            counts += bits[j : j + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")


def _wide_rows(words: int):
    """(id, text) -> (id, wide fingerprint) of each text that has a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("simhash", dict)
        for batch in batches:
            sets = [shingle_hashes(t, words) for t in batch.column(1).to_pylist()]
            used = np.flatnonzero([len(s) > 0 for s in sets])
            wide = pa.array([wide_simhash(sets[i]).tobytes() for i in used], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(used)), wide], ["id", "wide"])

    return run


def _words(column: pa.Array) -> np.ndarray:
    """A binary column of equal lengths as rows of 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(len(column), -1)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints in their last axis."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int16)


def _wide_keys(keys: int, bits: int, carried: int = 8 * CARRIED):
    """(wide, columns) -> a row (key, fp, columns) for each key of a fingerprint; ``fp`` is its first bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, chosen = 1 << np.arange(bits, dtype=np.int64), _chosen(keys, bits)
        for whole in batches:
            for at in range(0, len(whole), 500):
                batch = whole.slice(at, 500)
                wide = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(len(batch), -1)
                key = (np.unpackbits(wide, axis=1, bitorder="little")[:, chosen] @ weights) | (np.arange(keys, dtype=np.int64) << bits)
                owner = pa.array(np.repeat(np.arange(len(batch)), keys))
                fp = pa.array([w.tobytes() for w in wide[:, :carried].copy()], pa.binary()).take(owner)
                yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1)), fp, *(c.take(owner) for c in batch.columns[1:])], ["key", "fp", *batch.schema.names[1:]])

    return run


_WIDE_PIVOTS = np.random.default_rng(23).integers(0, 2**64, (PIVOTS, CARRIED), np.uint64)


def _candidates(radius: int):
    """Rows (key, fp, id) in order of key and id: for each row its key's first row, if close, or else the closest of the rows before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = [np.zeros(0, np.int64), np.zeros((0, CARRIED), np.uint64), np.zeros(0, np.int64)]
        found: list[np.ndarray] = []
        first_key, first = None, None
        for batch in batches:
            if not len(batch):
                continue
            new = [batch.column(0).to_numpy(zero_copy_only=False), _words(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)]
            key, fp, node = (np.concatenate([t, n]) for t, n in zip(tail, new, strict=True))
            old = len(tail[0])
            table = _apart(fp[:, None, :], _WIDE_PIVOTS[None, :, :])
            heads = np.concatenate([[True], key[1:] != key[:-1]])
            head_at = np.maximum.accumulate(np.where(heads, np.arange(len(key)), 0))
            head_fp, head_node, head_table = fp[head_at], node[head_at], table[head_at]
            if first_key is not None:  # the key's first row may lie batches before
                same = key == first_key
                head_fp[same], head_node[same] = first
                head_table[same] = _apart(first[0], _WIDE_PIVOTS)
            best = np.full(len(key), 64 * CARRIED + 1, np.int16)
            partner = np.zeros(len(key), np.int64)
            for k in range(1, min(NEIGHBOURS, len(key) - 1) + 1):
                at = np.flatnonzero(key[k:] == key[:-k]) + k
                if not len(at):
                    break
                at = at[np.abs(table[at] - table[at - k]).max(axis=1, initial=0) <= radius]
                far = _apart(fp[at], fp[at - k])
                nearer = far < best[at]
                best[at[nearer]], partner[at[nearer]] = far[nearer], node[at[nearer] - k]
            lead = (np.abs(table - head_table).max(axis=1) <= radius) & (_apart(fp, head_fp) <= radius) & (head_node != node)
            best[lead], partner[lead] = 0, head_node[lead]
            at = np.flatnonzero((best <= radius) & (partner != node))
            at = at[at >= old]
            if len(at):
                found.append(np.stack([np.minimum(partner[at], node[at]), np.maximum(partner[at], node[at])], axis=1))
            if key[-1] != first_key:
                first_key, first = key[-1], (head_fp[-1], head_node[-1])
            keep = np.flatnonzero(key == key[-1])[-NEIGHBOURS:]
            tail = [key[keep], fp[keep], node[keep]]
            if sum(map(len, found)) > 1 << 20:
                found = [np.unique(np.concatenate(found), axis=0)]
        if found:
            yield from _pair_batches(np.unique(np.concatenate(found), axis=0))

    return run


def _pair_batches(pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(pairs), 10_000):
        part = pairs[i : i + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(part[:, 0].copy()), pa.array(part[:, 1].copy())], ["a", "b"])


def _near_pairs(start: np.ndarray, side: np.ndarray, fp: np.ndarray, comp: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (as places) of each pair within the radius of one group, of two components; ``start`` is the place where a row's group begins.

    Side -1 meets its whole group, other sides only what is on another side.
    Small groups go together, by the distance of two rows in their order; in a
    large one each row outside the most frequent component meets all rows.
    """
    n = np.arange(len(start))
    sizes = np.bincount(start, minlength=len(start))[start]
    small = sizes <= SMALL_GROUP
    apart = lambda i, j: (comp[i] != comp[j]) & ((side[i] < 0) | (side[i] != side[j]))
    at, k = n[small & (n > start)], 1
    while len(at):
        good = apart(at, at - k)
        good[good] = _apart(fp[at[good]], fp[at[good] - k]) <= radius
        if good.any():
            yield at[good] - k, at[good]
        k += 1
        at = at[at - start[at] >= k]
    for begin in np.unique(start[~small]).tolist():
        rows = np.arange(begin, begin + sizes[begin])
        values, counts = np.unique(comp[rows], return_counts=True)
        others = rows[comp[rows] != values[counts.argmax()]]
        for i in range(0, len(others), 64):
            x = others[i : i + 64]
            ok = apart(x[:, None], rows[None, :])
            ok &= _apart(fp[x][:, None, :], fp[rows][None, :, :]) <= radius
            a, b = np.nonzero(ok)
            if len(a):
                yield x[a], rows[b]


#: Rows of a group that is compared together with others.
SMALL_GROUP = 64


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Batches sorted by their first columns, joined so that no group of equal ``keys`` first columns is cut; binary columns as words, with the place where each row's group begins in front."""
    held: list[pa.RecordBatch] = []

    def made(parts: list[pa.RecordBatch]) -> list[np.ndarray]:
        whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        cols = [_words(c) if pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False) for c in whole.columns]
        new = np.zeros(len(whole), bool)
        new[0] = True
        for c in cols[:keys]:
            new[1:] |= c[1:] != c[:-1]
        return [np.maximum.accumulate(np.where(new, np.arange(len(whole)), 0)), *cols]

    for batch in batches:
        if not len(batch):
            continue
        last = np.ones(len(batch), bool)
        for i in range(keys):
            c = batch.column(i).to_numpy(zero_copy_only=False)
            last &= c == c[-1]
        cut = int(np.argmax(last))
        same = held and all(held[-1].column(i)[len(held[-1]) - 1].equals(batch.column(i)[0]) for i in range(keys))
        if cut or (held and not same):
            whole = [*held, *([batch.slice(0, cut)] if cut else [])]
            if whole:
                yield made(whole)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield made(held)


def _open_ids(radius: int):
    """Rows (key, part, side, fp, id, component) in order of key and part: the ids with a row of another component within the radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for start, _, _, side, fp, node, comp in _grouped(batches, 2):
            hit = np.zeros(len(node), bool)
            for a, b in _near_pairs(start, side, fp, comp, radius):
                hit[a] = hit[b] = True
            seen = np.unique(np.concatenate([seen, node[hit]]))
            if len(seen) > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(seen)], ["id"])
                seen = np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(seen)], ["id"])

    return run


def _spanning(pairs: np.ndarray) -> np.ndarray:
    """Pairs that connect the same nodes as all of them."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.setdefault(x, x)) != x:
            root[x] = root[y]
            x = root[x]
        return x

    out = []
    for a, b in pairs.tolist():
        ra, rb = find(a), find(b)
        if ra != rb:
            root[rb] = ra
            out.append((a, b))
    return np.array(out, np.int64).reshape(-1, 2)


def _close_edges(radius: int):
    """As :func:`_open_ids`, but edges that connect what is close: fewer than the rows, however many pairs there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.zeros((0, 2), np.int64)
        for start, _, _, side, fp, node, comp in _grouped(batches, 2):
            for a, b in _near_pairs(start, side, fp, comp, radius):
                edges = np.concatenate([edges, np.stack([node[a], node[b]], axis=1)])
                if len(edges) > 1 << 18:
                    edges = _spanning(np.unique(edges, axis=0))
            if len(edges) > 1 << 16:
                edges = _spanning(np.unique(edges, axis=0))
        yield from _pair_batches(_spanning(np.unique(edges, axis=0)))

    return run


def _cluster_links(similarity: float):
    """Rows (cluster, i, j, side, wide, id, component, set) in order of the first three: the pairs of enough similarity, of two components, that two blocks of a cluster hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for start, _, _, _, side, wide, node, comp, at, sets in _grouped_sets(batches):
            out = []
            for a, b in _near_pairs(start, side, wide, comp, WIDE_RADIUS):
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    if _similar(sets[at[x]], sets[at[y]], similarity):
                        out.append((min(int(node[x]), int(node[y])), max(int(node[x]), int(node[y]))))
            if out:
                yield from _pair_batches(np.unique(np.array(out, np.int64), axis=0))

    return run


def _grouped_sets(batches: Iterator[pa.RecordBatch]):
    """:func:`_grouped` for rows whose last column is a set of any length: it comes as a list, with each row's place in it before."""
    kept: list = []

    def narrow() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = pa.array(np.arange(len(kept), len(kept) + len(batch)))
            kept.extend(batch.column(7).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], at], [*batch.schema.names[:7], "at"])

    for cols in _grouped(narrow(), 3):
        places = cols[-1]
        yield [*cols, dict(zip(places.tolist(), (kept[i] for i in places.tolist()), strict=True))]
        for i in places.tolist():
            kept[i] = None  # a group that is over


def _in_parts(keys: DataFrame, max_table: int) -> DataFrame:
    """(key, part, side, fp, id, component): a key of over ``max_table`` rows is dealt into blocks, and each two of them meet in a part of their own.

    The rows of keys are estimated from those of some ids: this decides how keys are dealt out and never what is compared.
    """
    some = keys.filter(F.pmod(F.xxhash64("id"), F.lit(COUNTED_ONE_IN)) == 0).groupBy("key").agg((F.count(F.lit(1)) * COUNTED_ONE_IN).alias("n"))
    crowded = stored(some.filter(F.col("n") > max_table).select("key", F.ceil(F.col("n") / max_table).cast("int").alias("blocks")), "crowded")
    plain = lambda rows: rows.select("key", F.lit(0).alias("part"), F.lit(-1).alias("side"), "fp", "id", "component")
    if crowded.isEmpty():
        return plain(keys)
    # A key of so many rows is one of keys x rows / max_table at most: as many as a few rows of the corpus.
    dealt = keys.join(crowded, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    part = F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")
    split = met.select("key", part.alias("part"), F.when(F.col("block") == F.col("other"), -1).otherwise(F.col("block")).alias("side"), "fp", "id", "component")
    return plain(keys.join(crowded, "key", "left_anti")).unionByName(split)


def _set_rows(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("simhash", dict)
        for batch in batches:
            sets = [np.unique((shingle_hashes(t, words) >> np.uint64(32)).astype("<u4")).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["sid", "shingles"])

    return run


def _similar(x: bytes, y: bytes, similarity: float) -> bool:
    """Whether two sorted sets of hashes are as similar as asked."""
    a, b = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = np.sort(np.concatenate([a, b]))
    common = int((both[1:] == both[:-1]).sum())
    return common >= similarity * (len(a) + len(b) - common)


def _verified(similarity: float):
    """(a, b, set of a, set of b) -> the pairs of enough similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [_similar(x, y, similarity) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def similar_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, max_table: int = MAX_TABLE) -> DataFrame:
    """(a, b): verified links that connect the near copies; a pair is one of documents whose shingle sets are as similar as asked.

    In a first round each document proposes one partner per key. One proposal of
    each document is verified first; of the others only those that would join two
    components. The second round is whole: every pair of a key within the radius
    whose documents are still in two components makes them open; open documents
    meet again by keys, with their wide fingerprints, into clusters of what is
    close, and in a cluster, block by block, the shingle sets decide. Rows that
    move follow the documents, not the pairs.
    """
    prepare(docs.sparkSession)
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    marks = stored(rows.mapInArrow(_wide_rows(words), "id long, wide binary"), "wide")
    total = marks.count()
    plan = key_plan(total)
    keys = marks.select("wide", "id").mapInArrow(_wide_keys(*plan), "key long, fp binary, id long")
    pairs = stored(keys.repartition("key").sortWithinPartitions("key", "id").mapInArrow(_candidates(RADIUS), "a long, b long").groupBy("a", "b").agg(F.count(F.lit(1)).alias("times")), "proposals")

    def sets_of(some: DataFrame) -> DataFrame:
        return stored(rows.join(some.select("id").distinct().withColumnRenamed("id", "nid"), F.col("id") == F.col("nid")).select("id", "text").mapInArrow(_set_rows(words), "sid long, shingles binary"), "sets")

    def verified(some: DataFrame, sets: DataFrame) -> DataFrame:
        left = some.join(sets, F.col("a") == F.col("sid")).select("a", "b", F.col("shingles").alias("x"))
        both = left.join(sets, F.col("b") == F.col("sid")).select("a", "b", "x", F.col("shingles").alias("y"))
        return stored(both.mapInArrow(_verified(similarity), "a long, b long"), "links")

    def apart(some: DataFrame, cc: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            c = cc.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
            some = some.join(c, side, "left").withColumn(f"c{side}", F.coalesce(f"c{side}", side))
        return some.filter("ca <> cb").select("a", "b")

    sets = sets_of(pairs.select(F.col("a").alias("id")).union(pairs.select("b")))
    best = stored(pairs.groupBy("b").agg(F.max_by("a", F.struct("times", -F.col("a"))).alias("a")).select("a", "b"), "best")
    sure = verified(best, sets)
    other = apart(pairs.select("a", "b").join(best, ["a", "b"], "left_anti"), connected_components(sure))
    links = sure.unionByName(verified(other, sets))

    cc = connected_components(links).select(F.col("node").alias("id"), "component")
    placed = stored(marks.join(cc, "id", "left").select("wide", "id", F.coalesce("component", "id").alias("component")), "placed")
    order = ["key", "part"]

    def in_keys(some: DataFrame, carried: int, f, schema: str) -> DataFrame:
        made = some.mapInArrow(_wide_keys(*plan, carried), "key long, fp binary, id long, component long")
        return _in_parts(made, max_table).repartition(*order).sortWithinPartitions(*order).mapInArrow(f, schema)

    open_ids = in_keys(placed, 8 * CARRIED, _open_ids(RADIUS), "id long").distinct()
    opened = stored(placed.join(open_ids, "id", "left_semi").select("wide", "id", "component"), "open")
    edges = in_keys(opened, 8 * WIDE, _close_edges(WIDE_RADIUS), "a long, b long")
    cluster = stored(connected_components(edges), "clusters")
    member = cluster.unionByName(cluster.select(F.col("component").alias("node"), "component").distinct()).toDF("id", "cluster")
    sizes = member.groupBy("cluster").agg(F.count(F.lit(1)).alias("m"))
    held = handed(member, sizes, ["cluster"], "m", total).withColumn("blocks", F.ceil(F.col("m") / CLUSTER_BLOCK).cast("int"))
    own_sets = sets_of(member).withColumnRenamed("sid", "id")
    full = held.join(opened, "id").join(own_sets, "id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.when(F.col("block") == F.col("other"), -1).otherwise(F.col("block")).alias("side"), "wide", "id", "component", "shingles"
    )
    groups = ["cluster", "i", "j"]
    late = met.repartition(*groups).sortWithinPartitions(*groups).mapInArrow(_cluster_links(similarity), "a long, b long")
    return links.unionByName(stored(late, "late"))


def similar_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay: of documents connected by similar shingle sets the one with the smallest id.

    Texts without a word, null texts and rows without an id are near copies of
    nothing and stay; rows that repeat an id are one document and stay or go together.
    """
    cc = connected_components(similar_links(docs, id_col, text_col, words, similarity))
    gone = cc.filter("node <> component").select(F.col("node").alias("gone_id")).distinct()
    rows = docs.select(F.col(id_col).alias("key"), F.struct(*docs.columns).alias("row"))
    return rows.join(gone, F.col("key") == F.col("gone_id"), "left_anti").select("row.*")
