"""Toxicity by bags of subwords: averaged n-gram embeddings under a linear softmax, trained jointly in numpy.

A text's features are the character n-grams of its lower-cased words (white
space next to a word counts as a character), hashed into buckets. Each bucket
has an embedding; a text is the average of its n-grams' embeddings, and a linear
softmax over it gives the score. Embeddings and softmax are trained together, so
a misspelling or a new ending shares the vectors of the n-grams that it keeps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import claim, prepare

#: Labelled texts to learn from, at most, of label 0 and of label 1: a bound of the fit alone.
LEARN_FROM = (4000, 2000)
SIZES = (3, 4, 5, 6)
BUCKETS = 1 << 18
DIM = 4
#: Passes over the texts, and batches at least (few texts are passed more often).
EPOCHS, LEAST_STEPS, BATCH, RATE = 6, 900, 32, 0.5
#: Averages of thousands of n-grams are small; the softmax sees them at this scale.
SCALE = 30.0
#: N-grams of no weight that every text has besides its own: short texts say little.
PRIOR_GRAMS = 150
SEED = 5
#: Characters looked at in one go; some eighty bytes of memory each.
PORTION = 200_000

_PRIME = np.uint32(0x01000193)


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, and where each text's begin (one more than there are texts)."""
    parts = [np.frombuffer(f" {(t or '').lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    ends = np.cumsum([len(p) for p in parts])
    chars = np.concatenate([*parts, np.full(max(SIZES), 32, np.uint32)])
    n = ends[-1] if len(parts) else 0
    space = (chars == 32) | ((chars >= 9) & (chars <= 13))
    chars = np.where(space, np.uint32(32), chars)
    spaces = np.concatenate([[0], np.cumsum(space, dtype=np.int32)])
    starts = np.concatenate([[0], ends])
    left = np.repeat(ends.astype(np.int64), [len(p) for p in parts]) - np.arange(n) if n else np.zeros(0, np.int64)  # characters to the text's end
    buckets, owners = [], []
    h = np.zeros(n, np.uint32)
    for k in range(max(SIZES)):
        h = (h ^ chars[k : k + n]) * _PRIME
        size = k + 1
        if size in SIZES:
            inside = spaces[size - 1 : size - 1 + n] - spaces[1 : 1 + n]
            at = np.flatnonzero((inside == 0) & (left >= size))
            x = h[at] ^ np.uint32(size * 0x9E37)
            x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            buckets.append(((x ^ (x >> np.uint32(12))) & np.uint32(BUCKETS - 1)).astype(np.int32))
            owners.append(at)
    return buckets, owners, starts


def _portions(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Texts in lists of at most ``PORTION`` characters; a longer text comes in parts, cut at white space, which no n-gram spans."""
    rows, parts, held = [], [], 0
    for i, text in enumerate(texts):
        text, at = text or "", 0
        while True:
            end = min(len(text), at + PORTION)
            if end < len(text):
                end = max((text.rfind(c, at + 1, end) for c in " \n\t"), default=-1)
                end = end if end > at else at + PORTION
            if parts and held + end - at > PORTION:
                yield rows, parts
                rows, parts, held = [], [], 0
            rows.append(i)
            parts.append(text[at:end])
            held += end - at
            at = end
            if at >= len(text):
                break
    if parts:
        yield rows, parts


@dataclass
class Model:
    """score = sigmoid(bias + SCALE * mean of the n-grams' weights): embeddings times the softmax's difference of columns."""

    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Scores of whole texts, looked at in portions of bounded length."""
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for rows, parts in _portions(texts):
            buckets, owners, starts = ngrams(parts)
            for b, at in zip(buckets, owners, strict=True):
                cut = np.searchsorted(at, starts)
                sums = np.concatenate([[0.0], np.cumsum(self.weights[b], dtype=np.float64)])
                np.add.at(total, rows, sums[cut[1:]] - sums[cut[:-1]])
                np.add.at(count, rows, np.diff(cut))
        z = self.bias + SCALE * total / (count + PRIOR_GRAMS)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def train(texts: list[str | None], labels: list[int]) -> Model:
    """Adagrad on minibatches; only the buckets of a batch move. Without both labels the model is constant."""
    rng = np.random.default_rng(SEED)
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 20.0 if len(y) and y[0] == 1 else -20.0)
    features = []
    for t in texts:
        tally = np.zeros(BUCKETS, np.int32)
        for _, parts in _portions([t]):
            for x in ngrams(parts)[0]:
                tally += np.bincount(x, minlength=BUCKETS).astype(np.int32)
        b = np.flatnonzero(tally)
        c = tally[b]
        features.append((b.astype(np.int32), (c / (c.sum() + PRIOR_GRAMS) * SCALE).astype(np.float32)))
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    bias = np.log(np.bincount(y, minlength=2) / len(y)).astype(np.float32)
    g_emb, g_out, g_bias = np.full(BUCKETS, 1e-4, np.float32), np.full((DIM, 2), 1e-4, np.float32), np.full(2, 1e-4, np.float32)
    for _ in range(max(EPOCHS, -(-LEAST_STEPS * BATCH // len(y)))):
        order = rng.permutation(len(y))
        for i in range(0, len(y), BATCH):
            rows = order[i : i + BATCH]
            some = [features[r] for r in rows]
            ids, inverse = np.unique(np.concatenate([s[0] for s in some]), return_inverse=True)
            w = np.concatenate([s[1] for s in some])
            doc = np.repeat(np.arange(len(rows)), [len(s[0]) for s in some])
            e = emb[ids]
            key = doc * len(ids) + inverse
            x = np.zeros(len(rows) * len(ids), np.float32)
            x[key] = w
            x = x.reshape(len(rows), len(ids))
            h = x @ e
            z = h @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            d_h = p @ out.T
            d_out, d_bias, d_e = h.T @ p / len(rows), p.mean(axis=0), x.T @ d_h / len(rows)
            g_emb[ids] += (d_e * d_e).mean(axis=1)
            emb[ids] = e - RATE * d_e / np.sqrt(g_emb[ids])[:, None]
            g_out += d_out * d_out
            out -= 0.1 * RATE * d_out / np.sqrt(g_out)
            g_bias += d_bias * d_bias
            bias -= 0.1 * RATE * d_bias / np.sqrt(g_bias)
    return Model((emb @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from: CRC-32 of the id as text is a multiple of five (so is that of a null id, as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", learn_from: tuple[int, int] = LEARN_FROM) -> Model:
    """Learn from at most ``learn_from`` labelled texts of each label, none of them held out.

    Rows are taken in the order of a hash of their ids. Rows with a null id or
    label take no part; an id with several labels counts once for each.
    """
    usable = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col))).select(F.col(id_col).alias("lid"), F.col(label_col).cast("int").alias("y")).distinct()
    taken = [usable.filter(F.col("y") == y).orderBy(F.xxhash64("lid"), "lid").limit(n) for y, n in enumerate(learn_from)]
    sample = taken[0].unionByName(taken[1])  # as many rows as ``learn_from`` says, at most
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(F.broadcast(sample), F.col("id") == F.col("lid")).select("id", "t", "y").collect()
    rows.sort(key=lambda r: (r["id"], r["y"], r["t"] or ""))
    return train([r["t"] for r in rows], [r["y"] for r in rows])


def _score_rows(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity", dict)
        m = model.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m.scores(batch.column(1).to_pylist()))], ["key", "score"])

    return run


def scored(docs: DataFrame, model: Model, text_col: str = "text", key_col: str = "doc_id") -> DataFrame:
    """(key, score): the likelihood of label 1 of each whole text; null texts count as empty. One row per row."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)  # as large as its buckets, whatever the corpus
    kind = docs.schema[key_col].dataType.simpleString()
    return docs.select(F.col(key_col).alias("key"), F.col(text_col)).mapInArrow(_score_rows(shared), f"key {kind}, score double")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns, one row per document."""
    s = scored(docs, fit(docs, labels))
    return s.select(F.col("key").alias("doc_id"), held_out(F.col("key")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _kept_rows(model, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity", dict)
        m = model.value
        for batch in batches:
            yield batch.filter(pa.array(m.scores(batch.column(at).to_pylist()) < 0.5))

    return run


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the classifier doesn't reject."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(fit(docs, labels))
    return docs.mapInArrow(_kept_rows(shared, docs.columns.index("text")), docs.schema)
