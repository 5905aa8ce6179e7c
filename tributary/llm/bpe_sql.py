"""Byte-level BPE as recursive SQL: token rows contract until no pair merges, ordered aggregation decodes.

Each task runs DuckDB on its own rows. Rows (word, position, token) join the
merge table with the token that follows; in every step each word contracts its
leftmost pair of the least rank. The recursion keeps the words' current state
only, so its memory follows their bytes and not the steps.
Distinct words are encoded once per worker; a text's ids are its words' ids in
order.

A word of many bytes is encoded in pieces. Ids are the encoding of their bytes
if and only if each two neighbours among them are the encoding of theirs, so
pieces are joined by encoding a window around each seam: it replaces both sides
from a token that it shares with the left piece to one that it shares with the
right piece. Where a window shares none, the encoding goes on from window to
window until it meets a later piece.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import claim, prepare
from tributary.llm.tokens import KnownWords, in_order, split_units, unit_text

#: Words given to one recursive query; their bytes bound its memory.
WORDS_AT_ONCE, BYTES_AT_ONCE = 40_000, 400_000

#: A word's tokens ride in one row, which the key replaces in each step, and are opened to position rows there.
ENCODE = """
WITH RECURSIVE state(word, toks) USING KEY (word) AS (
  SELECT word, list(tok ORDER BY pos) FROM bytes GROUP BY word
  UNION ALL
  SELECT s.word, s.toks[1:b.spot - 1] || [b.merged] || s.toks[b.spot + 2:len(s.toks)]
  FROM state s JOIN (
    SELECT word, (min(place) & 4294967295)::INTEGER AS spot, (min(place) >> 32)::INTEGER AS merged
    FROM (
      SELECT word, (rank::BIGINT << 32) + pos AS place
      FROM (SELECT word, unnest(toks[1:len(toks) - 1])::BIGINT * 1048576 + unnest(toks[2:len(toks)]) AS pair, unnest(range(1, len(toks))) AS pos FROM state) p
      JOIN merges m ON m.pair = p.pair
    )
    GROUP BY word
  ) b ON s.word = b.word
)
SELECT word, toks FROM state ORDER BY word
"""

#: Longer words are encoded in pieces of so many bytes, and around each seam from so many bytes before it to so many after.
PIECE, BEFORE, AFTER = 128, 24, 48
#: Bytes of a window where seams don't meet their pieces.
SWEEP = 256

DECODE = "SELECT word, string_agg(hex, '' ORDER BY pos) AS hex FROM ids JOIN vocabulary USING (tok) GROUP BY word ORDER BY word"


def load_ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}


class SqlBpe:
    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        self.ranks = load_ranks(path)
        self.words_of = regex.compile(pattern).findall
        rows = [(self.ranks[t[:i]], self.ranks[t[i:]], rank) for t, rank in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        left, right, rank = (pa.array(c, pa.int32()) for c in zip(*rows, strict=True))
        pair = pa.array([a * 1048576 + b for a, b, _ in rows], pa.int64())
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self._table("merges", l=left, r=right, rank=rank, pair=pair)
        self._table("vocabulary", tok=pa.array(list(self.ranks.values()), pa.int32()), hex=pa.array([t.hex() for t in self.ranks]))
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.size = np.zeros(max(self.ranks.values()) + 1, np.int64)
        self.size[list(self.ranks.values())] = list(map(len, self.ranks))
        self.units, self.words = KnownWords(2), KnownWords(2)

    def _table(self, name: str, **columns: pa.Array) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _rows(self, groups: list[bytes], width: int, tokens=lambda x: x) -> dict[str, pa.Array]:
        """Position rows of groups of little-endian numbers, ``width`` bytes each."""
        sizes = np.fromiter(map(len, groups), np.int64, len(groups)) // width
        ends = np.cumsum(sizes)
        numbers = np.frombuffer(b"".join(groups), np.uint8 if width == 1 else "<u4")
        return {"word": pa.array(np.repeat(np.arange(len(groups), dtype=np.int32), sizes)), "pos": pa.array((np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)).astype(np.int32)), "tok": pa.array(tokens(numbers).astype(np.int32))}

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each word."""
        whole = self.ranks.get
        out: list = [None if (x := whole(w)) is None else x.to_bytes(4, "little") for w in words]
        todo = [i for i, x in enumerate(out) if x is None]
        short = [i for i in todo if len(words[i]) <= PIECE]
        for i, x in zip(short, self._contracted([words[i] for i in short]), strict=True):
            out[i] = x
        for i in todo:
            if len(words[i]) > PIECE:
                out[i] = self._joined(words[i])
        return out

    def _contracted(self, words: list[bytes]) -> list[bytes]:
        """Ids of words by the recursive query, as many at once as its memory allows."""
        out = []
        for part in _portions(list(range(len(words))), [len(w) for w in words]):
            self._table("bytes", **self._rows([words[i] for i in part], 1, self.byte.__getitem__))
            toks = self.db.sql(ENCODE).to_arrow_table()["toks"].combine_chunks()
            cuts, data = toks.offsets.to_pylist(), toks.values.to_numpy().astype("<u4").tobytes()
            out += [data[4 * a : 4 * b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return out

    def _placed(self, parts: list[bytes], starts: list[int]) -> list[list[tuple[int, int]]]:
        """(byte, token) of each token of parts that begin at the bytes given."""
        out = []
        for at, ids in zip(starts, self._contracted(parts), strict=True):
            toks = np.frombuffer(ids, "<u4")
            out.append(list(zip((at + np.cumsum(self.size[toks]) - self.size[toks]).tolist(), toks.tolist(), strict=True)))
        return out

    def _joined(self, word: bytes) -> bytes:
        """Ids of a long word, from its pieces."""
        cuts = list(range(0, len(word), PIECE))
        if len(word) - cuts[-1] < BEFORE + AFTER:
            cuts.pop()
        pieces = self._placed([word[a:b] for a, b in zip(cuts, [*cuts[1:], len(word)], strict=True)], cuts)
        anchors = [next((x for x in reversed(p) if x[0] <= end - BEFORE), p[0]) for p, end in zip(pieces, cuts[1:], strict=False)]
        lefts = [a for a, _ in anchors]
        seams = self._placed([word[a : b + AFTER] for a, b in zip(lefts, cuts[1:], strict=True)], lefts)
        again = [i for i, s in enumerate(seams) if _meeting(s, pieces[i + 1]) is None]
        for i, s in zip(again, self._placed([word[lefts[i] : cuts[i + 1] + PIECE] for i in again], [lefts[i] for i in again]), strict=True):
            seams[i] = s  # up to the end of the piece
        out = list(pieces[0])  # each two neighbours in it are encoded as they stand
        k = 1  # the next piece
        while k < len(pieces):
            anchor, seam = anchors[k - 1], seams[k - 1]
            back, met = _place(out, anchor), _meeting(seam, pieces[k])
            if back is None or met is None or out[-1] != pieces[k - 1][-1] or seam[0] != anchor:
                k = self._swept(word, out, pieces, k)
                continue
            out[back:] = seam[: met[0]] + pieces[k][met[1] :]
            k += 1
        return np.fromiter((t for _, t in out), "<u4", len(out)).tobytes()

    def _swept(self, word: bytes, out: list[tuple[int, int]], pieces: list[list[tuple[int, int]]], k: int) -> int:
        """Encodes on from the last tokens of ``out`` until a window meets piece ``k`` or a later one; gives the next piece's number."""
        end = pieces[k][0][0]  # of what ``out`` covers
        while end < len(word):
            far, back = min(len(word), end + SWEEP), len(out) - 1
            while back and out[back][0] > end - BEFORE:
                back -= 1
            (window,) = self._placed([word[out[back][0] : far]], [out[back][0]])
            while window[0] != out[back]:  # the first token of all is always right
                back = max(0, back - 8)
                (window,) = self._placed([word[out[back][0] : far]], [out[back][0]])
            for i, x in enumerate(window):
                while k + 1 < len(pieces) and pieces[k + 1][0][0] <= x[0]:
                    k += 1
                if (j := _place(pieces[k], x)) is not None:
                    out[back:] = window[:i] + pieces[k][j:]
                    return k + 1
            out[back:], end = window, far
        return len(pieces)

    def decode_words(self, ids: list[bytes]) -> list[bytes]:
        """Bytes of each id sequence."""
        out = []
        for part in _portions(list(range(len(ids))), [len(x) for x in ids]):
            self._table("ids", **self._rows([ids[i] for i in part], 4))
            out += [bytes.fromhex(h) for h in self.db.sql(DECODE).to_arrow_table()["hex"].to_pylist()]
        return out

    def _made(self, words: list[str]) -> tuple[list[bytes], list[bytes]]:
        ids = self.encode_words([w.encode() for w in words])
        return ids, self.decode_words(ids)

    def coded(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Ids and decoded bytes of each text; a text's words are the pattern's matches."""
        split = list(map(self.words_of, texts))
        words = pa.array(list(chain.from_iterable(split)), pa.large_string()).dictionary_encode()
        index, made = self.words.find(words.dictionary, self._made)
        rows = index[words.indices.to_numpy(zero_copy_only=False)]
        ends = np.cumsum([0, *map(len, split)])
        return tuple(_slices(m, rows, ends) for m in made)

    def batch(self, texts: pa.Array) -> tuple[list[bytes], list[bytes]]:
        """Ids and decoded bytes of each text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        lists, whole = split_units(texts)
        units = lists.flatten().dictionary_encode()
        index, made = self.units.find(units.dictionary, lambda new: self.coded([unit_text(u) for u in new]))
        rows = index[units.indices.to_numpy(zero_copy_only=False)]
        starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        ids, data = (_slices(m, rows, starts) for m in made)
        rest = np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist()
        for i, x, y in zip(rest, *(self.coded([texts[i].as_py() for i in rest]) if rest else ([], [])), strict=True):
            ids[i], data[i] = x, y
        return ids, data


def _place(tokens: list[tuple[int, int]], token: tuple[int, int]) -> int | None:
    """Where a token stands among tokens in order of their bytes."""
    i = bisect_left(tokens, token)
    return i if i < len(tokens) and tokens[i] == token else None


def _meeting(seam: list[tuple[int, int]], piece: list[tuple[int, int]]) -> tuple[int, int] | None:
    """The first token that both have, as its places."""
    for i, x in enumerate(seam):
        if x[0] >= piece[0][0] and (j := _place(piece, x)) is not None:
            return i, j
    return None


def _slices(made: pa.Array, rows: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """The values of rows joined for each run of rows from one start to the next."""
    data, offsets = in_order(made, rows)
    at = offsets[starts].tolist()
    return [bytes(data[a:b]) for a, b in zip(at, at[1:], strict=False)]  # an array made of views would keep them alive


def _portions(items: list[int], sizes: list[int]) -> Iterator[list[int]]:
    part, total = [], 0
    for i, n in zip(items, sizes, strict=True):
        if part and (len(part) >= WORDS_AT_ONCE or total + n > BYTES_AT_ONCE):
            yield part
            part, total = [], 0
        part.append(i)
        total += n
    if part:
        yield part


def sql_bpe(path: str, pattern: str) -> SqlBpe:
    """The worker's database of a vocabulary, with the words that it knows."""
    return claim(f"ranks of {path}", lambda: SqlBpe(path, pattern))


def _coded_rows(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = sql_bpe(path, pattern)
        for batch in batches:
            ids, data = bpe.batch(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(data, pa.binary())], ["id", "ids", "decoded"])

    return run


def encode_decode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded): little-endian unsigned 32-bit ids of each text, and the bytes that they decode to.

    Null texts are empty texts, which have no ids. Rows without an id and rows
    that repeat give a row each; other columns, whatever their names, are not
    read. Special tokens' names in a text are ordinary text. Words of any length
    are encoded, in pieces of bounded size. An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(_coded_rows(ranks, pattern), f"id {kind}, ids binary, decoded binary")


def bpe_report(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """The contract's columns, one row per document."""
    c = encode_decode(docs, ranks, pattern)
    return c.select(F.col("id").alias("doc_id"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
