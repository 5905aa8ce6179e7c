"""Token ids of whole texts by the tokenizers library, each distinct word encoded once.

Both vocabularies split a text into words before they merge, so a text's ids are
its words' ids one after the other. Arrow splits a batch of texts and numbers
its distinct words; a worker keeps the ids of words it has seen (a bounded
table, emptied when full), and only new words go to the library, many in one
string around a separator. Texts for which a split at white space could differ
from the library's own go to it whole, and so do texts that hold the string of
an added token, which the library gives that token's id.
"""

from __future__ import annotations

import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tributary.llm.common import claim

#: Bytes of words and their ids that a worker keeps; the table starts anew when full.
KEPT_BYTES = 24 << 20
#: Words given to the library in one string.
AT_ONCE = 2_000

#: Marks after a word of letters, up to three: a word of their own to both vocabularies.
_MARKS = ".,;:!?"
#: The printable characters that byte-level vocabularies write for bytes.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))}

#: Texts with white space that byte-level words don't split at, or split at by looking around it.
_WHOLE = r"[\x09\x0b-\x0d\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]|  | \n|\n |\n\n|^[ \n]|[ \n]$|^$"


def split_units(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Units of byte-level texts that no word spans (a list array), and which texts must go whole.

    Of "a b\\nc": "\\ra" at the start, "b" after a space, "\\nc" after a line's end.
    """
    whole = pc.match_substring_regex(texts, _WHOLE)
    safe = pc.replace_substring(pc.if_else(whole, pa.scalar("", pa.large_string()), texts), "\n", " \n")
    marked = pc.binary_join_element_wise(pa.scalar("\r", pa.large_string()), safe, pa.scalar("", pa.large_string()))
    return pc.split_pattern(marked, " "), whole


def unit_text(unit: str) -> str:
    """The characters that a unit stands for."""
    return unit[1:] if unit[:1] == "\r" else unit if unit[:1] == "\n" else " " + unit


class KnownWords:
    """Words and what was made of each (one or more byte strings), as Arrow columns: compact, and looked up a batch at a time."""

    def __init__(self, values: int = 1, limit: int = KEPT_BYTES):
        self.limit, self.values = limit, values
        self._empty()

    def _empty(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.made = [pa.array([], pa.large_binary()) for _ in range(self.values)]

    def find(self, distinct: pa.Array, make) -> tuple[np.ndarray, list[pa.Array]]:
        """For each of the distinct words its row in the columns returned; ``make`` gives the columns of new words."""
        if self.words.nbytes + sum(m.nbytes for m in self.made) > self.limit:
            self._empty()
        at = pc.index_in(distinct, value_set=self.words)
        new = np.array(at.is_null())
        index = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        if new.any():
            words = distinct.filter(pa.array(new))
            columns = make(words.to_pylist())
            index[new] = len(self.words) + np.arange(len(words))
            self.made = [pa.concat_arrays([old, pa.array(c, pa.large_binary())]) for old, c in zip(self.made, columns, strict=True)]
            self.words = pa.concat_arrays([self.words, words])
        return index, self.made


def in_order(made: pa.Array, rows: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The values of some rows one after the other, and where each begins (one more than there are rows)."""
    taken = made.take(pa.array(rows))
    if not len(taken):
        return memoryview(b""), np.zeros(1, np.int64)
    buffers = taken.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, len(taken) + 1, 8 * taken.offset)
    return memoryview(buffers[2] if buffers[2] is not None else b"").cast("B"), offsets


class WordIds:
    """ids(texts) -> unsigned 32-bit ids of each text in one array, and where each text's ids begin."""

    def __init__(self, path: str, byte_level: bool):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.byte_level = byte_level
        #: A string that is one id wherever it stands between words.
        self.mark = "\n" if byte_level else next(c for c in "§~^|" if len(self._encode(c)) == 1)
        (self.mark_id,) = self._encode(self.mark)
        self.model = self.library.model
        #: The ids of a line's end, which a unit may begin with.
        self.line = self._encode("\n").tobytes()
        #: Strings that the library takes for tokens of their own, wherever they stand.
        self.added = sorted({t.content.lower() for t in self.library.get_added_tokens_decoder().values()})
        self.known = KnownWords()
        self.marks: dict[str, bytes] = {}

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _units(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Words whose ids, one after the other, are each text's (a list array), and which texts must go whole."""
        if not self.byte_level:  # lower-cased by the vocabulary, white space dropped
            for c in "\t\n\x0b\x0c\r":
                texts = pc.replace_substring(texts, c, " ")
            return pc.split_pattern(pc.ascii_lower(texts), " "), pa.array(np.zeros(len(texts), bool))
        return split_units(texts)

    def _learn(self, units: list[str]) -> list[bytes]:
        """Ids of each unit. Words of letters, with or without marks, go to the model one by one; others together."""
        byte_level, tokenize, marks = self.byte_level, self.model.tokenize, self.marks
        out: list = []
        others: list[tuple[int, str]] = []
        for u in units:
            line = byte_level and u[:1] == "\n"
            body = u[1:] if line or byte_level and u[:1] == "\r" else u
            word = core = body.rstrip(_MARKS)
            if not core.isalpha() or len(body) - len(core) > 3:
                others.append((len(out), u))
                out.append(b"")
                continue
            if not core.isascii():
                if not byte_level and (core != core.lower() or not unicodedata.is_normalized("NFC", core)):
                    others.append((len(out), u))
                    out.append(b"")
                    continue
                word = "".join([_BYTES[b] for b in core.encode()])
            blob = array("I", [t.id for t in tokenize("Ġ" + word if byte_level and body is u else word)]).tobytes()
            if len(core) < len(body):
                after = body[len(core) :]
                if after not in marks:
                    marks[after] = self._encode(after).tobytes()
                blob += marks[after]
            out.append(self.line + blob if line else blob)
        for i in range(0, len(others), AT_ONCE):
            self._together(others[i : i + AT_ONCE], out)
        return out

    def _together(self, part: list[tuple[int, str]], out: list[bytes]) -> None:
        plain = [u[1:] if self.byte_level and u[:1] in ("\r", "\n") else " " + u if self.byte_level else u for _, u in part]
        usable = [bool(p) and self.mark not in p for p in plain]
        together = [p for p, ok in zip(plain, usable, strict=True) if ok]
        words = iter(())
        if together:
            ids = self._encode(("\n" if self.byte_level else f" {self.mark} ").join(together))
            ends = [*np.flatnonzero(ids == self.mark_id).tolist(), len(ids)]
            if len(ends) != len(together):
                raise AssertionError("the separator is not one id of its own")
            data = ids.tobytes()
            words = iter([data[4 * (a + 1) : 4 * b] for a, b in zip([-1, *ends], ends, strict=False)])
        for (at, u), p, ok in zip(part, plain, usable, strict=True):
            own = next(words) if ok else self._encode(p).tobytes()
            out[at] = self.line + own if self.byte_level and u[:1] == "\n" else own

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        own_tokens = pa.array(np.zeros(len(texts), bool))
        for token in self.added:
            own_tokens = pc.or_(own_tokens, pc.match_substring(texts, token, ignore_case=True))
        lists, whole = self._units(pc.if_else(own_tokens, pa.scalar("", pa.large_string()), texts))
        whole = pc.or_(whole, own_tokens)
        words = lists.flatten().dictionary_encode()
        index, (made,) = self.known.find(words.dictionary, lambda new: [self._learn(new)])
        data, offsets = in_order(made, index[words.indices.to_numpy(zero_copy_only=False)])
        ids = np.frombuffer(data, "<u4", offsets[-1] // 4) if offsets[-1] else np.zeros(0, "<u4")
        starts = offsets[lists.offsets.to_numpy() - lists.offsets[0].as_py()] // 4
        rest = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        if not len(rest):
            return ids, starts
        own = dict(zip(rest.tolist(), [self._encode(texts[i].as_py()) for i in rest.tolist()], strict=True))
        pieces = [own[i] if i in own else ids[starts[i] : starts[i + 1]] for i in range(len(texts))]
        return np.concatenate(pieces), np.concatenate([[0], np.cumsum([len(p) for p in pieces])])


def word_ids(path: str, byte_level: bool) -> WordIds:
    """The worker's encoder of a vocabulary, with the words that it knows."""
    return claim(f"words of {path}", lambda: WordIds(path, byte_level))
