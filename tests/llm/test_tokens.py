import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tributary.llm import bpe_sql, packing, token_files
from tributary.llm.tokens import WordIds

ODD = ["", None, " a", "a ", "a  b", "a\n\nb", "x \n y", "tab\tb", "no break", "<|endoftext|> hi", "A <|startoftext|>b<|EndOfText|>", "a\r\nb", "é ü", "§ ~ §a ¬", "\n", "  ", "a\n", "it's 12 34\nfoo's\nA", "İstanbul ΣΑΣ", "\x00 b\x1cc", "ab " * 5 + "c", "don't\nDON'T ﬁ Å", "foo...!?", "日本語。", "a_b x1", "aaaaaaaaaaaaaaaaaaaa" * 30]


def library(name):
    return Tokenizer.from_file(P.path(name))


@pytest.fixture(scope="module")
def coders():
    return {name: (WordIds(P.path(name), level), library(name)) for name, level in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False))}


def ids_of(coder, texts):
    ids, starts = coder.ids(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(starts, starts[1:], strict=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_word_ids_equal_the_library(coders, name):
    coder, lib = coders[name]
    for texts in (ODD, ODD[::-1], []):
        assert ids_of(coder, texts) == [lib.encode(t or "", add_special_tokens=False).ids for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab Zé\n'.,1s\t §ßİ日-_")), max_size=25), max_size=4))
def test_word_ids_of_any_text(texts):
    for name, level in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        coder, lib = _cached(name, level)
        assert ids_of(coder, texts) == [lib.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endof", "text|>", " ", "  ", "\n", "a", "see", "É", "."]), max_size=8).map("".join), max_size=4))
def test_added_tokens_have_the_library_s_ids(texts):
    for name, level in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        coder, lib = _cached(name, level)
        assert ids_of(coder, texts) == [lib.encode(t, add_special_tokens=False).ids for t in texts]


_kept: dict = {}


def _cached(name, level):
    if name not in _kept:
        _kept[name] = (WordIds(P.path(name), level), library(name))
    return _kept[name]


# SQL BPE


@pytest.fixture(scope="module")
def bpe():
    b = bpe_sql.SqlBpe(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    return b, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=b.ranks, special_tokens={})


def test_sql_bpe_equals_tiktoken(bpe):
    b, e = bpe
    r = random.Random(6)
    texts = [*ODD, "banana" * 120, "x" * 900, "".join(r.choice("abcdeé ") for _ in range(600)), "-=" * 200]
    ids, data = b.batch(pa.array(texts, pa.string()))
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [e.encode_ordinary(t or "") for t in texts]
    assert data == [(t or "").encode() for t in texts]


def test_long_words_equal_tiktoken(bpe):
    b, e = bpe
    r = random.Random(7)
    letters = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    texts = [letters("etaoinshrdlucmfwypvbgkjqxz", 12_000), "a" * 5_001, "ab" * 2_000 + "b", "0" * 4_099, "=" * 3_000, "-=" * 1_500, letters([chr(c) for c in range(0x4E00, 0x9FA5)], 3_000), letters("0123456789", 4_000), letters("ACGT", 4_000)]
    ids, data = b.coded(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [e.encode_ordinary(t) for t in texts]
    assert data == [t.encode() for t in texts]


def test_pieces_of_any_word_join(bpe, monkeypatch):
    """Tiny pieces, so that seams fail to meet and the sweep goes on."""
    b, e = bpe
    for name, n in (("PIECE", 8), ("BEFORE", 3), ("AFTER", 4), ("SWEEP", 9)):
        monkeypatch.setattr(bpe_sql, name, n)
    r = random.Random(8)
    for _ in range(60):
        alphabet = r.choice(["ab", "abc", "einrst", "a", "=-", "é日", "0123", "the"])
        t = "".join(r.choice(alphabet) for _ in range(r.randint(9, 120)))
        assert np.frombuffer(b.coded([t])[0][0], "<u4").tolist() == e.encode_ordinary(t), t


def test_bpe_report(spark, bpe):
    texts = [*ODD, ODD[4]]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit(1))
    got = {r["doc_id"]: tuple(r)[1:] for r in bpe_sql.bpe_report(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    for i, t in enumerate(texts):
        x = bpe[1].encode_ordinary(t or "")
        assert got[i] == (len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


# Packing


def per_item_best_fit(counts, capacity):
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fit = [i for i, r in enumerate(rooms) if r >= length]
            if fit:
                rooms[min(fit, key=lambda i: rooms[i])] -= length
            else:
                rooms.append(capacity - length)
    return len(rooms)


def test_plan_equals_best_fit_item_by_item():
    r = random.Random(1)
    for _ in range(60):
        capacity = r.choice([8, 17, 50])
        counts = {n: r.randint(1, 20) for n in r.sample(range(1, capacity + 1), r.randint(1, capacity))}
        slots = packing.plan(counts, capacity)
        assert packing.check_no_overlap([(q + i, o, n) for n, _, k, q, o in slots for i in range(k)], capacity) == per_item_best_fit(counts, capacity)
        for n, total in counts.items():
            ranks = sorted((a, k) for m, a, k, _, _ in slots if m == n)
            assert [a for a, _ in ranks] == [sum(k for _, k in ranks[:i]) for i in range(len(ranks))] and sum(k for _, k in ranks) == total
    assert packing.plan({}) == []


def test_packed_report(spark):
    texts = [*ODD, "word " * 5000, "word " * 2047, *["hi"] * 300]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("length", F.lit("clash"))
    lib = library("byte_bpe_50k.json")
    want = {i: [*lib.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    rows = packing.packed_report(d, P.path("byte_bpe_50k.json")).collect()
    seen = {}
    for r in rows:
        part = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
        seen.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
    for i, parts in seen.items():
        parts.sort()
        assert [p[0] for p in parts] == list(range(len(parts))) and sum(p[2] for p in parts) == len(want[i])
        assert all(p[2] == 2048 for p in parts[1:]) and (len(parts) == 1 or len(want[i]) > 2048)
    used = packing.check_no_overlap([(r["sequence_id"], r["offset"], r["length"]) for r in rows])
    assert used == -(-sum(map(len, want.values())) // 2048)
    assert packing.packed_report(d.limit(0), P.path("byte_bpe_50k.json")).count() == 0


def test_sequences_hold_their_documents(spark):
    d = spark.createDataFrame([(1, "a b c"), (2, "d"), (None, "e"), (2, "d")], "doc_id long, text string")
    packed = packing.pack(packing.token_pieces(d, P.path("byte_bpe_50k.json")))
    (only,) = packing.sequences(packed).collect()
    assert sorted(str(x) for x in only["doc_ids"]) == ["1", "2", "2", "None"] and len(only["ids"]) == 4 * sum(r["length"] for r in packed.collect())


# Token files


def test_values_round_trip():
    r = random.Random(2)
    for n in (0, 1, 3, 4, 5, 1000):
        v = np.array([r.choice([r.randrange(256), r.randrange(1 << 16), r.randrange(1 << 24), r.randrange(1 << 32)]) for _ in range(n)], np.uint32)
        control, data = token_files.encode_values(v)
        assert len(control) == -(-n // 4) and np.array_equal(token_files.decode_values(control, data, n), v)


def test_file_report(spark, monkeypatch):
    monkeypatch.setattr(token_files, "DOCS_PER_FILE", 9)
    monkeypatch.setattr(token_files, "BLOCK", 50)
    monkeypatch.setattr(token_files, "TOKENS_PER_FILE", 40)
    texts = [*ODD, "Some More words " * 40]
    order = random.Random(3).sample(range(len(texts)), len(texts))
    d = spark.createDataFrame([(i * 7 - 20, texts[i]) for i in order], "doc_id long, text string").repartition(3)
    lib = library("word_bpe_49k.json")
    want, at = [], 0
    for i, t in enumerate(texts):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i * 7 - 20, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = token_files.token_file_report(d, P.path("word_bpe_49k.json"))
    assert sorted(map(tuple, got.collect())) == want
    assert token_files.token_file_report(d.limit(0), P.path("word_bpe_49k.json")).count() == 0
    with pytest.raises(ValueError):
        token_files.token_file_report(spark.createDataFrame([(None, "a")], "doc_id long, text string"), P.path("word_bpe_49k.json"))
    twice = token_files.token_file_report(spark.createDataFrame([(1, "a"), (1, "a")], "doc_id long, text string"), P.path("word_bpe_49k.json"))
    assert sorted(r["start"] for r in twice.collect()) == [0, 2]
