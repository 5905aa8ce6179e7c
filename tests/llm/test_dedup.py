import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tributary.llm import common
from tributary.llm import exact_dedup as X
from tributary.llm import sentence_dedup as D
from tributary.llm import simhash as S
from tributary.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, start=0):
    return spark.createDataFrame([(i if i is not None else None, t, "en", "s", len(t or "")) for i, t in (enumerate(texts, start) if not isinstance(texts, dict) else texts.items())], DOCS)


def squeeze(t):
    return re.sub("[\x20\x09-\x0d]+", " ", t or "")


def sentences(r, n):
    return " ".join(f"{' '.join(r.choice('alpha beta gamma delta epsilon zeta eta theta'.split()) + str(r.randint(0, 99)) for _ in range(r.randint(1, 14)))}." for _ in range(n))


# Connected components


@pytest.mark.parametrize("local_edges", [500_000, 0])
def test_components_against_union_find(spark, local_edges):
    r = random.Random(3)
    edges = [(r.randint(0, 80), r.randint(0, 80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 540)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), local_edges).collect()}
    want = {x: find(x) for e in edges for x in e}
    assert all(got.get(x, x) == c for x, c in want.items())
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_of_a_hot_key_stay_where_they_are(spark):
    """A star of 100,000 leaves: no task of the join reads more than its share of the hub's rows."""
    n = 100_000
    rows = spark.range(n, numPartitions=8).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(-1).alias("k"), F.col("id").alias("v"))
    facts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("m"))
    got = common.handed(rows, facts, ["k"], "n", n)
    assert got.count() == n and got.filter("k = -1").select("m").distinct().count() == 1
    per_task = got.filter("k = -1").groupBy(F.spark_partition_id().alias("p")).count()
    assert per_task.agg(F.max("count")).first()[0] <= n / 8


# Exact dedup


def test_fingerprints_compose():
    r = random.Random(1)
    for n in (0, 1, 5, X.CHUNK, X.CHUNK + 1, 3 * X.CHUNK + 77):
        data = bytes(r.randrange(256) for _ in range(n))
        cut = r.randint(0, n)
        assert X.combine(X.fingerprint(data[:cut]), X.fingerprint(data[cut:])) == X.fingerprint(data)
        for i, p in enumerate(X.PRIMES):
            h = 0
            for b in data:
                h = (h * X.BASE + b + 1) % p
            assert X.fingerprint(data)[i] == h


TEXTS = ["a  b", "a b", None, "", "a\tb", " a b", "é" * 9000, "é" * 9000, "é" * 8999 + "e", "x", "a b"]


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[squeeze(t)].append(i)
    return sorted((i, min(groups[squeeze(t)]), len(groups[squeeze(t)]), i == min(groups[squeeze(t)]), hashlib.sha256(squeeze(t).encode()).hexdigest()) for i, t in rows)


def test_exact_report(spark):
    rows = list(enumerate(TEXTS))
    got = sorted(map(tuple, X.exact_dedup_report(docs(spark, TEXTS)).collect()))
    assert got == brute_exact(rows)


def test_exact_slices_collisions_and_hot_groups(spark, monkeypatch):
    # Constant fingerprints: everything of a length collides, and the comparison alone tells texts apart.
    monkeypatch.setattr(X, "SLICE", 1000)
    monkeypatch.setattr(X, "PER_SALT", 3)
    rows = list(enumerate([*TEXTS, *["same text"] * 20]))
    assert sorted(map(tuple, X.exact_dedup_report(docs(spark, [t for _, t in rows])).collect())) == brute_exact(rows)
    real = X.fingerprints
    flat = lambda texts: real(texts).withColumns({"h1": F.lit(1).cast("long"), "h2": F.lit(1).cast("long"), "bytes": F.lit(1).cast("long")})
    monkeypatch.setattr(X, "fingerprints", flat)
    same = X.same
    monkeypatch.setattr(X, "same", same)
    got = X.exact_classes(docs(spark, ["p", "q", "p", "q", "r"])).collect()
    # The stream compares with the group's key as it was hashed, so collisions fall into rounds of their own.
    assert {r["id"]: (r["keep_id"], r["group_size"]) for r in got} == {0: (0, 2), 2: (0, 2), 1: (1, 2), 3: (1, 2), 4: (4, 1)}


def test_exact_stage_keeps_one_row_and_all_columns(spark):
    d = spark.createDataFrame([(3, "a b", 1, "k"), (3, "a  b", 2, "k"), (5, "a b", 3, "k"), (None, "z", 4, "k"), (None, "z", 5, "k"), (9, None, 6, "k"), (10, "", 7, "k")], "doc_id long, text string, sha int, keep_id string")
    got = X.exact_dedup(d)
    assert got.columns == d.columns
    assert sorted(str(r["doc_id"]) for r in got.collect()) == ["3", "9", "None"]
    assert X.exact_dedup_report(docs(spark, [])).count() == 0
    assert X.exact_dedup(docs(spark, [])).count() == 0


# SimHash


def brute_simhash(text, words=3):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_classes(fps, bits=2):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_report(spark):
    r = random.Random(5)
    base = [sentences(r, 12) for _ in range(12)]
    texts = [*base, *[b + " tail." for b in base[:6]], base[0], None, "", "  \n", "One", "one two", "ÀB c D", "one two three " * 3000]
    got = S.near_dedup_report(docs(spark, texts)).collect()
    fps = {i: brute_simhash(t) for i, t in enumerate(texts)}
    assert {g["doc_id"]: g["fingerprint"] for g in got} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {g["doc_id"]: g["component_id"] for g in got} == brute_classes(fps)


@pytest.mark.parametrize("max_table", [4096, 4])
def test_links_of_crowded_fingerprints(spark, max_table):
    r = random.Random(2)
    centre = [r.getrandbits(64) for _ in range(4)]
    fps = {c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 3))) for c in centre for _ in range(40)} | {0, 2**64 - 1, 1 << 63}
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    found = S.linked_fingerprints(spark.createDataFrame([(signed(f),) for f in fps], "fp long"), max_table=max_table)
    got = connected_components(found).collect()
    lead = {g["node"]: g["component"] for g in got}
    want = brute_classes({f: f for f in fps})
    parts = lambda m: sorted(sorted(v) for v in _groups(m).values())
    assert parts({signed(f): lead.get(signed(f), signed(f)) for f in fps}) == parts({signed(f): want[f] for f in fps})


def _groups(m):
    out = defaultdict(list)
    for k, v in m.items():
        out[v].append(k)
    return out


def test_similar_stage_finds_near_copies(spark):
    r = random.Random(8)
    base = [sentences(r, 40) for _ in range(25)]

    def edit(t, n):
        w = t.split()
        for i in r.sample(range(len(w)), n):
            w[i] = "changed"
        return " ".join(w)

    texts = [*base, *[edit(b, 2) for b in base], edit(base[0], 60), "", None, "short one", "short one two"]
    d = docs(spark, texts).withColumn("row", F.lit("clash")).withColumn("key", F.lit(1))
    sets = {i: set(S.shingle_hashes(t, 5).tolist()) for i, t in enumerate(texts)}
    drop = set()
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                drop.add(b)
    kept = S.similar_dedup(d)
    assert kept.columns == d.columns
    assert {x["doc_id"] for x in kept.collect()} == set(range(len(texts))) - drop
    assert len(drop) >= 20
    assert S.similar_dedup(docs(spark, [])).count() == 0
    assert S.near_dedup_report(docs(spark, [])).count() == 0


def on_template(r, n, shared, own, changed):
    """n texts of ``shared`` common words and ``own`` words each, and a copy of each with ``changed`` other words."""
    word = lambda: f"w{r.randint(0, 10**9)}"
    common = [word() for _ in range(shared)]
    texts = [[word() for _ in range(own)] for _ in range(n)]
    copies = [[word() if j in at else w for j, w in enumerate(t)] for t in texts for at in [set(r.sample(range(own), changed))]]
    return [" ".join(common + t) for t in texts], [" ".join(common + t) for t in copies]


def jaccard(a, b):
    x, y = (set(S.shingle_hashes(t, 5).tolist()) for t in (a, b))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("max_table", [4096, 64])
def test_similar_links_compare_whole_keys(spark, max_table):
    # Keys of some hundred rows; a copy stands 500 ids after its original.
    first, second = on_template(random.Random(8), 500, 200, 110, 5)
    want = {(i, i + 500) for i in range(500) if jaccard(first[i], second[i]) >= 0.8}
    assert len(want) > 400
    got = {tuple(e) for e in S.similar_links(docs(spark, first + second), max_table=max_table).collect()}
    assert len(want & got) >= 0.99 * len(want) and not {e for e in got if e[1] - e[0] != 500}


def test_similar_links_on_a_long_template(spark):
    # Copies stand beside their originals; every key's first row is within the radius of most others, and too far by its shingles.
    first, second = on_template(random.Random(9), 500, 300, 110, 5)
    texts = [t for pair in zip(first, second, strict=True) for t in pair]
    assert jaccard(texts[0], texts[2]) < 0.65
    want = {(2 * i, 2 * i + 1) for i in range(500) if jaccard(first[i], second[i]) >= 0.8}
    got = {tuple(e) for e in S.similar_links(docs(spark, texts)).collect()}
    print("recall", len(want & got), len(want))
    assert len(want & got) >= 0.99 * len(want) and got <= want


def test_simhash_nulls_and_repeats(spark):
    d = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (None, "other words here now")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in S.near_dedup_report(d).collect())
    assert got == [("4", "4"), ("4", "4"), ("None", "4"), ("None", "None")]
    assert [r["doc_id"] for r in S.near_dedup(d, words=3).collect() if r["doc_id"] is not None] == [4]


# Substring dedup


def test_pieces_cover_the_text():
    r = random.Random(4)
    for text in ["", " ", "a", "a.b", "One. Two! Three?\n\nFour", "v1.2 of it. " * 30, sentences(r, 50), "word " * 500, "\n\n x", "x\n\n", "... !!!"]:
        ends, words, hashes = D.pieces(text)
        assert ends == sorted(ends) and ends[-1] == len(text) and len(ends) == len(words) == len(hashes)
        assert sum(words) == len(text.split())


@pytest.mark.parametrize("per_sentence", [1, 3, 5, 12, 20, 1000])
def test_every_spliced_passage_holds_a_run(per_sentence):
    r = random.Random(per_sentence)

    def prose(n, k):
        return [f"w{r.randint(0, 3000)}" + ("." if i % k == k - 1 else "") for i in range(n)]

    def found(text):
        _, words, hashes = D.pieces(text)
        return {tuple(hashes[a : b + 1]) for a, b in zip(*D.runs(words, D.MIN_PIECES, D.MIN_WORDS), strict=True)}

    def between(passage):
        return found(" ".join(prose(r.randint(0, 60), 15) + passage + prose(r.randint(0, 60), 11)))

    passages = [prose(51, per_sentence) for _ in range(100)]
    missed = sum(not between(p) & between(p) for p in passages)
    print("missed", per_sentence, missed)
    assert not missed


def brute_substring(texts):
    first, spans = {}, {}
    for i, t in texts:
        ends, words, hashes = D.pieces(t or "")
        ends = [0, *ends]
        spans[i] = []
        for a in range(len(words)):
            for b in range(a + D.MIN_PIECES - 1, len(words)):
                enough = sum(words[a : b + 1]) >= D.MIN_WORDS
                shorter_end = b > a + D.MIN_PIECES - 1 and sum(words[a:b]) >= D.MIN_WORDS
                shorter_start = b > a + D.MIN_PIECES - 1 and sum(words[a + 1 : b + 1]) >= D.MIN_WORDS
                if enough and not (shorter_end and shorter_start):
                    k = tuple(hashes[a : b + 1])
                    spans[i].append((k, ends[a], ends[b + 1]))
                    first[k] = min(first.get(k, (i, ends[a])), (i, ends[a]))
    out = {}
    for i, t in texts:
        gone = set()
        for k, a, b in spans[i]:
            if first[k] != (i, a):
                gone |= set(range(a, b))
        out[i] = "".join(c for j, c in enumerate(t or "") if j not in gone)
    return out


@pytest.mark.parametrize("dealt", [False, True])
def test_substring_report(spark, monkeypatch, dealt):
    if dealt:  # every repeated hash is one of many rows
        monkeypatch.setattr(D, "SORTED_TOGETHER", 1)
        monkeypatch.setattr(D, "COUNTED_ONE_IN", 1)
        monkeypatch.setattr(D, "partitions", lambda spark: 1000)
    r = random.Random(9)
    passage = sentences(r, 12)
    texts = [(i, f"{sentences(r, 6)}\n{passage if i % 2 else ''} {sentences(r, 5)}") for i in range(10)]
    texts += [(20, passage), (21, passage + "\n" + passage), (22, None), (23, ""), (24, "unique " + "é" * 50)]
    d = spark.createDataFrame(texts, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("cuts", F.lit(2))
    got = {x["doc_id"]: x["text"] for x in D.substring_report(d).collect()}
    want = brute_substring(texts)
    assert {k: v or "" for k, v in got.items()} == want
    assert passage[40:-5] in got[1] and passage[60:-60] not in got[3] and got[24] == texts[-1][1]
    stage = D.substring_dedup(d)
    assert stage.columns == d.columns and {x["doc_id"]: x["text"] or "" for x in stage.collect()} == want


def test_substring_edges(spark):
    long = sentences(random.Random(1), 10)
    d = spark.createDataFrame([(None, long), (1, long), (1, long), (2, long)], "doc_id long, text string")
    got = sorted((str(x["doc_id"]), x["text"] == long) for x in D.substring_dedup(d).collect())
    assert got == [("1", True), ("1", True), ("2", False), ("None", True)]
    assert D.substring_report(docs(spark, [])).count() == 0
    assert np.array_equal(D.runs([5] * 3, 2, 100)[0], [])
