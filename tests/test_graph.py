import itertools
import random

import pytest

from tributary.plans import graph as G


@pytest.fixture(params=[G.LOCAL_EDGES, 0], ids=["collected", "looped"], autouse=True)
def way(request, monkeypatch):
    monkeypatch.setattr(G, "LOCAL_EDGES", request.param)


def random_dag(seed):
    r = random.Random(seed)
    n = r.randint(4, 9)
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n)]
    return sorted(r.sample(pairs, min(len(pairs), r.randint(4, 14))))


def frame(spark, edges):
    return spark.createDataFrame([(f"m.c{a}", f"m.c{b}", "RENAME") for a, b in edges], "`from` string, `to` string, kind string")


def all_paths(edges, node, back=True):
    prev = sorted({a for a, b in edges if b == node})
    if not prev:
        return [[node]]
    return [[node, *p] for a in prev for p in all_paths(edges, a)]


@pytest.mark.parametrize("seed", [1, 7])
def test_against_brute_force(spark, seed):
    edges = random_dag(seed)
    e = G.hops(frame(spark, edges)).cache()
    nodes = sorted({x for p in edges for x in p})
    start, end = edges[0][0], max(b for _, b in edges)
    hops, front = {start: 0}, {start}
    for d in itertools.count(1):
        front = {b for a, b in edges if a in front} - set(hops)
        if not front:
            break
        hops |= dict.fromkeys(front, d)
    found = {r["node"]: (r["depth"], r["via"]) for r in G.downstream(e, f"m.c{start}", 20).collect()}
    assert {k: v[0] for k, v in found.items()} == {f"m.c{k}": v for k, v in hops.items() if v}
    for node, (d, via) in found.items():
        assert (int(via[3:]), int(node[3:])) in edges and hops[int(via[3:])] == d - 1
    paths = G.upstream_paths(e, f"m.c{end}", 20)
    want = sorted([f"m.c{x}" for x in p] for p in all_paths(edges, end) if len(p) > 1)
    assert sorted(r["path"] for r in paths.rows.collect()) == want
    assert not paths.depth_limited and not paths.truncated
    deep = {x: max(len(p) for p in all_paths(edges, x)) - 1 for x in nodes}
    assert {r["node"]: r["depth"] for r in G.depths(e).collect()} == {f"m.c{k}": v for k, v in deep.items()}
    assert G.longest_path(e, f"m.c{end}") == max([f"m.c{x}" for x in p[::-1]] for p in all_paths(edges, end) if len(p) == deep[end] + 1)


def test_limits_cycles_and_ranks(spark):
    chain = G.hops(frame(spark, [(0, 1), (1, 2), (2, 3)]))
    cut = G.downstream(chain, "m.c0", 2)
    assert {r["node"] for r in cut.collect()} == {"m.c1", "m.c2"}
    assert G.more_below(chain, cut, "m.c0", 2)
    assert G.upstream_paths(chain, "m.c3", 2).depth_limited
    many = G.upstream_paths(G.hops(frame(spark, [(0, 2), (1, 2)])), "m.c2", 5, max_paths=1)
    assert many.truncated and many.rows.count() == 1
    loop = G.hops(frame(spark, [(0, 1), (1, 0)]))
    assert {r["node"] for r in G.downstream(loop, "m.c0", 50).collect()} == {"m.c1"}
    with pytest.raises(ValueError):
        G.depths(loop)
    direct = frame(spark, [(0, 1)])
    indirect = spark.createDataFrame([("m.c0", "m.c2", "FILTER"), ("m.c0", "m.c2", "JOIN"), ("m.c1", "m.c3", "SORT")], "`from` string, `to` string, type string")
    every = G.hops(direct, indirect)
    assert {(r["node"], r["label"]) for r in G.downstream(every, "m.c0").collect()} == {("m.c1", "RENAME"), ("m.c2", "JOIN"), ("m.c3", "SORT")}
    labels = {r["node"]: r["label"] for r in G.impact_labels(G.hops(direct), every, "m.c0").collect()}
    assert labels == {"m.c1": "direct", "m.c2": "JOIN", "m.c3": "SORT"}
    assert G.shortest_path(every, "m.c0", "m.c3") == ["m.c0", "m.c1", "m.c3"]
    assert G.shortest_path(every, "m.c3", "m.c0") is None
    named = G.display_names(spark.createDataFrame([("p.m.a",), ("q.m.a",), ("p.m.b",)], "node string"))
    assert {r["node"]: r["display"] for r in named.collect()} == {"p.m.a": "p.m.a", "q.m.a": "q.m.a", "p.m.b": "m.b"}
    assert [r["node"] for r in G.resolve(named, "B").collect()] == ["p.m.b"]
