"""Loops against plain searches; unions by number against Python's sets."""

import random

import pytest

from tessella.operators import complete as C
from tessella.operators import graph as G
from tessella.operators.areasets import AreaSets


def reach(edges, v):
    out, left = set(), [v]
    while left:
        for a, b in edges:
            if a == left[-1] and b not in out:
                break
        else:
            left.pop()
            continue
        out.add(b)
        left.append(b)
    return out


def graphs():
    r = random.Random(6)
    yield []
    yield [(i, i + 1) for i in range(8)] + [(4, 2), (8, 8), *sorted({(r.randrange(20, 34), r.randrange(20, 34)) for _ in range(16)})]


def test_components(spark):
    for edges in graphs():
        nodes = {v for e in edges for v in e}
        down = {v: reach(edges, v) for v in nodes}
        df = spark.createDataFrame([*edges, *edges[:1], (None, 1)], "a long, b long")
        rings = G.strong_components(df)
        got = {x.v: x.scc for x in rings.collect()}
        assert got == {v: max(w for w in down[v] if v in down[w]) for v in nodes if v in down[v]}
        name = lambda v: got.get(v, v)
        assert {tuple(x) for x in G.condensed(df.where("a is not null"), rings).collect()} == {(name(a), name(b)) for a, b in edges if name(a) != name(b)}


def test_children(spark):
    r = random.Random(7)
    for edges in graphs():
        known = AreaSets(spark)
        own = {v: {r.randrange(6) for _ in range(r.randint(1, 3))} for v in {*range(50, 53), *(v for e in edges for v in e)} if r.random() < 0.7}
        mem = spark.createDataFrame([(a, "relation", b) for a, b in edges] + [(1, "node", 2)], "rel_id long, type string, ref long")
        sets = known.united(spark.createDataFrame([(v, a) for v, s in own.items() for a in s], "rel_id long, area_idx int"), "rel_id")
        got = {x.rel_id: set(x.areas) for x in known.arrays(C.with_children(known, sets, mem), "rel_id").collect()}
        nodes = {*own, *(v for e in edges for v in e)}
        want = {v: set().union(*(own.get(w, set()) for w in {v, *reach(edges, v)})) for v in nodes}
        assert got == {v: s for v, s in want.items() if s}


@pytest.mark.parametrize("local", [10_000, 7, 0])
def test_numbers(spark, local):
    """Held by the driver, as a table from some step on, and as a table throughout."""
    r = random.Random(8)
    known = AreaSets(spark, local)
    told = [(k, [r.randrange(5) for _ in range(r.randint(1, 4))]) for k in range(60)]
    first = known.united(spark.createDataFrame([(k, a) for k, s in told for a in s], "k long, area_idx int"), "k")
    assert {x.k: x.areas for x in known.arrays(first, "k").collect()} == {k: sorted(set(s)) for k, s in told}
    other = known.numbered(spark.createDataFrame([(k, sorted({r.randrange(7), 6})) for k in range(60, 90)] + [(90, [])], "k long, areas array<int>"), "k")
    both = first.union(other)
    assert known.several(both).count() + known.single(both).count() == both.count() == 90
    pairs = both.selectExpr("k div 4 AS k", "set_no")
    got = {x.k: x.areas for x in known.arrays(known.united(pairs, "k"), "k").collect()}
    sets = {x.k: x.areas for x in known.arrays(both, "k").collect()}
    assert got == {j: sorted({a for k, s in sets.items() if k // 4 == j for a in s}) for j in {k // 4 for k in sets}}
    assert known.known.count() == known.known.select("areas").distinct().count() == known.known.select("set_no").distinct().count()


def test_long_chain_into_loop(spark, monkeypatch):
    """A chain of 60 relations ends in a loop of 5: the turns follow its logarithm, and so do the tables that are cut. A fork above it goes level by level."""
    cuts = []
    for module in (G, C):
        monkeypatch.setattr(module, "cut", lambda df, real=module.cut: cuts.append(1) or real(df))
    edges = [(i, i + 1) for i in range(60)] + [(60 + i, 60 + (i + 1) % 5) for i in range(5)] + [(200, 1), (200, 300), (300, 301), (302, 302), (302, 300)]
    known = AreaSets(spark)
    mem = spark.createDataFrame([(a, "relation", b) for a, b in edges], "rel_id long, type string, ref long")
    sets = known.united(spark.createDataFrame([(v, v % 50) for v in {*range(0, 65, 7), 301}], "rel_id long, area_idx int"), "rel_id")
    rings = G.strong_components(mem.selectExpr("rel_id AS a", "ref AS b"))
    assert {tuple(x) for x in rings.collect()} == {(60 + i, 64) for i in range(5)} | {(302, 302)}
    got = {x.rel_id: set(x.areas) for x in known.arrays(C.with_children(known, sets, mem), "rel_id").collect()}
    own = {v: {v % 50} for v in {*range(0, 65, 7), 301}}
    want = {v: set().union(*(own.get(w, set()) for w in {v, *reach(edges, v)})) for v in {v for e in edges for v in e}}
    assert got == {v: s for v, s in want.items() if s}
    assert len(cuts) < 60
