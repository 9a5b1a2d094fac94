"""Properties that all tilings must have."""

import itertools
import os

import numpy as np
import pytest

import __spark_entry__ as entry
from tessella.operators import problems as P
from tessella.operators import solver as S
from tessella.plans import lens as L
from tessella.sources import texts as X

SHIFT = 11
BOUNDS = (40 << 16, 5 << 16, (40 << 16) + (64 << SHIFT), (5 << 16) + (96 << SHIFT))


def cells(seed, n=4000):
    r = np.random.default_rng(seed)
    x, y = (r.beta(0.5, 2, n) * 96).astype(int), (r.beta(2, 0.7, n) * 64).astype(int)
    got = {}
    for a, b in zip(x.tolist(), y.tolist()):
        got[a, b] = got.get((a, b), 0) + 1
    return [(a, b, c) for (a, b), c in got.items()]


def apart(tiles):
    return not any(a.x < b.x + b.w and b.x < a.x + a.w and a.y < b.y + b.h and b.y < a.y + a.h for a, b in itertools.combinations(tiles, 2))


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("most", [100, 300, 5000])
@pytest.mark.parametrize("trim", [True, False])
def test_split(seed, most, trim):
    m = S.DensityMap(cells(seed), BOUNDS, SHIFT)
    for tiles in (S.split(m, most, 2000, trim), S.bisect_tiles(m, most)):
        assert apart(tiles)
        assert sum(m.count(t) for t in tiles) == m.count(m.whole)
        for t in tiles:
            r = m.rect(t)
            assert all(e % (1 << SHIFT) == b % (1 << SHIFT) for e, b in zip(r, BOUNDS))
    assert all(m.count(t) <= most or (t.w, t.h) == (1, 1) for t in S.split(m, most, 2000, trim))


def test_number_of_tiles():
    m = S.DensityMap(cells(1), BOUNDS, SHIFT)
    assert abs(len(S.split_by_number(m, 8, 20_000)) - 8) <= 1


def test_parallel_pieces(spark):
    m = S.DensityMap(cells(2, 8000), BOUNDS, SHIFT)
    tiles = S.split_parallel(spark, m, 25, 1000)
    assert apart(tiles) and sum(m.count(t) for t in tiles) == m.count(m.whole)


def test_pieces_on_executors_only(spark, monkeypatch):
    """Tiles and their order are those of the driver's solver, which is not asked for any piece."""
    m = S.DensityMap(cells(2, 8000), BOUNDS, SHIFT)
    want = S.split(m, 25, 1000)
    parts = [p for t in S.without_gaps(m, m.trimmed(m.whole)) for p in S.pieces(m, t, 25)]
    assert len(parts) > 4
    monkeypatch.setattr(S, "improve", lambda *_, real=S.improve, here=os.getpid(): real(*_) if os.getpid() != here else pytest.fail("a piece on the driver"))
    assert S.split_parallel(spark, m, 25, 1000) == want


def test_solver_queries_ask_executors(spark, sf, monkeypatch):
    monkeypatch.setattr(S, "split", lambda *a, real=S.split, **k: real(*a, **k) if k.get("solve") else pytest.fail("solved on the driver"))
    total = L.clustered_nodes(spark, sf).count()
    assert [entry.queries()[name](spark, sf).first().n for name in ("solved_total", "solved_nodes")] == [total, total]
    assert sum(r.n for r in entry.queries()["solver_tiles"](spark, sf).collect()) == total


def test_trimmed():
    m = S.DensityMap([(3, 4, 2), (7, 9, 1), (0, 20, 5)], BOUNDS, SHIFT)
    assert m.trimmed(m.whole) == (0, 4, 8, 17)
    assert m.trimmed(S.Tile(1, 0, 60, 15)) == (3, 4, 5, 6)
    assert m.trimmed(S.Tile(1, 0, 2, 30)) is None


def test_polygons():
    deg = 360 / (1 << 24)
    box = lambda a, b, c, d: [(True, [(b * deg, a * deg), (d * deg, a * deg), (d * deg, c * deg), (b * deg, c * deg), (b * deg, a * deg)])]
    a0, b0, a1, b1 = BOUNDS
    mid = (b0 + b1) // 2
    got = S.split_polygons(cells(3), BOUNDS, SHIFT, {"west": box(a0, b0, a1, mid + (8 << SHIFT)), "east": box(a0, mid - (8 << SHIFT), a1, b1)}, 300)
    assert set(got) == {frozenset({"west"}), frozenset({"east"}), frozenset({"west", "east"})}
    flat = [r for rs in got.values() for r in rs]
    assert not any(a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3] for a, b in itertools.combinations(flat, 2))


def test_empty():
    assert S.split(S.DensityMap([], BOUNDS, SHIFT), 10) == []


def test_mean_bisect(spark):
    from tessella.plans import lens

    nodes = lens.nodes(spark, "/root/testdata/sf0.001")
    rects = S.mean_bisect(spark, nodes, 60)
    own = [(r.map_lat, r.map_lon) for r in nodes.collect()]
    held = [sum(a <= y < c and b <= x < d for y, x in own) for a, b, c, d in rects]
    assert sum(held) == len(own) and max(held) <= 60


@pytest.mark.parametrize("seed", range(6))
def test_disjoint_and_cover(seed):
    r = np.random.default_rng(seed)
    areas = [(int(a), int(b), int(a + h), int(b + w)) for a, b, h, w in r.integers(1, 40, (6, 4))]
    world = (0, 0, 100, 100)
    parts = P.disjoint(areas)
    rest = P.cover(parts, world)
    assert P.extent(parts) + P.extent(rest) == P.extent([world])
    assert not any(a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3] for a, b in itertools.combinations(parts + rest, 2))
    for p in parts:
        for a in areas:
            meets = p[0] < a[2] and a[0] < p[2] and p[1] < a[3] and a[1] < p[3]
            assert not meets or (a[0] <= p[0] and a[1] <= p[1] and a[2] >= p[2] and a[3] >= p[3])


@pytest.mark.parametrize("seed", range(6))
def test_outline(seed):
    r = np.random.default_rng(seed)
    rects = [(int(a), int(b), int(a + h), int(b + w)) for a, b, h, w in r.integers(1, 12, (5, 4))]
    rings = X.outline(rects)
    area = sum(abs(sum(p[1] * q[0] - q[1] * p[0] for p, q in zip(g, g[1:]))) / 2 * (1 if outer else -1) for outer, g in rings)
    full = {(y, x) for a, b, c, d in rects for y in range(a, c) for x in range(b, d)}
    assert area == len(full)
    for _, g in rings:
        assert g[0] == g[-1] and all((p[0] == q[0]) != (p[1] == q[1]) for p, q in zip(g, g[1:]))
