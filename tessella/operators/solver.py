"""Tiles from the density map: guillotine cuts over a summed-area table, on the driver.

The map is a bounded grid (8192 by 3870 cells at resolution 13), collected sparse. A rectangle is cut in two, the halves
in two again, until none has more nodes than allowed; positions near the median come first, the emptier half is solved
first, hopeless rectangles are remembered, and a budget of rejected rectangles replaces wall-clock limits, so that a run
can be repeated. Solutions are compared by niceness, number of tiles and least filled tile.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tessella.functions import units as U

Rect = tuple[int, int, int, int]
LARGEST_DEGREES = (85, 90)  # a tile may be so high and so wide unless the limit is huge
HUGE = 10_000_000


class Tile(NamedTuple):
    x: int
    y: int
    w: int
    h: int


class DensityMap:
    """Counts of cells of 2^shift units over bounds, with prefix sums in both directions.

    cells: x, y and n, an array each in a tuple, or a list of the three; mask: cells within a polygon.
    """

    def __init__(self, cells, bounds: Rect, shift: int, mask: np.ndarray | None = None):
        self.bounds, self.shift = bounds, shift
        self.width, self.height = max(1, bounds[3] - bounds[1] >> shift), max(1, bounds[2] - bounds[0] >> shift)
        if 24 * self.width * self.height > GRID_BYTES:
            raise MemoryError(f"a grid of {self.width} by {self.height} cells is too large for the driver: choose a lower resolution")
        grid = np.zeros((self.width, self.height), np.int64)
        x, y, n = (np.asarray(v, np.int64) for v in (cells if isinstance(cells, tuple) else np.array(cells, np.int64).reshape(-1, 3).T))
        np.add.at(grid, (x, y), n)
        self.mask = mask
        if mask is not None:
            grid[~mask] = 0
        self.grid = grid
        self.sums = self._prefix(grid)
        self.outside = None if mask is None else self._prefix((~mask).astype(np.int64))
        edges = U.UNITS / 360
        self.cosine = np.cos(np.radians((bounds[0] + (np.arange(self.height + 1) << shift)) / edges))

    @staticmethod
    def _prefix(grid: np.ndarray) -> np.ndarray:
        out = np.zeros((grid.shape[0] + 1, grid.shape[1] + 1), np.int64)
        out[1:, 1:] = grid.cumsum(0).cumsum(1)
        return out

    @property
    def whole(self) -> Tile:
        return Tile(0, 0, self.width, self.height)

    def _sum(self, s: np.ndarray, t: Tile) -> int:
        return int(s[t.x + t.w, t.y + t.h] - s[t.x, t.y + t.h] - s[t.x + t.w, t.y] + s[t.x, t.y])

    def count(self, t: Tile) -> int:
        return self._sum(self.sums, t)

    def outside_share(self, t: Tile) -> float:
        return 0.0 if self.outside is None else self._sum(self.outside, t) / (t.w * t.h)

    def lines(self, t: Tile, axis: int) -> np.ndarray:
        """Running sums over the tile's columns (axis 0) or rows (axis 1)."""
        s = self.sums
        if axis == 0:
            return (s[t.x + 1 : t.x + t.w + 1, t.y + t.h] - s[t.x + 1 : t.x + t.w + 1, t.y]) - (s[t.x, t.y + t.h] - s[t.x, t.y])
        return (s[t.x + t.w, t.y + 1 : t.y + t.h + 1] - s[t.x, t.y + 1 : t.y + t.h + 1]) - (s[t.x + t.w, t.y] - s[t.x, t.y])

    def aspect(self, t: Tile) -> float:
        """The larger side over the smaller, with widths at their latitude."""
        low, high = self.cosine[t.y], self.cosine[t.y + t.h]
        bottom = self.bounds[0] + (t.y << self.shift)
        shrink = 1.0 if bottom < 0 < bottom + (t.h << self.shift) else max(low, high)
        r = t.w * shrink / t.h
        return max(r, 1 / r) if r > 0 else math.inf

    def trimmed(self, t: Tile) -> Tile | None:
        """Without empty lines at the edges."""
        n = self.count(t)
        if n == 0:
            return None
        cols, rows = self.lines(t, 0), self.lines(t, 1)  # they rise from the first line with nodes to the last
        x0, y0 = int(cols.searchsorted(1)), int(rows.searchsorted(1))
        return Tile(t.x + x0, t.y + y0, int(cols.searchsorted(n)) - x0 + 1, int(rows.searchsorted(n)) - y0 + 1)

    def rect(self, t: Tile) -> Rect:
        a, b, s = self.bounds[0], self.bounds[1], self.shift
        return (a + (t.y << s), b + (t.x << s), a + (t.y + t.h << s), b + (t.x + t.w << s))

    def small_enough(self, t: Tile) -> bool:
        unit = 360 / U.UNITS * (1 << self.shift)
        return t.h * unit <= LARGEST_DEGREES[0] and t.w * unit <= LARGEST_DEGREES[1]


def cut(t: Tile, axis: int, at: int) -> tuple[Tile, Tile]:
    """Two halves at a position counted from the tile's own lower left."""
    return (t._replace(w=at), t._replace(x=t.x + at, w=t.w - at)) if axis == 0 else (t._replace(h=at), t._replace(y=t.y + at, h=t.h - at))


class Solution(NamedTuple):
    tiles: list[Tile]
    worst_aspect: float
    least: int
    low: int  # tiles below a third of the limit

    def nice(self, most: int) -> bool:
        n = len(self.tiles)
        return self.worst_aspect <= 4 and (n == 1 or self.least >= most / 3 or self.low <= max(1, n // 50) or self.low < 0.03 * n)

    def rank(self, most: int) -> tuple:
        """Lower is better."""
        return (not self.nice(most), len(self.tiles), -self.least, self.worst_aspect)


def describe(m: DensityMap, tiles: list[Tile], most: int) -> Solution:
    counts = [m.count(t) for t in tiles]
    return Solution(tiles, max((m.aspect(t) for t in tiles), default=1.0), min(counts, default=0), sum(c < most / 3 for c in counts))


class Search:
    """One search for given limits."""

    def __init__(self, m: DensityMap, most: int, least: int, aspect: float, budget: int, trim: bool, positions: int | None, by_count: bool = False):
        self.m, self.most, self.least, self.limit, self.budget = m, most, least, aspect, budget
        self.trim, self.positions, self.by_count = trim, positions, by_count
        self.bad: set[Tile] = set()

    def run(self, t: Tile) -> list[Tile] | None:
        try:
            return self._solve(t, 0)
        except RecursionError:
            return None

    def _fits(self, t: Tile, n: int, depth: int) -> bool:
        if depth and self.m.outside_share(t) > 0.5:
            return False
        return self.by_count or self.most >= HUGE or self.m.small_enough(t)

    def _solve(self, t: Tile, depth: int) -> list[Tile] | None:
        m = self.m
        if self.trim or m.mask is not None:
            small = m.trimmed(t)
            if small is None:
                return []
            t = small
        n = m.count(t)
        if n == 0:
            return [] if t.w * t.h > 4 else None
        if t.w == 1 and t.h == 1:
            return [t]
        if n < self.least:
            return [t] if depth == 0 else None
        if n <= self.most:
            if m.aspect(t) > self.limit and depth:
                return None
            if self._fits(t, n, depth):
                return [t]
        if t in self.bad or self.budget <= 0:
            return None
        self.budget -= 1
        if n >= 2 * self.least or depth == 0:
            for axis, at in self._positions(t, n):
                halves = sorted(cut(t, axis, at), key=m.count)
                first = self._solve(halves[0], depth + 1)
                if first is None:
                    continue
                second = self._solve(halves[1], depth + 1)
                if second is not None:
                    return first + second
        self.bad.add(t)
        return None

    def _positions(self, t: Tile, n: int) -> Iterator[tuple[int, int]]:
        """Valid cuts, those near the middle of the nodes first, along the longer side first."""
        shrink = self.m.cosine[t.y : t.y + t.h + 1].max()
        longer = 0 if t.w * shrink >= t.h else 1
        for axis in (longer, 1 - longer):
            upto = self.m.lines(t, axis)[:-1]
            if not len(upto):
                continue
            least = min(self.least, n // 2)
            ok = np.flatnonzero((upto >= least) & (n - upto >= least))
            if not len(ok):
                continue
            ok = ok[np.argsort(np.abs(2 * upto[ok] - n), kind="stable")]
            if self.positions is not None and len(ok) > self.positions:
                ok = ok[np.unique(np.linspace(0, len(ok) - 1, self.positions).astype(int))]
            for i in ok:
                yield axis, int(i) + 1


def pieces(m: DensityMap, t: Tile, most: int) -> list[Tile]:
    """Plain halving of a map of at least 256 times the limit into pieces of at most 64 times."""
    out, todo = [], [t]
    while todo:
        t = todo.pop()
        if m.count(t) <= 64 * most or t.w * t.h < 4:
            out.append(t)
            continue
        axis = 0 if t.w >= t.h else 1
        upto = m.lines(t, axis)
        at = min(max(int(np.searchsorted(upto, upto[-1] / 2)) + 1, 1), (t.w, t.h)[axis] - 1)
        todo += cut(t, axis, at)
    return sorted(out)


def without_gaps(m: DensityMap, t: Tile, degrees: float = 30.0) -> list[Tile]:
    """Parts that lie apart by more than so many degrees of empty lines."""
    unit = 360 / U.UNITS * (1 << m.shift)
    for axis in (0, 1):
        used = np.flatnonzero(np.diff(m.lines(t, axis), prepend=0))
        gaps = np.flatnonzero(np.diff(used) * unit > degrees)
        if len(gaps):
            a, b = cut(t, axis, int(used[gaps[0]] + used[gaps[0] + 1]) // 2 + 1)
            return [p for part in (a, b) if m.count(part) for p in without_gaps(m, m.trimmed(part), degrees)]
    return [t]


def improve(m: DensityMap, t: Tile, most: int, budget: int, trim: bool, by_count: bool = False) -> Solution | None:
    """Raises the least number of nodes and relaxes the aspect while the budget lasts; keeps the best.

    A search may spend a quarter of what is left.
    """
    start = max(min(most // 20, int(m.grid[t.x : t.x + t.w, t.y : t.y + t.h].max(initial=0))), 1)
    best: Solution | None = None
    for positions in (8, None):
        for aspect in (4.0, 8.0, 16.0, 32.0, math.inf):
            low, high = start, most
            while low <= high:
                least = (low + high) // 2 if best else low
                if best and budget <= 0:
                    return best
                search = Search(m, most, least, aspect, max(budget // 4, 50), trim, positions, by_count)
                given = search.budget
                tiles = search.run(t)
                budget -= given - search.budget
                if tiles is None:
                    high = least - 1
                    if not best:
                        break
                    continue
                found = describe(m, tiles, most)
                if best is None or found.rank(most) < best.rank(most):
                    best = found
                low = max(least, found.least) + 1
                if high - low < most // 50:
                    break
            if best and best.nice(most):
                return best
        if best:
            return best
    return best


def split(m: DensityMap, most: int, budget: int = 200_000, trim: bool = True, by_count: bool = False, solve: Callable | None = None) -> list[Tile]:
    """Tiles of a map of which none has more than `most` nodes, but for single cells."""
    if not m.count(m.whole):
        return []
    todo = without_gaps(m, m.trimmed(m.whole) if trim else m.whole) if trim else [m.whole]
    if m.count(m.whole) >= 256 * most:
        todo = [p for t in todo for p in pieces(m, t, most)]
    run = solve or (lambda parts: [improve(m, t, most, budget, trim, by_count) for t in parts])
    out: list[Tile] = []
    for t, s in zip(todo, run(todo), strict=True):
        out += s.tiles if s else bisect_tiles(m, most, t)
    return trim_outer(m, out) if trim else out


def split_parallel(spark: SparkSession, m: DensityMap, most: int, budget: int = 200_000, trim: bool = True) -> list[Tile]:
    """The same tiles in the same order, with independent pieces solved on the executors; a piece carries its own cells."""

    def solve(parts: list[Tile]) -> list[Solution | None]:
        rows = []
        for i, t in enumerate(parts):
            x, y = m.grid[t.x : t.x + t.w, t.y : t.y + t.h].nonzero()
            rows.append((i, *t, x.tolist(), y.tolist(), m.grid[t.x + x, t.y + y].tolist()))
        shift, bounds = m.shift, m.bounds

        def run(batches):
            for pdf in batches:
                for r in pdf.itertuples():
                    own = (bounds[0] + (r.y << shift), bounds[1] + (r.x << shift), bounds[0] + (r.y + r.h << shift), bounds[1] + (r.x + r.w << shift))
                    part = DensityMap((r.xs, r.ys, r.ns), own, shift)
                    s = improve(part, part.whole, most, budget, trim)
                    tiles = s.tiles if s else bisect_tiles(part, most, part.whole)
                    yield pd.DataFrame([(r.i, nth, r.x + t.x, r.y + t.y, t.w, t.h) for nth, t in enumerate(tiles)], columns=["i", "nth", "x", "y", "w", "h"])

        kind = "i int, x int, y int, w int, h int, xs array<int>, ys array<int>, ns array<long>"
        tasks = min(len(rows), 8 * spark.sparkContext.defaultParallelism)  # several for each core, as pieces differ in what they take
        got = spark.createDataFrame(rows, kind).repartition(max(1, tasks)).mapInPandas(run, "i int, nth int, x int, y int, w int, h int").collect()
        own: list[list[Tile]] = [[] for _ in parts]
        for g in sorted(got):
            own[g.i].append(Tile(*g[2:]))
        return [describe(m, tiles, most) for tiles in own]

    return split(m, most, budget, trim, solve=solve)


def split_by_number(m: DensityMap, tiles: int, budget: int = 200_000, trim: bool = True) -> list[Tile]:
    """About so many tiles: the limit is scaled and then bisected."""
    n = m.count(m.whole)
    best: list[Tile] = []
    low, high = 1, n
    most = max(1, int(n / (tiles * 0.95)))
    for _ in range(24):
        found = split(m, most, budget // 10, trim, by_count=True)
        if not best or abs(len(found) - tiles) < abs(len(best) - tiles):
            best = found
        if len(found) == tiles or low >= high:
            break
        if len(found) > tiles:
            low = most + 1
        else:
            high = most - 1
        most = (low + high) // 2 if low > 1 and high < n else max(low, min(high, int(most * len(found) / tiles)))
    return best


def bisect_tiles(m: DensityMap, most: int, t: Tile | None = None) -> list[Tile]:
    """Plain bisection at the weighted mean line, kept in the middle three fifths and even."""
    out, todo = [], [t or m.whole]
    while todo:
        t = todo.pop()
        n = m.count(t)
        if n <= most:
            out += [t] if n else []
            continue
        made = None
        axes = (1, 0) if t.w <= t.h else (0, 1)
        for axis in axes:
            size = (t.w, t.h)[axis]
            if size < 4:
                continue
            line = np.diff(m.lines(t, axis), prepend=0)
            mean = int((line * np.arange(size)).sum() // n)
            at = min(max(mean, size // 5), size - size // 5)
            at -= at % 2
            if 0 < at < size:
                made = cut(t, axis, at)
                break
        if made is None:
            out.append(t)
        else:
            todo += made
    return sorted(out)


def mean_bisect(spark: SparkSession, nodes: DataFrame, most: int, shift: int = 11, clamped: bool = False) -> list[Rect]:
    """Bisection of the nodes themselves at their mean position on the grid, all rectangles of a level by one aggregate.

    clamped: cuts keep to the middle three fifths, and widths are compared at the latitude where they are largest, as the
    oldest versions did. The driver holds a row for each rectangle, the nodes stay where they are.
    """
    from pyspark.sql import functions as F

    from tessella.operators.bounded import cut as keep

    rects: dict[int, Rect] = {1: (-U.MAX_LAT, -U.MAX_LON, U.MAX_LAT, U.MAX_LON)}
    done: set[int] = set()
    now, level = nodes.select("map_lat", "map_lon", F.lit(1).cast("long").alias("part")), 0
    while True:
        found = now.groupBy("part").agg(F.count("*").alias("n"), F.avg("map_lat").alias("lat"), F.avg("map_lon").alias("lon")).collect()
        cuts = []
        for r in found:
            if r.n <= most or r.part in done:
                continue
            a, b, c, d = rects[r.part]
            shrink = max(math.cos(math.radians(v * 360 / U.UNITS)) for v in (a, c)) if clamped else 1.0
            wide = (d - b) * shrink >= c - a
            low, high = (b, d) if wide else (a, c)
            mean = int(r.lon if wide else r.lat)
            if clamped:
                fifth = (high - low) // 5
                mean = min(max(mean, low + fifth), high - fifth)
            at = U.near(mean, shift)
            if not low < at < high:
                done.add(r.part)
                continue
            rects[2 * r.part], rects[2 * r.part + 1] = ((a, b, c, at), (a, at, c, d)) if wide else ((a, b, at, d), (at, b, c, d))
            cuts.append((r.part, wide, at))
        if not cuts:
            return sorted(rects[r.part] for r in found)
        table = spark.createDataFrame(cuts, "part long, wide boolean, at int")  # a row for each rectangle that is cut
        upper = (F.when(F.col("wide"), F.col("map_lon")).otherwise(F.col("map_lat")) >= F.col("at")).cast("long")
        now = now.join(F.broadcast(table), "part", "left").select("map_lat", "map_lon", F.when(F.col("at").isNull(), F.col("part")).otherwise(2 * F.col("part") + upper).alias("part"))
        level += 1
        if level % 4 == 0:
            now = keep(now)


def trim_outer(m: DensityMap, tiles: list[Tile]) -> list[Tile]:
    """Cuts empty lines from tiles where they face no other tile, so that no gap opens between neighbours."""
    out = np.array(tiles, np.int64).reshape(-1, 4)
    for i in range(len(out)):
        t = Tile(*out[i].tolist())
        small = m.trimmed(t)
        if small is None or small == t:
            continue
        x, y, w, h = out.T  # the tile itself faces none of its sides
        beside, above = (y < t.y + t.h) & (y + h > t.y), (x < t.x + t.w) & (x + w > t.x)
        x0 = t.x if (beside & (x + w <= t.x)).any() else small.x
        x1 = t.x + t.w if (beside & (x >= t.x + t.w)).any() else small.x + small.w
        y0 = t.y if (above & (y + h <= t.y)).any() else small.y
        y1 = t.y + t.h if (above & (y >= t.y + t.h)).any() else small.y + small.h
        out[i] = x0, y0, x1 - x0, y1 - y0
    return [Tile(*t) for t in out.tolist()]


def raster(rings, bounds: Rect, shift: int) -> np.ndarray:
    """Cells whose middle lies within a polygon (rings in degrees): even-odd over whole rows and columns at once."""
    degree, mid = 360 / U.UNITS, 1 << shift >> 1
    lon = (bounds[1] + (np.arange(bounds[3] - bounds[1] >> shift) << shift) + mid) * degree
    lat = (bounds[0] + (np.arange(bounds[2] - bounds[0] >> shift) << shift) + mid) * degree
    held = np.zeros((len(lon), len(lat)), bool)
    for added, ring in rings:
        inside = np.zeros_like(held)
        for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
            if y1 != y2:
                at = (x2 - x1) * (lat - y1) / (y2 - y1) + x1
                inside ^= ((y1 > lat) != (y2 > lat))[None, :] & (lon[:, None] < at[None, :])
        held[inside] = added
    return held


#: A rectilinear shape with more corners is taken as its box; a ring that would have more on the grid is too complex.
MOST_CORNERS = 40


def too_complex(rings, shift: int) -> bool:
    """Whether a ring (degrees) has slanted edges that take more than MOST_CORNERS corners on the grid."""
    for _, ring in rings:
        corners = 0
        for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
            w, h = (abs(U.map_unit(a) - U.map_unit(b)) for a, b in ((x1, x2), (y1, y2)))
            corners += 2 * (min(w, h) >> shift)
            if corners > MOST_CORNERS:
                return True
    return False


def shapes(mask: np.ndarray) -> list[np.ndarray]:
    """The parts of a mask that hang together by edges, a mask each; a part that needs more than MOST_CORNERS corners becomes its box."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        new = label.copy()
        for a, b in (((slice(1, None), slice(None)), (slice(None, -1), slice(None))), ((slice(None), slice(1, None)), (slice(None), slice(None, -1)))):
            low = np.where(mask[a] & mask[b], np.maximum(new[a], new[b]), 0)
            new[a], new[b] = np.maximum(new[a], low), np.maximum(new[b], low)
        flat = new.ravel()
        new = np.where(mask, np.append(0, flat)[new], 0)  # a label is a cell: follow it once more
        if (new == label).all():
            break
        label = new
    out = []
    for v in np.unique(label[mask]):
        part = label == v
        x, y = part.nonzero()
        if _corners(part[x.min() : x.max() + 1, y.min() : y.max() + 1]) > MOST_CORNERS:
            part[x.min() : x.max() + 1, y.min() : y.max() + 1] = True
        out.append(part)
    return out


def _corners(part: np.ndarray) -> int:
    """Corners of a mask's outline: places where one or three of four cells belong to it, or two that touch at the corner only."""
    p = np.pad(part, 1).astype(np.int8)
    four = p[1:, 1:] + p[1:, :-1] + p[:-1, 1:] + p[:-1, :-1]
    cross = (four == 2) & (p[1:, 1:] == p[:-1, :-1])
    return int(((four == 1) | (four == 3)).sum() + 2 * cross.sum())


def split_parts(cells, bounds: Rect, shift: int, rings, most: int, budget: int = 200_000, trim: bool = True) -> list[Rect]:
    """Tiles of a polygon: each of its parts by itself; what is taken away by a ring (a hole, a notch) belongs to none."""
    out = []
    for part in shapes(raster(rings, bounds, shift)):
        m = DensityMap(cells, bounds, shift, part)
        out += [m.rect(clipped(m, t)) for t in split(m, most, budget, trim)]
    return out


def clipped(m: DensityMap, t: Tile) -> Tile:
    """The tile cut back to the cells of the polygon, where those make up a rectangle."""
    if m.mask is None:
        return t
    x, y = m.mask[t.x : t.x + t.w, t.y : t.y + t.h].nonzero()
    if not len(x):
        return t
    inner = Tile(t.x + int(x.min()), t.y + int(y.min()), int(x.max() - x.min()) + 1, int(y.max() - y.min()) + 1)
    return inner if len(x) == inner.w * inner.h else t


def split_polygons(cells, bounds: Rect, shift: int, polygons: dict[str, list], most: int, budget: int = 200_000, trim: bool = True) -> dict[frozenset[str], list[Rect]]:
    """Tiles for named polygons that may overlap: each part shared by the same polygons is split by itself.

    A part need not be a rectangle, so its tiles may reach into another part's; problem lists work on disjoint pieces.
    """
    masks = {name: raster(rings, bounds, shift) for name, rings in polygons.items()}
    names = list(masks)
    code = sum((masks[n].astype(np.int64) << i for i, n in enumerate(names)), np.zeros((bounds[3] - bounds[1] >> shift, bounds[2] - bounds[0] >> shift), np.int64))
    out = {}
    for c in sorted(set(np.unique(code).tolist()) - {0}, key=lambda v: (v.bit_count(), v)):
        m = DensityMap(cells, bounds, shift, code == c)
        out[frozenset(n for i, n in enumerate(names) if c >> i & 1)] = [m.rect(t) for t in split(m, most, budget, trim)]
    return out


def areas(spark: SparkSession, m: DensityMap, tiles: list[Tile], first_id: int = 63240001, names: dict[int, str] | None = None) -> DataFrame:
    """The area table of tiles that hold nodes."""
    return area_table(spark, [m.rect(t) for t in tiles], first_id, names)


def area_table(spark: SparkSession, rects: list[Rect], first_id: int = 63240001, names: dict[int, str] | None = None) -> DataFrame:
    from tessella.schema import AREAS

    if first_id + len(rects) - 1 > 99_999_999:
        raise ValueError("map ids have eight digits at most")
    return spark.createDataFrame([(i, first_id + i, (names or {}).get(i), *r, False, True) for i, r in enumerate(rects)], AREAS)


def density_map(cells: DataFrame, bounds: Rect, shift: int, mask: np.ndarray | None = None) -> DensityMap:
    """Collects the histogram: a row for each cell with nodes, of a grid whose size the resolution bounds."""
    return DensityMap(collected(cells), bounds, shift, mask)


GRID_BYTES = 4 << 30


def collected(cells: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x, y and n of all cells as arrays, batch by batch, without a Python object for each."""
    got = cells.select("x", "y", "n").toArrow()
    return tuple(got.column(k).to_numpy() for k in ("x", "y", "n"))
