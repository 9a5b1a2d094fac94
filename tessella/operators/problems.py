"""Elements that lie in several areas: areas made disjoint, the planet covered, problem ways and relations found."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.tags import wanted_relation
from tessella.operators import assign as A
from tessella.operators.areasets import AreaSets
from tessella.operators.bounded import hinted
from tessella.operators.rangejoin import contained_in

Rect = tuple[int, int, int, int]  # min_lat, min_lon, max_lat, max_lon


def disjoint(areas: list[Rect]) -> list[Rect]:
    """Rectangles without common extent that make up the same set and respect all edges of the areas given.

    Coordinates are compressed to the edges; cells with the same covering areas are joined along rows, then upwards.
    """
    ys = sorted({e for a in areas for e in (a[0], a[2])})
    xs = sorted({e for a in areas for e in (a[1], a[3])})
    strips: list[list[tuple[int, int, frozenset[int]]]] = []
    for low, high in zip(ys, ys[1:], strict=False):
        here = [i for i, a in enumerate(areas) if a[0] <= low and a[2] >= high]
        row: list[tuple[int, int, frozenset[int]]] = []
        for left, right in zip(xs, xs[1:], strict=False):
            who = frozenset(i for i in here if areas[i][1] <= left and areas[i][3] >= right)
            if not who:
                continue
            if row and row[-1][1] == left and row[-1][2] == who:
                row[-1] = (row[-1][0], right, who)
            else:
                row.append((left, right, who))
        strips.append(row)
    out: list[Rect] = []
    open_: dict[tuple[int, int, frozenset[int]], int] = {}
    for (low, high), row in zip(zip(ys, ys[1:], strict=False), strips, strict=True):
        now: dict[tuple[int, int, frozenset[int]], int] = {}
        for cell in row:
            now[cell] = open_.pop(cell, low)
        out += [(start, left, low, right) for (left, right, _), start in open_.items()]
        open_ = now
    top = ys[-1] if ys else 0
    out += [(start, left, top, right) for (left, right, _), start in open_.items()]
    return sorted(out)


def cover(areas: list[Rect], world: Rect) -> list[Rect]:
    """Rectangles that fill what disjoint areas leave of the world."""
    inside = [(max(a[0], world[0]), max(a[1], world[1]), min(a[2], world[2]), min(a[3], world[3])) for a in areas]
    inside = [a for a in inside if a[0] < a[2] and a[1] < a[3]]
    ys = sorted({world[0], world[2], *(e for a in inside for e in (a[0], a[2]))})
    free: list[list[int]] = []
    open_: dict[tuple[int, int], int] = {}
    for low, high in zip(ys, ys[1:], strict=False):
        taken = sorted((a[1], a[3]) for a in inside if a[0] <= low and a[2] >= high)
        gaps, at = [], world[1]
        for left, right in taken:
            if left > at:
                gaps.append((at, left))
            at = max(at, right)
        if at < world[3]:
            gaps.append((at, world[3]))
        now = {g: open_.pop(g, low) for g in gaps}
        free += [[start, g[0], low, g[1]] for g, start in open_.items()]
        open_ = now
    free += [[start, g[0], world[2], g[1]] for g, start in open_.items()]
    return sorted(tuple(f) for f in free)


def extent(areas: Iterable[Rect]) -> int:
    return sum((a[2] - a[0]) * (a[3] - a[1]) for a in areas)


def problem_ways(known: AreaSets, way_sets: DataFrame) -> DataFrame:
    return A.several(known, way_sets).select(F.lit("way").alias("kind"), F.col("way_id").alias("id"))


def problem_relations(known: AreaSets, relations: DataFrame, rel_sets: DataFrame, **filters) -> DataFrame:
    """Wanted relations with members in several areas."""
    wanted = relations.where(wanted_relation(F.col("tags"), **filters)).select(F.col("id").alias("rel_id"))
    return A.several(known, rel_sets).join(wanted, "rel_id", "left_semi").select(F.lit("rel").alias("kind"), F.col("rel_id").alias("id"))


def one_tile_relations(known: AreaSets, relations: DataFrame, rel_sets: DataFrame, distinct_areas: DataFrame, areas: DataFrame, **filters) -> DataFrame:
    """rel_id and areas: wanted relations within one distinct area, with the real areas that hold it; those in pseudo areas drop out."""
    wanted = relations.where(wanted_relation(F.col("tags"), **filters)).select(F.col("id").alias("rel_id"))
    one = known.single(rel_sets).join(wanted, "rel_id", "left_semi")
    real = contained_in(distinct_areas, areas)
    return one.join(hinted(real), "area_idx").select("rel_id", "areas")


def all_problems(found: DataFrame, told: DataFrame) -> DataFrame:
    """Problems that were computed and those that the user lists."""
    return found.select("kind", "id").union(told.select("kind", "id")).distinct()


def coverage(known: AreaSets, numbered: DataFrame) -> DataFrame:
    """How many elements lie in how many areas; counted by set first. numbered: a key and set_no."""
    counts = known.arrays(numbered, numbered.columns[0]).groupBy("areas").agg(F.count("*").alias("n"))
    return counts.groupBy(F.size("areas").alias("n_areas")).agg(F.sum("n").alias("n_elements"), F.count("*").alias("n_sets"))


__all__ = ["all_problems", "cover", "coverage", "disjoint", "extent", "one_tile_relations", "problem_relations", "problem_ways"]
