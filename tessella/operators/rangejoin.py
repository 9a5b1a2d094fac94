"""Joins of points, boxes and segments with rectangles of any mix of sizes.

Catalyst has no range join, so rectangles are dealt to grid cells and the join becomes an equi-join by cell with the
exact predicate behind it. A rectangle's cells are of its own size: the level of an axis is the power of two that its side
fits, for height and width apart, so that a strip around the globe meets cells that are as long and as flat. It then has
four cells at most, and of disjoint rectangles a cell meets 16 at most. The pairs of levels that occur are counted first; a
point looks up one cell for each of them. Where they are more than MOST, neighbouring levels become one (every second,
third, ... level is used). A box meets the cells of the larger of its own levels and the rectangle's, for height and width
apart, where both have four cells at most; rectangles stand on those levels only that occur among the boxes. The cell table is
broadcast after a check of its size; beyond that the join shuffles by cell, where adaptive execution splits hot cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import units as U
from tessella.operators.bounded import LIMIT, hinted, small

TOP = 25  # one cell of this level holds the globe
MOST = 32  # pairs of levels that a point looks up
STEPS = (1, 2, 3, 4, 6, TOP)


def side_level(low: Column, high: Column) -> Column:
    """The least level whose cells are as long as a side, so that the side meets two of them at most; exact."""
    side = high.cast("long") - low
    return F.when(side <= 1, 0).otherwise(F.length(F.bin(side - 1)))


def _stepped(level: Column, step: int) -> Column:
    return F.least(F.lit(TOP), F.ceil(level / step).cast("int") * step)


def _joined(found: set[tuple[int, int]]) -> tuple[list[tuple[int, int]], int]:
    """The pairs of levels, MOST at most, and the step by which neighbouring levels were joined."""
    for step in STEPS:
        pairs = {(min(TOP, -(-y // step) * step), min(TOP, -(-x // step) * step)) for y, x in found}
        if len(pairs) <= MOST:
            break
    return sorted(pairs), step


def size_levels(areas: DataFrame, grow: int = 0) -> tuple[list[tuple[int, int]], int]:
    """The pairs of levels (height, width) that occur among the areas, and the step by which levels were joined; one aggregate."""
    r = U.grown(U.rect(), grow)
    return _joined({tuple(x) for x in areas.select(side_level(r["min_lat"], r["max_lat"]), side_level(r["min_lon"], r["max_lon"])).distinct().collect()})  # 26 * 26 at most


def box_levels(boxes: DataFrame, areas: DataFrame, pairs: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], Column, Column]:
    """The pairs of levels that areas have to stand on for the boxes' sake, and a box's own levels, not below the least of the areas.

    With few areas these are all pairs; with many the boxes are read once for those that occur.
    """
    box, low = U.rect("box_"), [min(p) for p in zip(*pairs)]
    level = lambda k, axis: F.greatest(F.lit(low[k]), F.least(F.lit(TOP), side_level(box["min_" + axis], box["max_" + axis])))
    own = [level(0, "lat"), level(1, "lon")]
    every = [(y, x) for y in range(low[0], TOP + 1) for x in range(low[1], TOP + 1)]
    if small(areas, LIMIT // 4 // len(every)):  # four cells at most for each pair
        return every, *own
    found, step = _joined({tuple(x) for x in boxes.select(*own).distinct().collect()})
    return found, *[_stepped(v, step) for v in own]


def _at(v: Column, level: Column) -> Column:
    """The cell of a coordinate; the level may differ from row to row."""
    return F.call_function("shiftright", v, level)


def _cells(df: DataFrame, r: dict[str, Column], level_y: Column, level_x: Column) -> DataFrame:
    """df with cell_y and cell_x of each cell of these levels that the rectangle touches."""
    wide = df.withColumn("cell_y", F.explode(F.sequence(_at(r["min_lat"], level_y), _at(r["max_lat"], level_y))))
    return wide.withColumn("cell_x", F.explode(F.sequence(_at(r["min_lon"], level_x), _at(r["max_lon"], level_x))))


def _sized(areas: DataFrame, step: int, grow: int) -> DataFrame:
    """area_idx, edges grown, size_y, size_x: the levels of its sides."""
    wide = areas.select("area_idx", *[v.alias(k) for k, v in U.grown(U.rect(), grow).items()])
    return wide.withColumns({"size_y": _stepped(side_level(F.col("min_lat"), F.col("max_lat")), step), "size_x": _stepped(side_level(F.col("min_lon"), F.col("max_lon")), step)})


def area_cells(areas: DataFrame, step: int = 1, grow: int = 0) -> DataFrame:
    """area_idx, edges grown, size_y, size_x, cell_y, cell_x for each cell of its own size, four at most, that a rectangle touches."""
    return _cells(_sized(areas, step, grow), U.rect(), F.col("size_y"), F.col("size_x"))


def _looked_up(df: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """df with size_y and size_x: a row for each pair of levels."""
    if len(pairs) == 1:
        return df.withColumns({"size_y": F.lit(pairs[0][0]), "size_x": F.lit(pairs[0][1])})
    return df.select("*", F.inline(F.array(*[F.struct(F.lit(y).alias("size_y"), F.lit(x).alias("size_x")) for y, x in pairs])))


def point_in_rect(points: DataFrame, areas: DataFrame, grow: int = 0) -> DataFrame:
    """points (with map_lat, map_lon) and area_idx of every rectangle, grown by `grow`, that holds them; borders count."""
    pairs, step = size_levels(areas, grow)
    keyed = _looked_up(points, pairs or [(0, 0)])
    keyed = keyed.withColumns({"cell_y": _at(F.col("map_lat"), F.col("size_y")), "cell_x": _at(F.col("map_lon"), F.col("size_x"))})
    both = keyed.join(hinted(area_cells(areas, step, grow)), ["size_y", "size_x", "cell_y", "cell_x"])
    hit = both.where(U.contains_point(U.rect(), F.col("map_lat"), F.col("map_lon")))
    return hit.select(*points.columns, "area_idx")


def meeting(boxes: DataFrame, areas: DataFrame, grow: int = 0) -> DataFrame:
    """Every pair, once, of a box (box_ edges) and an area, grown by `grow`, that touch: the box's columns, area_idx and the edges grown.

    They meet on cells of the larger height and the larger width of both. An area stands on those cells for each pair of the boxes' levels;
    a box looks up each pair of levels that its own make with those of the areas.
    """
    pairs, step = size_levels(areas, grow)
    pairs, box = pairs or [(0, 0)], U.rect("box_")
    theirs, own_y, own_x = box_levels(boxes, areas, pairs)
    key = ["box_y", "box_x", "level_y", "level_x"]
    larger = [F.struct(F.greatest("box_y", F.lit(y)).alias("level_y"), F.greatest("box_x", F.lit(x)).alias("level_x")) for y, x in pairs]
    keyed = boxes.withColumns({"box_y": own_y, "box_x": own_x}).select("*", F.inline(F.array_distinct(F.array(*larger))))
    stand = _sized(areas, step, grow).select("*", F.inline(F.array(*[F.struct(F.lit(y).alias("box_y"), F.lit(x).alias("box_x")) for y, x in theirs] or [F.struct(F.lit(0).alias("box_y"), F.lit(0).alias("box_x"))])))
    stand = stand.withColumns({"level_y": F.greatest("box_y", "size_y"), "level_x": F.greatest("box_x", "size_x")}).drop("size_y", "size_x")
    level_y, level_x = F.col("level_y"), F.col("level_x")
    both = _cells(keyed, box, level_y, level_x).join(hinted(_cells(stand, U.rect(), level_y, level_x)), [*key, "cell_y", "cell_x"])
    # each pair is reported by the first cell that both cover, so nothing has to be made distinct
    first = lambda k, level: F.greatest(_at(F.col("box_min_" + k), level), _at(F.col("min_" + k), level))
    hit = both.where((F.col("cell_y") == first("lat", level_y)) & (F.col("cell_x") == first("lon", level_x)) & U.touches(U.rect(), box))
    return hit.drop(*key, "cell_y", "cell_x")


def rect_near_rect(boxes: DataFrame, areas: DataFrame) -> DataFrame:
    """boxes (with box_ edges) and area_idx of every area that they reach into once it has grown by one unit."""
    hit = meeting(boxes, areas, 1).where(U.overlaps(U.rect(), U.rect("box_")))
    return hit.select(*boxes.columns, "area_idx")


def segments_near_rect(segments: DataFrame, areas: DataFrame) -> DataFrame:
    """segments (way_id, lat1, lon1, lat2, lon2) and area_idx of every area that they hit once it has grown by one unit."""
    ends = {"min_lat": F.least("lat1", "lat2"), "min_lon": F.least("lon1", "lon2"), "max_lat": F.greatest("lat1", "lat2"), "max_lon": F.greatest("lon1", "lon2")}
    near = meeting(segments.select("*", *[v.alias("box_" + k) for k, v in ends.items()]), areas, 1)
    plain = U.grown(U.rect(), -1)
    return near.where(U.segment_hits(plain, F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))).select(*segments.columns, "area_idx")


def _boxes(areas: DataFrame, key: str) -> DataFrame:
    return areas.select(F.col("area_idx").alias(key), *[v.alias("box_" + k) for k, v in U.rect().items()])


def overlapping_areas(areas: DataFrame) -> DataFrame:
    """a, b: pairs of areas, a < b, whose common part has an extent."""
    both = meeting(_boxes(areas, "a"), areas).where((F.col("a") < F.col("area_idx")) & U.overlaps(U.rect("box_"), U.rect()))
    return both.select("a", F.col("area_idx").alias("b"))


def contained_in(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """area_idx of inner and the set of the outer areas that hold it whole."""
    hit = meeting(_boxes(inner, "inner"), outer).where(U.contains_rect(U.rect(), U.rect("box_")))
    return hit.groupBy(F.col("inner").alias("area_idx")).agg(F.array_sort(F.collect_set(hit["area_idx"])).alias("areas"))


def cities_in_areas(cities: DataFrame, areas: DataFrame) -> DataFrame:
    points = cities.withColumnRenamed("lat", "map_lat").withColumnRenamed("lon", "map_lon")
    return point_in_rect(points, areas).withColumnRenamed("map_lat", "lat").withColumnRenamed("map_lon", "lon")


def best_city(cities: DataFrame, areas: DataFrame) -> DataFrame:
    """The city of most people in each area; the lower id decides between equals."""
    pick = F.max_by(F.struct("id", "country", "name", "population"), F.struct("population", -F.col("id"))).alias("c")
    return cities_in_areas(cities, areas).groupBy("area_idx").agg(pick).select("area_idx", "c.id", "c.country", "c.name", "c.population")


def area_names(areas: DataFrame, cities: DataFrame | None) -> DataFrame:
    """area_idx and name (country and best city) of every area; null without cities, or where none lies in it."""
    if cities is None:
        return areas.select("area_idx", F.lit(None).cast("string").alias("name"))
    best = best_city(cities, areas).select("area_idx", F.concat_ws("-", "country", "name").alias("name"))
    return areas.select("area_idx").join(best, "area_idx", "left")
