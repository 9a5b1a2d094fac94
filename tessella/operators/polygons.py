"""Points in polygons as joins: no polygon and no grid of cells is ever gathered.

A point first meets the boxes of polygons (a join with rectangles of unequal size), then, within a polygon, the edges that
stand over its column of longitudes. An edge stands in the columns of its own length, two at most, so a point looks up one
column for each length that occurs. It is inside if an odd number of edges pass above it, counted by a partial aggregate;
holes are rings like others, as their edges turn odd into even. All in whole numbers. An edge includes its western end and
not its eastern one; a point on an edge lies below it, not above.

Where only sums by polygon are asked for (`totals`), points are summed by cell first. Cells that no edge touches lie inside or
outside as a whole, so a run of them costs two running sums of its column; single points are looked at in touched cells only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.operators.bounded import cut, hinted
from tessella.operators.rangejoin import TOP, point_in_rect, side_level


def edges(rings: DataFrame, upright: bool = False) -> DataFrame:
    """poly_id, lat1, lon1, lat2, lon2 (lon1 < lon2) of the edges of rings (poly_id, ring: array of lat, lon; closed or not).

    Edges along a meridian are left out unless upright: no point is below one.
    """
    n = F.size("ring")
    nth = rings.where(n > 2).select("poly_id", "ring", F.posexplode("ring").alias("k", "a")).withColumn("b", F.element_at("ring", (F.col("k") + 1) % n + 1))
    west = F.col("a.lon") < F.col("b.lon")
    pick = lambda c, first: F.when(west == first, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).cast("long")
    return (nth if upright else nth.where("a.lon <> b.lon")).select("poly_id", pick("lat", True).alias("lat1"), pick("lon", True).alias("lon1"), pick("lat", False).alias("lat2"), pick("lon", False).alias("lon2"))


def boxes(rings: DataFrame) -> DataFrame:
    """area_idx (the polygon) and its edges as a rectangle."""
    at = rings.select("poly_id", F.explode("ring").alias("p"))
    return at.groupBy(F.col("poly_id").alias("area_idx")).agg(F.min("p.lat").alias("min_lat"), F.min("p.lon").alias("min_lon"), F.max("p.lat").alias("max_lat"), F.max("p.lon").alias("max_lon"))


def inside(points: DataFrame, rings: DataFrame, key: list[str]) -> DataFrame:
    """key and poly_id of the polygons that hold a point; points: key (unique), map_lat, map_lon."""
    near = point_in_rect(points.select(*key, "map_lat", "map_lon"), cut(boxes(rings))).withColumnRenamed("area_idx", "poly_id")
    shift = lambda v, by: F.call_function("shiftright", v, by)
    own = cut(edges(rings).withColumn("level", F.least(F.lit(TOP), side_level(F.col("lon1"), F.col("lon2")))))
    levels = sorted(r.level for r in own.select("level").distinct().collect())  # 26 at most
    dealt = own.withColumn("column", F.explode(F.sequence(shift(F.col("lon1"), F.col("level")), shift(F.col("lon2") - 1, F.col("level")))))
    asked = near.withColumn("level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>"))).withColumn("column", shift(F.col("map_lon").cast("long"), F.col("level")))
    both = asked.join(hinted(dealt), ["poly_id", "level", "column"])
    x, y = F.col("map_lon"), F.col("map_lat")
    above = (F.col("lon1") <= x) & (x < F.col("lon2")) & ((x - F.col("lon1")) * (F.col("lat2") - F.col("lat1")) >= (y - F.col("lat1")) * (F.col("lon2") - F.col("lon1")))
    return both.where(above).groupBy(*key, "poly_id").agg(F.count("*").alias("_above")).where("_above % 2 = 1").select(*key, "poly_id")


def _by_column(rings: DataFrame, shift: int) -> DataFrame:
    """poly_id, x, edges: those over a column of cells, with the cells from lo to hi that they touch in it and whether they begin before it."""
    low = F.shiftleft(F.col("x"), shift)
    at = lambda v: (v - F.col("lon1")) * (F.col("lat2") - F.col("lat1"))
    wide = F.greatest(F.lit(1), F.col("lon2") - F.col("lon1"))
    height = lambda v: F.col("lat1") + ((at(v) - F.pmod(at(v), wide)) / wide).cast("long")  # noqa: E731  exact: below 2^53
    upright = F.col("lon1") == F.col("lon2")
    first = F.when(upright, F.col("lat1")).otherwise(height(F.greatest("lon1", low)))
    last = F.when(upright, F.col("lat2")).otherwise(height(F.least(F.col("lon2"), low + (1 << shift))))
    x = F.sequence(F.shiftright("lon1", shift), F.shiftright(F.greatest(F.col("lon1"), F.col("lon2") - 1), shift))
    own = edges(rings, upright=True).withColumn("x", F.explode(x)).withColumns({"lo": F.shiftright(F.least(first, last), shift), "hi": F.shiftright(F.greatest(first, last), shift), "over": ~upright & (F.col("lon1") <= low)})
    return own.groupBy("poly_id", "x").agg(F.collect_list(F.struct("lat1", "lon1", "lat2", "lon2", "lo", "hi", "over")).alias("edges"))


def totals(points: DataFrame, rings: DataFrame, values: list[str], shift: int = 13) -> DataFrame:
    """poly_id, n and the sums of values over the points (map_lat, map_lon, values) in each polygon that holds any.

    As rings are closed, an even number of edges stands over any longitude, so cells that no edge touches have one parity: that of the
    edges above them at the column's western side.
    """
    names = ["n", *values]
    place = [F.shiftright(F.col(c).cast("long"), shift).alias(k) for c, k in (("map_lon", "x"), ("map_lat", "y"))]
    at = cut(points.groupBy("map_lat", "map_lon").agg(F.count("*").alias("n"), *[F.sum(v).alias(v) for v in values]).select(*place, F.col("map_lat").cast("long").alias("map_lat"), F.col("map_lon").cast("long").alias("map_lon"), *names))
    rows = _by_column(rings, shift)
    touched = F.array_sort(F.array_distinct(F.flatten(F.transform("edges", lambda e: F.sequence(e["lo"], e["hi"])))))
    above = lambda y: F.size(F.filter("edges", lambda e: e["over"] & (e["lo"] > y))) % 2 == 1

    # whole cells: what stands below the end of a run less what stands below its start
    low, high = at.agg(F.min("y"), F.max("y")).first()
    if low is None:
        return at.select(F.lit(0).alias("poly_id"), *names).limit(0)
    cells = at.groupBy("x", "y").agg(*[F.sum(v).alias(v) for v in names])
    grid = cells.select("x").distinct().withColumn("y", F.explode(F.sequence(F.lit(low), F.lit(high + 1)))).join(cells, ["x", "y"], "left")
    before = W.partitionBy("x").orderBy("y").rowsBetween(W.unboundedPreceding, -1)
    upto = cut(grid.select("x", "y", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(v) for v in names]))  # a row for each cell of the map
    clamped = lambda v: F.least(F.greatest(v, F.lit(low)), F.lit(high + 1))
    pair = rows.withColumn("ys", touched).select("poly_id", "x", F.inline(F.transform("ys", lambda y, i: F.struct(clamped(y + 1).alias("start"), clamped(F.get("ys", i + 1)).alias("stop"), above(y).alias("odd"))))).where("odd and start < stop")
    ends = pair.select("poly_id", "x", F.inline(F.array(F.struct(F.col("stop").alias("y"), F.lit(1).alias("sign")), F.struct(F.col("start").alias("y"), F.lit(-1).alias("sign")))))
    whole = ends.join(hinted(upto), ["x", "y"]).groupBy("poly_id").agg(*[F.sum(F.col("sign") * F.col(v)).alias(v) for v in names])

    # touched cells: point by point
    near = rows.select("poly_id", "x", "edges", F.explode(touched).alias("y"))
    near = near.select("poly_id", "x", "y", F.transform(F.filter("edges", lambda e: (e["hi"] >= F.col("y")) & (e["lon1"] < e["lon2"])), lambda e: F.struct(e["lat1"].alias("lat1"), e["lon1"].alias("lon1"), e["lat2"].alias("lat2"), e["lon2"].alias("lon2"))).alias("edges")).where(F.size("edges") > 0)
    x, y = F.col("map_lon"), F.col("map_lat")
    hit = lambda e: (e["lon1"] <= x) & (x < e["lon2"]) & ((x - e["lon1"]) * (e["lat2"] - e["lat1"]) >= (y - e["lat1"]) * (e["lon2"] - e["lon1"]))
    single = near.join(at, ["x", "y"]).where(F.size(F.filter("edges", hit)) % 2 == 1).groupBy("poly_id").agg(*[F.sum(v).alias(v) for v in names])
    return whole.unionByName(single).groupBy("poly_id").agg(*[F.sum(v).alias(v) for v in names]).where("n > 0")
