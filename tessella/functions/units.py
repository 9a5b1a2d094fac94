"""Coordinates in map units (2^24 to the full circle) and predicates on points, rectangles and segments, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = 1 << 24
HALF = 360.0 / UNITS / 2
MAX_LAT, MAX_LON = 0x400000, 0x800000
LAT_LIMIT = 85.0


def to_map_unit(degrees: Column) -> Column:
    """Nearest map unit, halves away from zero."""
    moved = F.when(degrees > 0, degrees + F.lit(HALF)).otherwise(degrees - F.lit(HALF))
    return (moved * F.lit(float(UNITS)) / F.lit(360.0)).cast("int")


def to_degrees(units: Column) -> Column:
    return units.cast("double") * F.lit(360.0) / F.lit(float(UNITS))


def map_unit(degrees: float) -> int:
    """to_map_unit of a plain number."""
    return int((degrees + (HALF if degrees > 0 else -HALF)) * UNITS / 360)


def round_down(v: Column, shift: int) -> Column:
    return F.shiftleft(F.shiftright(v, shift), shift) if shift else v


def round_up(v: Column, shift: int) -> Column:
    return round_down(v + F.lit((1 << shift) - 1), shift) if shift else v


def round_near(v: Column, shift: int) -> Column:
    return round_down(v + F.lit(1 << (shift - 1)), shift) if shift else v


def down(v: int, shift: int) -> int:
    return v >> shift << shift


def up(v: int, shift: int) -> int:
    return -(-v >> shift << shift)


def near(v: int, shift: int) -> int:
    return down(v + (1 << shift >> 1), shift)


def round_rect(rect: dict[str, Column], shift: int) -> dict[str, Column]:
    """Rounded outwards; latitudes within 85 degrees, longitudes within the circle."""
    lat, lon = map_unit(LAT_LIMIT), MAX_LON
    low = lambda v, n: round_down(F.greatest(v, F.lit(-n)), shift)
    high = lambda v, n: round_up(F.least(v, F.lit(n)), shift)
    return {"min_lat": low(rect["min_lat"], lat), "min_lon": F.greatest(low(rect["min_lon"], lon), F.lit(-lon)), "max_lat": high(rect["max_lat"], lat), "max_lon": F.least(high(rect["max_lon"], lon), F.lit(lon))}


def widen(low: Column, high: Column) -> Column:
    """The upper edge of a rectangle that must have an extent."""
    return F.when(low == high, high + 1).otherwise(high)


def rect(prefix: str = "") -> dict[str, Column]:
    return {k: F.col(prefix + k) for k in ("min_lat", "min_lon", "max_lat", "max_lon")}


def grown(r: dict[str, Column], by: int) -> dict[str, Column]:
    return {k: v + (by if k.startswith("max") else -by) for k, v in r.items()}


def verify(r: dict[str, Column]) -> Column:
    """Whether edges are in order and on the globe."""
    return (r["min_lat"] <= r["max_lat"]) & (r["min_lon"] <= r["max_lon"]) & (r["min_lat"] >= -MAX_LAT) & (r["max_lat"] <= MAX_LAT) & (r["min_lon"] >= -MAX_LON) & (r["max_lon"] <= MAX_LON)


def valid_node(lat: Column, lon: Column) -> Column:
    return lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)


def contains_point(r: dict[str, Column], lat: Column, lon: Column) -> Column:
    """Closed on all four sides: a node on a border belongs to every rectangle that meets there."""
    return lat.between(r["min_lat"], r["max_lat"]) & lon.between(r["min_lon"], r["max_lon"])


def contains_rect(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return (a["min_lat"] <= b["min_lat"]) & (a["min_lon"] <= b["min_lon"]) & (a["max_lat"] >= b["max_lat"]) & (a["max_lon"] >= b["max_lon"])


def touches(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Closed: a common border is enough."""
    return (a["min_lat"] <= b["max_lat"]) & (a["max_lat"] >= b["min_lat"]) & (a["min_lon"] <= b["max_lon"]) & (a["max_lon"] >= b["min_lon"])


def overlaps(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Open: the common part has an extent."""
    return (a["min_lat"] < b["max_lat"]) & (a["max_lat"] > b["min_lat"]) & (a["min_lon"] < b["max_lon"]) & (a["max_lon"] > b["min_lon"])


def intersection(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """Null edges where the two do not touch."""
    both = {k: (F.least if k.startswith("max") else F.greatest)(a[k], b[k]) for k in a}
    return {k: F.when(touches(a, b), v) for k, v in both.items()}


def union(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    return {k: (F.greatest if k.startswith("max") else F.least)(a[k], b[k]) for k in a}


def near_rect(area: dict[str, Column], box: dict[str, Column]) -> Column:
    """Whether a box reaches into an area grown by one unit."""
    return overlaps(grown(area, 1), box)


def segment_hits(area: dict[str, Column], lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Whether a segment meets the closed area grown by one unit: boxes meet and not all corners are on one side.

    Exact in 64-bit integers.
    """
    g = {k: v.cast("long") for k, v in grown(area, 1).items()}
    a, b, c, d = (v.cast("long") for v in (lat1, lon1, lat2, lon2))
    boxes = (F.least(a, c) <= g["max_lat"]) & (F.greatest(a, c) >= g["min_lat"]) & (F.least(b, d) <= g["max_lon"]) & (F.greatest(b, d) >= g["min_lon"])
    side = lambda y, x: (d - b) * (g[y] - a) - (c - a) * (g[x] - b)
    sides = [side(y, x) for y in ("min_lat", "max_lat") for x in ("min_lon", "max_lon")]
    return boxes & ~((F.least(*sides) > 0) | (F.greatest(*sides) < 0))


def crosses_antimeridian(r: dict[str, Column]) -> Column:
    """Whether a box lies on both sides of the zero meridian and is half the globe wide: it rather crosses the 180th."""
    return (r["min_lon"] < 0) & (r["max_lon"] > 0) & (r["max_lon"] - r["min_lon"] >= MAX_LON)


def aspect_ratio(min_lat: Column, max_lat: Column, min_lon: Column, max_lon: Column) -> Column:
    """Width over height with the width shrunk by the latitude nearer to the equator; raw if the equator lies within."""
    low, high = F.cos(F.radians(to_degrees(min_lat))), F.cos(F.radians(to_degrees(max_lat)))
    shrink = F.when((min_lat < 0) & (max_lat > 0), 1.0).otherwise(F.greatest(low, high))
    return (max_lon - min_lon) * shrink / (max_lat - min_lat)


def area_set(values: Column) -> Column:
    """The canonical form of a set of area numbers."""
    return F.array_sort(F.array_distinct(values))


def clockwise(ring: Column) -> Column:
    """Shoelace test of a closed ring: an array of struct lat, lon."""
    n = F.size(ring)
    total = F.aggregate(
        F.sequence(F.lit(1), n - 1),
        F.lit(0).cast("long"),
        lambda s, i: s + (F.element_at(ring, i)["lon"].cast("long") * F.element_at(ring, i + 1)["lat"] - F.element_at(ring, i + 1)["lon"].cast("long") * F.element_at(ring, i)["lat"]),
    )
    return F.when(n < 3, False).otherwise(total <= 0)
