"""The small text formats around tiles: area lists, polygons, KML, problem lists, city lists, density dumps, sea index."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import units as U
from tessella.functions.units import to_map_unit

Rect = tuple[int, int, int, int]
Point = tuple[float, float]


class TextError(ValueError):
    pass


# area lists

_AREA = re.compile(r"\s*(\d{8})\s*:\s*(\S+?)\s*,\s*(\S+?)\s+to\s+(\S+?)\s*,\s*(\S+?)\s*")


def _integer(text: str) -> int:
    """Decimal, 0x, # or octal, with a sign."""
    sign, body = (-1, text[1:]) if text[:1] == "-" else (1, text.lstrip("+"))
    if body[:2].lower() == "0x":
        return sign * int(body[2:], 16)
    if body[:1] == "#":
        return sign * int(body[1:], 16)
    return sign * int(body, 8 if len(body) > 1 and body[0] == "0" else 10)


def _verified(r: Rect) -> Rect:
    if not (-U.MAX_LAT <= r[0] <= r[2] <= U.MAX_LAT and -U.MAX_LON <= r[1] <= r[3] <= U.MAX_LON):
        raise TextError(f"invalid area {r}")
    return r


def read_area_list(text: str) -> list[tuple[int, Rect]]:
    out = []
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        m = _AREA.fullmatch(line)
        if not m:
            raise TextError(f"no area: {line}")
        out.append((int(m[1]), _verified(tuple(_integer(x) for x in m.groups()[1:]))))
    return out


def _degrees(v: int) -> float:
    return 360.0 * v / U.UNITS


def write_area_list(areas: Iterable[tuple[int, Rect]]) -> str:
    out = ["# List of areas", "# mapid: bottom,left to top,right in map units, then in degrees", ""]
    for map_id, (a, b, c, d) in areas:
        out += [f"{map_id:08d}: {a},{b} to {c},{d}", f"#       : {_degrees(a):.6f},{_degrees(b):.6f} to {_degrees(c):.6f},{_degrees(d):.6f}", ""]
    return "\n".join(out) + "\n"


def read_areas(name: str, text: str) -> list[tuple[int, Rect]]:
    return read_kml(text) if re.search(r"\.kml(\.gz|\.bz2)?$", name) else read_area_list(text)


# KML


def read_kml(text: str) -> list[tuple[int, Rect]]:
    """Placemarks named by a number, each with five coordinate pairs of a rectangle."""
    import xml.etree.ElementTree as ET

    local = lambda e: e.tag.rpartition("}")[2]
    out = []
    for mark in (e for e in ET.fromstring(text).iter() if local(e) == "Placemark"):
        name = next((e.text or "" for e in mark.iter() if local(e) == "name"), "")
        spots = next((e.text or "" for e in mark.iter() if local(e) == "coordinates"), "").split()
        if not name.strip().isdigit():
            raise TextError(f"placemark {name!r} is not named by a number")
        if len(spots) != 5:
            raise TextError(f"placemark {name} has {len(spots)} points, not 5")
        (lon1, lat1), (lon2, lat2) = ([float(v) for v in spots[i].split(",")[:2]] for i in (0, 2))
        lat, lon = sorted(map(U.map_unit, (lat1, lat2))), sorted(map(U.map_unit, (lon1, lon2)))
        out.append((int(name), _verified((lat[0], lon[0], lat[1], lon[1]))))
    return out


def write_kml(areas: Iterable[tuple[int, Rect]]) -> str:
    out = ['<?xml version="1.0" encoding="UTF-8"?>', '<kml xmlns="http://www.opengis.net/kml/2.2">', "<Document>"]
    for map_id, (a, b, c, d) in areas:
        ring = " ".join(f"{_degrees(x):.7f},{_degrees(y):.7f}" for y, x in ((a, b), (a, d), (c, d), (c, b), (a, b)))
        out.append(f"<Placemark><name>{map_id:08d}</name><Polygon><outerBoundaryIs><LinearRing><coordinates>{ring}</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>")
    return "\n".join([*out, "</Document>", "</kml>", ""])


# polygons


def read_poly(text: str) -> tuple[str, list[tuple[bool, list[Point]]]]:
    """Name and rings (added or subtracted; points as lon, lat, closed) of a polygon file."""
    lines = [s.strip() for s in text.splitlines()]
    if not lines or not lines[0]:
        raise TextError("a polygon file begins with its name")
    rings, ring, inside, ended = [], [], None, False
    for s in lines[1:]:
        if not s:
            continue
        if inside is None:
            if s == "END":
                ended = True
                break
            inside, ring = not s.startswith("!"), []
        elif s == "END":
            if len(ring) < 3:
                raise TextError("a ring has three points at least")
            closed = ring if ring[0] == ring[-1] else [*ring, ring[0]]
            if crosses_itself(closed):
                raise TextError("a ring crosses itself")
            rings.append((inside, closed))
            inside = None
        else:
            lon, lat = map(float, s.split()[:2])
            ring.append((lon, lat))
    if not ended:
        raise TextError("the polygon file does not end")
    return lines[0], rings


def crosses_itself(ring: list[Point]) -> bool:
    edges = list(zip(ring, ring[1:], strict=False))

    def side(p: Point, q: Point, r: Point) -> float:
        return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])

    for i, (a, b) in enumerate(edges):
        for c, d in edges[i + 2 - (i == 0 and len(edges) == 0) :]:
            if side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0:
                return True
    return False


def outline(rects: list[Rect]) -> list[tuple[bool, list[tuple[int, int]]]]:
    """Rings (outer or hole) of the union of rectangles, as lat, lon corners, closed, without points on straight lines.

    Edges between a covered and an uncovered cell of the compressed grid are chained with the covered side on the left.
    """
    ys, xs = sorted({e for r in rects for e in (r[0], r[2])}), sorted({e for r in rects for e in (r[1], r[3])})
    at_y, at_x = {v: i for i, v in enumerate(ys)}, {v: i for i, v in enumerate(xs)}
    full = {(y, x) for r in rects for y in range(at_y[r[0]], at_y[r[2]]) for x in range(at_x[r[1]], at_x[r[3]])}
    nxt: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for y, x in full:
        for cell, a, b in (((y - 1, x), (y, x), (y, x + 1)), ((y, x + 1), (y, x + 1), (y + 1, x + 1)), ((y + 1, x), (y + 1, x + 1), (y + 1, x)), ((y, x - 1), (y + 1, x), (y, x))):
            if cell not in full:
                nxt.setdefault(a, []).append(b)
    out = []
    while nxt:
        start = min(nxt)
        ring, here, came = [start], start, (0, 0)
        while True:
            ways = nxt[here]
            # where two corners touch, turning left keeps rings apart
            ways.sort(key=lambda p: -(came[1] * (p[0] - here[0]) - came[0] * (p[1] - here[1])) if came != (0, 0) else 0)
            new = ways.pop(0)
            if not ways:
                del nxt[here]
            came, here = (new[0] - here[0], new[1] - here[1]), new
            ring.append(here)
            if here == start:
                break
        pts = [(ys[y], xs[x]) for y, x in ring]
        body = pts[:-1]
        kept = [p for i, p in enumerate(body) if not ((body[i - 1][0] == p[0] == body[(i + 1) % len(body)][0]) or (body[i - 1][1] == p[1] == body[(i + 1) % len(body)][1]))]
        area = sum(a[1] * b[0] - b[1] * a[0] for a, b in zip(kept, [*kept[1:], kept[0]], strict=True))
        out.append((area > 0, [*kept, kept[0]]))
    return out


def write_poly(name: str, rects: list[Rect]) -> str:
    out = [name]
    for i, (outer, ring) in enumerate(outline(rects), 1):
        out += [f"{'' if outer else '!'}{i}", *(f"  {_degrees(x): .6E}  {_degrees(y): .6E}" for y, x in ring), "END"]
    return "\n".join([*out, "END", ""])


def in_rings(rings: list[tuple[bool, list[Point]]], lon: float, lat: float) -> bool:
    """Whether a point lies in the added rings and not in the subtracted ones."""
    held = False
    for added, ring in rings:
        inside = False
        for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
            if (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
                inside = not inside
        if inside:
            held = added
    return held


# names, problems, cities, densities, sea


def write_template(areas: Iterable[tuple[int, str | None]], form: str = "osm.pbf", first_id: int | None = None) -> str:
    """mapname, description (50 characters at most) and input file of each tile; first_id renumbers the map names."""
    out = ["#", "# Arguments for building maps from the tiles", "#"]
    for i, (map_id, name) in enumerate(areas):
        out += [f"mapname: {map_id if first_id is None else first_id + i:08d}", f"description: {name[:50]}" if name else "# description: tile", f"input-file: {map_id:08d}.{form}", ""]
    return "\n".join(out)


def read_problems(text: str) -> list[tuple[str, int]]:
    """way: id and rel: id, with comments; blanks around the colon are allowed, so reports can be read again."""
    out = []
    for line in text.splitlines():
        body = line.partition("#")[0].strip()
        if not body:
            continue
        kind, colon, number = (s.strip() for s in body.partition(":"))
        if not colon or kind not in ("way", "rel") or not re.fullmatch(r"-?\d+", number):
            raise TextError(f"no problem element: {line}")
        out.append((kind, int(number)))
    return out


def problem_lines(problems: DataFrame) -> DataFrame:
    """value: the report's lines, ways first, by id; sorted by Spark, as their number grows with the map."""
    return problems.orderBy(F.col("kind") != "way", "id").select(F.concat("kind", F.lit(": "), F.col("id").cast("string"), F.lit(" #")).alias("value"))


def problem_parts(line: Column) -> Column:
    """kind and id of a line of a problem list; null where there is none but a comment, an error where it is broken."""
    body = F.regexp_replace(F.regexp_replace(line, "#.*", ""), r"^\s+|\s+$", "")
    kind, number = (F.regexp_extract(body, r"^(way|rel)\s*:\s*(-?\d+)$", i) for i in (1, 2))
    broken = F.raise_error(F.concat(F.lit("no problem element: "), line)).cast("struct<kind:string,id:bigint>")
    return F.when(body == "", F.lit(None)).when(kind == "", broken).otherwise(F.struct(kind.alias("kind"), number.cast("long").alias("id")))


def scan_problems(spark: SparkSession, path: str) -> DataFrame:
    """kind, id of a problem list of any length, line by line."""
    return spark.read.text(path).select(problem_parts(F.col("value")).alias("p")).where("p is not null").select("p.kind", "p.id")


def read_cities(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated gazetteer; lines with broken numbers are left out."""
    raw = spark.read.text(path).select(F.split("value", "\t").alias("f"))
    f = lambda i: F.get("f", F.lit(i))
    out = raw.select(f(0).try_cast("int").alias("id"), f(8).alias("country"), F.coalesce(F.nullif(f(2), F.lit("")), f(1)).alias("name"), to_map_unit(f(4).try_cast("double")).alias("lat"), to_map_unit(f(5).try_cast("double")).alias("lon"), f(14).try_cast("int").alias("population"))
    return out.where("id is not null and lat is not null and lon is not null and population is not null")


NO_BOUNDS = "no_bounds_in_input"  # fixed value of the format


def write_density(cells: Iterable[tuple[int, int, int]], detail: Rect, told: Rect | None = None) -> str:
    """Two lines of bounds, of the nodes and as the input told them, then x, y and number of each cell with nodes."""
    head = [",".join(map(str, detail)), ",".join(map(str, told)) if told else NO_BOUNDS]
    return "\n".join([*head, *(f"{x},{y},{n}" for x, y, n in sorted(cells) if n), ""])


def read_density(text: str) -> tuple[list[tuple[int, int, int]], Rect, Rect | None]:
    """Cells, bounds of the nodes, and those that the input told, if any."""
    lines = text.splitlines()

    def numbers(at: int, many: int) -> tuple[int, ...]:
        try:
            out = tuple(map(int, lines[at].split(",")))
        except (IndexError, ValueError):
            out = ()
        if len(out) != many:
            raise TextError(f"density file, line {at + 1}: {many} numbers are needed")
        return out

    told = None if len(lines) > 1 and lines[1].strip() == NO_BOUNDS else numbers(1, 4)
    return [numbers(i, 3) for i in range(2, len(lines)) if lines[i].strip()], numbers(0, 4), told


SEA_STEP = 1 << 15


def read_sea_index(text: str, bounds: Rect) -> dict[str, list[str]]:
    """Tiles of the sea raster that meet the bounds: sea, land, and the files of mixed ones."""
    out: dict[str, list[str]] = {"sea": [], "land": [], "files": []}
    for line in text.splitlines():
        m = re.fullmatch(r"\s*(-?\d+)_(-?\d+)\s*;\s*(\S+)\s*", line.partition("#")[0])
        if not m:
            continue
        lat, lon = int(m[1]), int(m[2])
        if lat < bounds[2] and lat + SEA_STEP > bounds[0] and lon < bounds[3] and lon + SEA_STEP > bounds[1]:
            out[m[3] if m[3] in ("sea", "land") else "files"].append(f"{lat}_{lon}" if m[3] in ("sea", "land") else m[3])
    return out
