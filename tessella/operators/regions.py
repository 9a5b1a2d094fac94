"""Named polygons and precompiled sea: what bounds a split or adds to its density."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import units as U
from tessella.functions.tags import get_tag
from tessella.operators import density as D
from tessella.sources import element, maps, texts

Rect = tuple[int, int, int, int]


def described_polygons(elements: DataFrame, shift: int) -> list[tuple[str, int, list]]:
    """name, map id and rings (degrees) of every way with name and mapid tags; corners lie on the grid.

    A row for each named region that somebody drew: a table for the driver.
    """
    nodes = element.nodes(elements).select(F.col("id").alias("node_id"), "map_lat", "map_lon")
    ways = element.ways(elements).select("id", get_tag(F.col("tags"), "name").alias("name"), get_tag(F.col("tags"), "mapid").try_cast("int").alias("map_id"), F.posexplode("refs").alias("pos", "node_id"))
    spots = ways.where("name is not null and map_id is not null").join(nodes, "node_id")
    rows = spots.groupBy("id", "name", "map_id").agg(F.array_sort(F.collect_list(F.struct("pos", "map_lat", "map_lon"))).alias("spots")).orderBy("map_id").collect()
    out = []
    for r in rows:
        ring = [(U.near(s.map_lon, shift) * 360 / U.UNITS, U.near(s.map_lat, shift) * 360 / U.UNITS) for s in r.spots]
        if len(ring) >= 3:
            out.append((r.name, r.map_id, [(True, ring if ring[0] == ring[-1] else [*ring, ring[0]])]))
    return out


def meets(rings, rect: Rect) -> bool:
    """Whether a polygon and a rectangle of map units have points in common, by corners and crossing edges."""
    degree = 360 / U.UNITS
    a, b, c, d = (v * degree for v in rect)
    if any(texts.in_rings(rings, x, y) for x, y in ((b, a), (d, a), (d, c), (b, c), ((b + d) / 2, (a + c) / 2))):
        return True
    for _, ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
            low, high = 0.0, 1.0
            for p, q, lo, hi in ((x1, x2 - x1, b, d), (y1, y2 - y1, a, c)):
                if q == 0:
                    if not lo <= p <= hi:
                        low, high = 1.0, 0.0
                    continue
                s, e = sorted(((lo - p) / q, (hi - p) / q))
                low, high = max(low, s), min(high, e)
            if low <= high:
                return True
    return False


def region_files(regions: list[tuple[str, int, list]], areas: list[tuple[int, Rect, str | None]], form: str) -> dict[str, str]:
    """For each region the outline and the arguments of the tiles that it meets; map names count on from its own id."""
    out = {}
    for name, map_id, rings in regions:
        own = [(m, r, n) for m, r, n in areas if meets(rings, r)]
        if own:
            out[f"{name}-areas.poly"] = texts.write_poly(name, [r for _, r, _ in own])
            out[f"{name}-template.args"] = texts.write_template([(m, n) for m, _, n in own], form, map_id)
            out[f"{name}-areas.kml"] = texts.write_kml((m, r) for m, r, _ in own)
    return out


def sea_index(spark: SparkSession, path: str) -> str:
    """The index of precompiled sea: index.txt.gz or index.txt of a folder, or of an archive (there in sea/ or at the top)."""
    if path.endswith(".zip"):
        import gzip
        import io
        import zipfile

        raw = spark.read.format("binaryFile").load(path).select("content").first()
        with zipfile.ZipFile(io.BytesIO(bytes(raw[0]))) as z:
            for name in ("sea/index.txt.gz", "sea/index.txt", "index.txt.gz", "index.txt"):
                if name in z.namelist():
                    data = z.read(name)
                    return (gzip.decompress(data) if name.endswith(".gz") else data).decode()
        raise texts.TextError(f"no index in {path}")
    found = {r.path.rpartition("/")[2]: r for r in spark.read.format("binaryFile").option("pathGlobFilter", "index.txt*").load(path).select("path", "content").collect()}  # two files at most
    for name in ("index.txt.gz", "index.txt"):
        if name in found:
            return maps.unpack(name, bytes(found[name].content)).decode()
    raise texts.TextError(f"no index.txt or index.txt.gz in {path}")


def sea_density(spark: SparkSession, path: str, bounds: Rect, shift: int) -> DataFrame | None:
    """The density of the mixed sea tiles that meet the bounds; only those files are decoded."""
    files = texts.read_sea_index(sea_index(spark, path), bounds)["files"]
    if not files:
        return None
    rows = maps.zipped(spark, path, files) if path.endswith(".zip") else maps.read_elements(spark, [f"{path.rstrip('/')}/{f}" for f in files], ("node",))
    nodes = element.nodes(rows)
    return D.density(nodes.select("id", "map_lat", "map_lon"), shift, bounds)
