"""Queries through the text formats, the map readers and the parts of the solver, with SQL that knows nothing of either."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tessella.functions import units as U
from tessella.operators import complete as C
from tessella.operators import density as D
from tessella.operators import problems as P
from tessella.operators import rangejoin as R
from tessella.operators import regions
from tessella.operators import solver as S
from tessella.operators.bounded import shared_folder
from tessella.plans import lens as L
from tessella.plans import queries as Q
from tessella.plans.files import SHIFT, _clustered, _elements
from tessella.plans.lens import sql
from tessella.plans.registry import QUERIES, query
from tessella.sources import element, maps, o5m, pbf, texts, tilewriter, xml

RECT = "min_lat int, min_lon int, max_lat int, max_lon int"
AREA_SQL = "CAST(63240001 + area_idx AS INTEGER) AS map_id, min_lat, min_lon, max_lat, max_lon"


def _area_rows(spark) -> list[tuple[int, tuple[int, int, int, int]]]:
    """map id and edges of the grid's areas: a fixed number of rows."""
    return [(r.map_id, (r.min_lat, r.min_lon, r.max_lat, r.max_lon)) for r in L.areas(spark).orderBy("area_idx").collect()]


def _frame(spark, rows, schema):
    return spark.createDataFrame(list(rows), schema)


# text formats, written and read back


@query("areas_list", sql(f"SELECT {AREA_SQL} FROM areas"))
def areas_list(spark, sf):
    return _frame(spark, [(m, *r) for m, r in texts.read_areas("areas.list", texts.write_area_list(_area_rows(spark)))], f"map_id int, {RECT}")


@query("areas_kml", sql(f"SELECT {AREA_SQL} FROM areas"))
def areas_kml(spark, sf):
    return _frame(spark, [(m, *r) for m, r in texts.read_areas("areas.kml", texts.write_kml(_area_rows(spark)))], f"map_id int, {RECT}")


_DEGREE = "format('{{:.6E}}', CAST({} AS DOUBLE) * 360 / 16777216)"


@query("areas_poly", sql(f"SELECT DISTINCT CAST(63240001 + area_idx AS INTEGER) AS map_id, {_DEGREE.format('unnest([min_lon, min_lon, max_lon, max_lon])')} AS lon, {_DEGREE.format('unnest([min_lat, max_lat, min_lat, max_lat])')} AS lat FROM areas"))
def areas_poly(spark, sf):
    """The corners of each area as the polygon format spells them."""
    rows = set()
    for m, r in _area_rows(spark):
        name, rings = texts.read_poly(texts.write_poly(str(m), [r]))
        rows |= {(int(name), f"{x:.6E}", f"{y:.6E}") for _, ring in rings for x, y in ring}
    return _frame(spark, sorted(rows), "map_id int, lon string, lat string")


@query("areas_outline", sql("SELECT unnest([min(min_lat), min(min_lat), max(max_lat), max(max_lat)]) AS lat, unnest([min(min_lon), max(max_lon), min(min_lon), max(max_lon)]) AS lon FROM areas"))
def areas_outline(spark, sf):
    """Corners of the union of all areas."""
    return _frame(spark, {p for _, ring in texts.outline([r for _, r in _area_rows(spark)]) for p in ring}, "lat int, lon int")


@query("template_args", sql("SELECT lpad(CAST(63240001 + area_idx AS VARCHAR), 8, '0') AS mapname, CASE WHEN area_idx % 2 = 0 THEN 'Tile ' || area_idx END AS description, lpad(CAST(63240001 + area_idx AS VARCHAR), 8, '0') || '.o5m' AS input_file FROM areas"))
def template_args(spark, sf):
    text = texts.write_template([(m, f"Tile {m - 63240001}" if m % 2 else None) for m, _ in _area_rows(spark)], "o5m")
    lines = pd.Series(text.splitlines()).str.partition(": ")
    keyed = lines[lines[0].isin(["mapname", "description", "input-file", "# description"])].values.tolist()
    rows = [(a[2], b[2] if b[0] == "description" else None, c[2]) for a, b, c in zip(keyed[::3], keyed[1::3], keyed[2::3], strict=True)]
    return _frame(spark, rows, "mapname string, description string, input_file string")


@query("problem_report", sql("SELECT CAST(row_number() OVER (ORDER BY kind DESC, id) AS BIGINT) AS line, kind, id FROM (SELECT 'way' AS kind, way_id AS id FROM problem_ways UNION SELECT 'rel', rel_id FROM problem_rels)"))
def problem_report(spark, sf):
    """The report's lines in their order: written sorted by Spark, read back line by line."""
    told = texts.problem_lines(Q.all_problems(spark, sf))
    folder = f"{shared_folder(spark)}/problems"
    told.write.text(folder)
    return texts.scan_problems(spark, folder).selectExpr("row_number() OVER (ORDER BY kind DESC, id) AS line", "kind", "id").withColumn("line", F.col("line").cast("long"))


@query("density_file", Q._with("d AS (" + Q.DENSITY.format("clustered") + ")", "SELECT x, y, n FROM d"))
def density_file(spark, sf):
    cells = [(r.x, r.y, r.n) for r in Q._cells(spark, sf).collect()]  # bounded by the grid
    back, detail, told = texts.read_density(texts.write_density(cells, (1, 2, 3, 4), None))
    assert detail == (1, 2, 3, 4) and told is None
    return _frame(spark, back, "x int, y int, n long")


@query("city_file", Q._with(Q.CITIES, "SELECT id, country, name, lat, lon, population FROM c"))
def city_file(spark, sf):
    """The gazetteer as tab-separated lines; two broken ones are left out."""
    c = L.cities(spark, sf)
    degrees = lambda v: F.format_string("%.7f", U.to_degrees(F.col(v)))
    empty = F.lit("")
    lines = c.select(F.concat_ws("\t", F.col("id").cast("string"), "name", F.when(F.col("id") % 2 == 0, F.col("name")).otherwise(""), empty, degrees("lat"), degrees("lon"), empty, empty, "country", *[empty] * 5, F.col("population").cast("string")).alias("value"))
    folder = f"{shared_folder(spark)}/cities"
    lines.union(_frame(spark, [("x\tbroken",), ("",)], "value string")).write.text(folder)
    return texts.read_cities(spark, folder)


SEA = "CAST((k // 20 - 5) * 32768 AS BIGINT) AS lat, CAST((k % 20 - 10) * 32768 AS BIGINT) AS lon"


@query("sea_index", f"SELECT CASE k % 3 WHEN 0 THEN 'sea' WHEN 1 THEN 'land' ELSE 'files' END AS kind, CASE k % 3 WHEN 2 THEN 'sea_' || k || '.osm.pbf' ELSE lat || '_' || lon END AS name FROM (SELECT k, {SEA} FROM range(200) t(k)) WHERE lat < 100000 AND lat + 32768 > -70000 AND lon < 200000 AND lon + 32768 > -32768")
def sea_index(spark, sf):
    lines = [f"{(k // 20 - 5) * 32768}_{(k % 20 - 10) * 32768};{('sea', 'land', f'sea_{k}.osm.pbf')[k % 3]}" for k in range(200)]
    found = texts.read_sea_index("\n".join(["# made", *lines, ""]), (-70_000, -32_768, 100_000, 200_000))
    return _frame(spark, [(k, n) for k, names in found.items() for n in names], "kind string, name string")


# numbers

STRINGS = ["0", "-0", "1", "+7", "-1.5", ".5", "-.25", "12.", "3e2", "-4.25E-3", "1e+1", "007.125", "179.9999999", "-89.12345678901234", "123456789.123456789", "0.000000001", "9007199254740993", "1.7976931348623157e308", "4.9e-324", " 2.5 ", "1,5", "--1", "e5", "1e", "", "12abc", "0x10", "1 2"]


@query("decimal_strings", "SELECT CAST(nth AS INTEGER) AS nth, TRY_CAST(s AS DOUBLE) AS v FROM (SELECT unnest(range(28)) AS nth, unnest([" + ", ".join(f"'{s}'" for s in STRINGS) + "]) AS s)")
def decimal_strings(spark, sf):
    return _frame(spark, list(enumerate(STRINGS)), "nth int, s string").select("nth", F.col("s").try_cast("double").alias("v"))


@query("rounding_sweep", "SELECT CAST(v AS INTEGER) AS v, CAST((v >> 11) * 2048 AS INTEGER) AS down, CAST(((v + 2047) >> 11) * 2048 AS INTEGER) AS up, CAST(((v + 2) >> 2) * 4 AS INTEGER) AS near FROM range(-50000, 50001, 19) t(v)")
def rounding_sweep(spark, sf):
    v = F.col("v")
    return spark.range(-50_000, 50_001, 19).select(F.col("id").cast("int").alias("v")).select("v", U.round_down(v, 11).alias("down"), U.round_up(v, 11).alias("up"), U.round_near(v, 2).alias("near"))


@query("valid_nodes", sql("SELECT id, map_lat * 360.0::DOUBLE / 16777216 * 1.6::DOUBLE BETWEEN -90 AND 90 AND map_lon * 360.0::DOUBLE / 16777216 * 1.1::DOUBLE BETWEEN -180 AND 180 AS ok FROM nodes"))
def valid_nodes(spark, sf):
    return L.nodes(spark, sf).select("id", U.valid_node(U.to_degrees(F.col("map_lat")) * 1.6, U.to_degrees(F.col("map_lon")) * 1.1).alias("ok"))


@query("clockwise_rings", sql("SELECT area_idx, area_idx % 2 = 0 AS clockwise FROM areas"))
def clockwise_rings(spark, sf):
    """Every second area's ring runs up first, the others' to the right first."""
    p = lambda y, x: F.struct(F.col(y).alias("lat"), F.col(x).alias("lon"))
    ring = F.array(p("min_lat", "min_lon"), p("max_lat", "min_lon"), p("max_lat", "max_lon"), p("min_lat", "max_lon"), p("min_lat", "min_lon"))
    return L.areas(spark).select("area_idx", U.clockwise(F.when(F.col("area_idx") % 2 == 0, ring).otherwise(F.reverse(ring))).alias("clockwise"))


@query("crossing_ways", sql("SELECT way_id FROM boxes WHERE box_min_lon < 0 AND box_max_lon > 0 AND box_max_lon - box_min_lon >= 8388608"))
def crossing_ways(spark, sf):
    """Ways whose box is half the globe wide around the zero meridian: they cross the 180th rather."""
    return C.way_boxes(Q._points(spark, sf)).where(U.crosses_antimeridian(U.rect("box_"))).select("way_id")


@query("element_counts", sql("SELECT 'node' AS kind, count(*) AS n, max(id) AS last FROM nodes UNION ALL SELECT 'way', count(*), max(id) FROM ways"))
def element_counts(spark, sf):
    """Counted while the box of the nodes is computed: the scan is the only one."""
    read, seen = element.observed(_elements(spark, sf))
    read.agg(F.min("lat"), F.max("lat")).collect()
    return element.told(spark, seen)


# map files


def _xml_file(pdfs):
    for pdf in pdfs:
        rows = [(r.kind, int(r.id), 0, r.lat, r.lon, None if r.refs is None else [int(x) for x in r.refs], None, [(t["k"], t["v"]) for t in r.tags], None) for r in pdf.itertuples()]
        yield pd.DataFrame({"value": [xml.encode(rows, (-1.5, -2.5, 1.5, 2.5)).decode()]})


_BY_KIND = "SELECT 'node' AS kind, count(*) AS n, CAST(sum(id) AS BIGINT) AS id_sum, CAST(0 AS BIGINT) AS ref_sum, count(*) AS n_tags FROM nodes UNION ALL SELECT 'way', count(*), CAST(sum(way_id) AS BIGINT), CAST(sum(s) AS BIGINT), CAST(0 AS BIGINT) FROM (SELECT way_id, sum(node_id) AS s FROM refs GROUP BY way_id)"


def _summed(elements):
    refs = F.aggregate(F.coalesce("refs", F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda a, x: a + x)
    return elements.groupBy("kind").agg(F.count("*").alias("n"), F.sum("id").alias("id_sum"), F.sum(refs).alias("ref_sum"), F.sum(F.size("tags")).cast("long").alias("n_tags"))


@query("elements_xml", sql(_BY_KIND))
def elements_xml(spark, sf):
    """Compressed XML files, a header and bounds in each, through the reader: one task each, so they are as many as the tasks that the data take."""
    folder = f"{shared_folder(spark)}/xml"
    _elements(spark, sf).repartition("id").mapInPandas(_xml_file, "value string").write.option("compression", "gzip").text(folder)
    return _summed(maps.read_elements(spark, [folder], ("node", "way")))


@query("bounds_xml", "SELECT CAST(trunc((-1.5 - 0.0000107288360595703125) * 16777216 / 360) AS INTEGER) AS min_lat, CAST(trunc((-2.5 - 0.0000107288360595703125) * 16777216 / 360) AS INTEGER) AS min_lon, CAST(trunc((1.5 + 0.0000107288360595703125) * 16777216 / 360) AS INTEGER) AS max_lat, CAST(trunc((2.5 + 0.0000107288360595703125) * 16777216 / 360) AS INTEGER) AS max_lon")
def bounds_xml(spark, sf):
    folder = f"{shared_folder(spark)}/xml"
    _elements(spark, sf).limit(10).mapInPandas(_xml_file, "value string").write.text(folder)
    return D.union_bounds(element.bounds(maps.read_elements(spark, [folder])))


def _binary(form):
    """A tile written by an executor and read back as a file of its format: nodes only, to stay small."""

    def run(spark, sf):
        folder = f"{shared_folder(spark)}/{form}"
        nodes = _elements(spark, sf).where("kind = 'node'")
        tiles = nodes.select("kind", "id", F.array(F.lit(0)).alias("areas"))
        world = spark.createDataFrame([(0, 7, *D.WORLD)], f"area_idx int, map_id int, {RECT}")
        tilewriter.save_tiles(nodes, tiles, world, folder, form)
        back = maps.read_elements(spark, [f"{folder}/00000007.{maps.EXTENSIONS[form]}"], ("node",))
        return element.nodes(back).select("id", "map_lat", "map_lon")

    return run


for _form in ("pbf", "o5m", "xml"):
    query(f"node_file_{_form}", sql("SELECT id, map_lat, map_lon FROM nodes"))(_binary(_form))


# areas


@query("disjoint_extents", sql("""
SELECT areas, CAST(sum((t - b) * (r - l)) AS BIGINT) AS extent FROM (
  SELECT b, t, l, r, string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) AS areas FROM
    (SELECT CAST(v AS BIGINT) AS b, CAST(lead(v) OVER (ORDER BY v) AS BIGINT) AS t FROM (SELECT min_lat AS v FROM areas UNION SELECT max_lat FROM areas UNION SELECT min_lat FROM shifted UNION SELECT max_lat FROM shifted)),
    (SELECT CAST(v AS BIGINT) AS l, CAST(lead(v) OVER (ORDER BY v) AS BIGINT) AS r FROM (SELECT min_lon AS v FROM areas UNION SELECT max_lon FROM areas UNION SELECT min_lon FROM shifted UNION SELECT max_lon FROM shifted)),
    (SELECT area_idx AS k, min_lat, min_lon, max_lat, max_lon FROM areas UNION ALL SELECT area_idx + 100, min_lat, min_lon, max_lat, max_lon FROM shifted)
  WHERE b >= min_lat AND t <= max_lat AND l >= min_lon AND r <= max_lon GROUP BY ALL)
GROUP BY areas"""))
def disjoint_extents(spark, sf):
    """Disjoint parts of overlapping areas, by the set of areas that cover them."""
    both = L.areas(spark).drop("map_id").union(L.shifted_areas(spark).withColumn("area_idx", F.col("area_idx") + 100))
    listed = [tuple(r) for r in both.collect()]
    parts = P.disjoint([r[1:] for r in listed])
    rows = [(",".join(str(k) for k, a, b, c, d in sorted(listed) if a <= p[0] and b <= p[1] and c >= p[2] and d >= p[3]), P.extent([p])) for p in parts]
    return _frame(spark, rows, "areas string, extent long").groupBy("areas").agg(F.sum("extent").alias("extent"))


@query("planet_cover", sql("SELECT CAST(8388608 AS BIGINT) * 16777216 - covered AS free, covered FROM (SELECT CAST(sum(CAST(max_lat - min_lat AS BIGINT) * (max_lon - min_lon)) AS BIGINT) AS covered FROM areas)"))
def planet_cover(spark, sf):
    own = [r for _, r in _area_rows(spark)]
    rest = P.cover(own, D.WORLD)
    assert P.extent(P.disjoint([*own, *rest])) == P.extent([D.WORLD])
    return _frame(spark, [(P.extent(rest), P.extent(own))], "free long, covered long")


@query("neighbour_pairs", sql("SELECT a.area_idx AS a, b.area_idx AS b FROM areas a JOIN areas b ON a.area_idx < b.area_idx AND ((a.min_lat = b.min_lat AND a.max_lat = b.max_lat AND (a.max_lon = b.min_lon OR b.max_lon = a.min_lon)) OR (a.min_lon = b.min_lon AND a.max_lon = b.max_lon AND (a.max_lat = b.min_lat OR b.max_lat = a.min_lat)))"))
def neighbour_pairs(spark, sf):
    found = C.simple_neighbours([r for _, r in _area_rows(spark)], most=1)
    return _frame(spark, [tuple(s) for s in found if len(s) == 2], "a int, b int")


@query("region_areas", sql("SELECT area_idx FROM areas WHERE min_lat <= 1000000 AND max_lat >= -500000 AND min_lon <= 3000000 AND max_lon >= -1500000"))
def region_areas(spark, sf):
    """Areas that a polygon meets."""
    degree = 360 / U.UNITS
    a, b, c, d = (v * degree for v in (-500_000, -1_500_000, 1_000_000, 3_000_000))
    ring = [(True, [(b, a), (b, c), (d, c), (d, a), (b, a)])]
    return _frame(spark, [(m - 63240001,) for m, r in _area_rows(spark) if regions.meets(ring, r)], "area_idx int")


@query("area_names", Q._with(Q.CITIES, "SELECT CAST(area_idx AS INTEGER) AS area_idx, country || '-' || name AS name FROM c JOIN areas ON lat BETWEEN min_lat AND max_lat AND lon BETWEEN min_lon AND max_lon QUALIFY row_number() OVER (PARTITION BY area_idx ORDER BY population DESC, id) = 1"))
def area_names(spark, sf):
    return R.area_names(L.areas(spark), L.cities(spark, sf)).where("name is not null")


@query("unnamed_areas", sql("SELECT area_idx, CAST(NULL AS VARCHAR) AS name FROM areas"))
def unnamed_areas(spark, sf):
    """Without a gazetteer no area has a name."""
    return R.area_names(L.areas(spark), None)


# parts of the solver

CELLS = "d AS (" + Q.DENSITY.format("clustered") + "), e AS (SELECT x - (SELECT min(x) FROM d) AS x, y - (SELECT min(y) FROM d) AS y, n FROM d)"


@query("rectangle_counts", Q._with(CELLS, "SELECT CAST(k AS INTEGER) AS k, CAST(coalesce(sum(n) FILTER (WHERE x >= 3 * k AND x < 3 * k + 40 AND y >= 2 * k AND y < 2 * k + 25), 0) AS BIGINT) AS n FROM e, range(20) t(k) GROUP BY k"))
def rectangle_counts(spark, sf):
    """Nodes in twenty rectangles, from the prefix sums."""
    m = _clustered(spark, sf)
    clip = lambda k: S.Tile(3 * k, 2 * k, min(40, m.width - 3 * k), min(25, m.height - 2 * k))
    return _frame(spark, [(k, m.count(clip(k)) if min(clip(k)[2:]) > 0 else 0) for k in range(20)], "k int, n long")


@query("trimmed_map", Q._with(CELLS, "SELECT CAST(min(x) AS INTEGER) AS x, CAST(min(y) AS INTEGER) AS y, CAST(max(x) - min(x) + 1 AS INTEGER) AS w, CAST(max(y) - min(y) + 1 AS INTEGER) AS h FROM e WHERE x BETWEEN 10 AND 300 AND y BETWEEN 10 AND 200"))
def trimmed_map(spark, sf):
    """A part of the map without the empty lines at its edges."""
    m = _clustered(spark, sf)
    t = m.trimmed(S.Tile(10, 10, min(291, m.width - 10), min(191, m.height - 10)))
    return _frame(spark, [tuple(t)], "x int, y int, w int, h int")


@query("masked_counts", Q._with(CELLS, "SELECT CAST(coalesce(sum(n) FILTER (WHERE x >= 20 AND x < 120 AND y >= 15 AND y < 90), 0) AS BIGINT) AS inside, CAST(100 * 75 AS BIGINT) AS cells FROM e"))
def masked_counts(spark, sf):
    """Nodes in the cells of a polygon, and the number of those cells."""
    m = _clustered(spark, sf)
    degree, s = 360 / U.UNITS, SHIFT
    a, b = m.bounds[:2]
    y0, x0, y1, x1 = ((a + (15 << s)) * degree, (b + (20 << s)) * degree, (a + (90 << s)) * degree, (b + (120 << s)) * degree)
    mask = S.raster([(True, [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)])], m.bounds, s)
    x, y = m.grid.nonzero()
    inner = S.DensityMap((x, y, m.grid[x, y]), m.bounds, s, mask)
    return _frame(spark, [(inner.count(inner.whole), int(mask.sum()))], "inside long, cells long")


@query("split_positions", Q._with(CELLS + ", c AS (SELECT x, sum(n) AS n FROM e GROUP BY x), g AS (SELECT CAST(k AS BIGINT) AS x FROM (SELECT max(x) AS m FROM c), range(m) t(k)), r AS (SELECT g.x, sum(coalesce(n, 0)) OVER (ORDER BY g.x) AS upto, (SELECT sum(n) FROM c) AS total FROM g LEFT JOIN c USING (x))", "SELECT CAST(row_number() OVER (ORDER BY abs(2 * upto - total), x) AS INTEGER) AS nth, CAST(x + 1 AS INTEGER) AS at FROM r WHERE upto >= 300 AND total - upto >= 300"))
def split_positions(spark, sf):
    """Cuts of columns that leave 300 nodes on both sides, nearest to the middle of the nodes first."""
    m = _clustered(spark, sf)
    t = m.trimmed(m.whole)
    found = [at for axis, at in S.Search(m, 10**9, 300, 1e9, 1, False, None)._positions(t, m.count(t)) if axis == 0]
    return _frame(spark, list(enumerate(found, 1)), "nth int, at int")


@query("solution_metrics", Q._with(CELLS, "SELECT CAST(min(n) AS BIGINT) AS least, count(*) FILTER (WHERE 3 * n < 600) AS low FROM (SELECT k, j, coalesce(sum(n), 0) AS n FROM range(4) a(k) CROSS JOIN range(3) b(j) LEFT JOIN e ON x >= 25 * k AND x < 25 * k + 25 AND y >= 20 * j AND y < 20 * j + 20 GROUP BY k, j)"))
def solution_metrics(spark, sf):
    """The least filled of twelve tiles, and how many have less than a third of 600 nodes."""
    m = _clustered(spark, sf)
    s = S.describe(m, [S.Tile(25 * k, 20 * j, 25, 20) for k in range(4) for j in range(3)], 600)
    return _frame(spark, [(s.least, s.low)], "least long, low long")


__all__ = ["QUERIES", "o5m", "pbf"]
