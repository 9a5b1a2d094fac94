"""Queries over tiles of unequal size, which come from the nodes' own density, and over the pseudo areas around them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import units as U
from tessella.operators import density as D
from tessella.operators import problems as P
from tessella.operators import rangejoin as R
from tessella.operators.bounded import cut
from tessella.plans import lens as L
from tessella.plans import queries as Q
from tessella.plans.registry import query

LOW, HIGH = 11, 22  # tiles have sides from 2^11 to 2^22
EAST, SOUTH = 1 << 23, 1 << 22


def quad_tiles(spark, sf, clustered: int = 25, spread: int = 300) -> DataFrame:
    """Tiles that halve both sides as long as they hold more than so many nodes of either set, those of the lowest level aside; empty ones are left out."""
    both = L.clustered_nodes(spark, sf).select(F.lit(1).alias("c"), F.lit(0).alias("s"), "map_lat", "map_lon").unionAll(L.nodes(spark, sf).select(F.lit(0), F.lit(1), "map_lat", "map_lon"))
    cells = both.groupBy(F.shiftright(F.col("map_lat") + SOUTH, LOW).alias("y"), F.shiftright(F.col("map_lon") + EAST, LOW).alias("x")).agg(F.sum("c").alias("c"), F.sum("s").alias("s"))
    at = cells.select(F.explode(F.sequence(F.lit(0), F.lit(HIGH - LOW))).alias("up"), "y", "x", "c", "s")
    of = lambda v: F.call_function("shiftright", F.col(v), F.col("up"))
    levels = at.groupBy("up", of("y").alias("y"), of("x").alias("x")).agg(((F.sum("c") > clustered) | (F.sum("s") > spread)).alias("full"))
    above = levels.where("full").select((F.col("up") - 1).alias("up"), F.col("y").alias("py"), F.col("x").alias("px"))
    own = levels.where("not full or up = 0").withColumns({"py": F.shiftright("y", 1), "px": F.shiftright("x", 1)})
    top = own.where(F.col("up") == HIGH - LOW)
    tiles = own.where(F.col("up") < HIGH - LOW).join(above, ["up", "py", "px"], "left_semi").select(top.columns).unionAll(top)
    side = F.call_function("shiftleft", F.lit(1 << LOW), F.col("up"))
    low, left = F.col("y") * side - SOUTH, F.col("x") * side - EAST
    number = F.shiftleft("up", 25) + F.shiftleft("y", 13) + F.col("x")
    return tiles.select(number.cast("int").alias("area_idx"), low.cast("int").alias("min_lat"), left.cast("int").alias("min_lon"), (low + side).cast("int").alias("max_lat"), (left + side).cast("int").alias("max_lon"))


def _quad(name: str, clustered: int, spread: int) -> str:
    return f"""
{name}_l AS (
  SELECT up, y >> up AS y, x >> up AS x, sum(c) > {clustered} OR sum(s) > {spread} AS full_ FROM (
    SELECT (map_lat + {SOUTH}) >> {LOW} AS y, (map_lon + {EAST}) >> {LOW} AS x, 1 AS c, 0 AS s FROM clustered UNION ALL SELECT (map_lat + {SOUTH}) >> {LOW}, (map_lon + {EAST}) >> {LOW}, 0, 1 FROM nodes), range({HIGH - LOW + 1}) t(up)
  GROUP BY 1, 2, 3),
{name} AS MATERIALIZED (
  SELECT CAST((a.up << 25) + (a.y << 13) + a.x AS INTEGER) AS area_idx, CAST(a.y * ({1 << LOW} << a.up) - {SOUTH} AS INTEGER) AS min_lat, CAST(a.x * ({1 << LOW} << a.up) - {EAST} AS INTEGER) AS min_lon,
    CAST((a.y + 1) * ({1 << LOW} << a.up) - {SOUTH} AS INTEGER) AS max_lat, CAST((a.x + 1) * ({1 << LOW} << a.up) - {EAST} AS INTEGER) AS max_lon
  FROM {name}_l a LEFT JOIN {name}_l b ON b.up = a.up + 1 AND b.y = a.y >> 1 AND b.x = a.x >> 1
  WHERE (NOT a.full_ OR a.up = 0) AND (a.up = {HIGH - LOW} OR b.full_))"""


QUAD, COARSE = _quad("quad", 25, 300), _quad("coarse", 400, 300)
ALL = "every_ AS (SELECT 'spread' AS kind, * FROM nodes UNION ALL SELECT 'clustered', * FROM clustered)"


def _every(spark, sf) -> DataFrame:
    one = lambda df, kind: df.select(F.lit(kind).alias("kind"), "id", "map_lat", "map_lon")
    return one(L.nodes(spark, sf), "spread").unionAll(one(L.clustered_nodes(spark, sf), "clustered"))


@query("unequal_tiles", Q._with(QUAD, "SELECT * FROM quad"))
def unequal_tiles(spark, sf):
    return quad_tiles(spark, sf)


@query("unequal_tile_nodes", Q._with(f"{QUAD}, {ALL}", "SELECT kind, id, area_idx FROM every_ JOIN quad ON map_lat BETWEEN min_lat AND max_lat AND map_lon BETWEEN min_lon AND max_lon"))
def unequal_tile_nodes(spark, sf):
    """Nodes in tiles of sides that differ by three orders of magnitude."""
    return R.point_in_rect(_every(spark, sf), cut(quad_tiles(spark, sf))).select("kind", "id", "area_idx")


@query("unequal_tile_overlap", Q._with(f"{QUAD}, {ALL}", "SELECT kind, area_idx, count(*) AS n, CAST(sum(id) AS BIGINT) AS id_sum FROM every_ JOIN quad ON map_lat BETWEEN min_lat - 2000 AND max_lat + 2000 AND map_lon BETWEEN min_lon - 2000 AND max_lon + 2000 GROUP BY ALL"))
def unequal_tile_overlap(spark, sf):
    """The same tiles with extended bounds."""
    found = R.point_in_rect(_every(spark, sf), cut(quad_tiles(spark, sf)), 2000)
    return found.groupBy("kind", "area_idx").agg(F.count("*").alias("n"), F.sum("id").alias("id_sum"))


@query("unequal_tile_boxes", Q._with(QUAD, "SELECT id, count(*) AS n, CAST(sum(area_idx) AS BIGINT) AS idx_sum FROM (SELECT id, map_lat AS a, map_lon AS b, map_lat + (id % 13) * (id % 13) * 400 + 1 AS c, map_lon + (id % 7) * (id % 7) * 900 + 1 AS d FROM clustered) JOIN quad ON a < max_lat + 1 AND c > min_lat - 1 AND b < max_lon + 1 AND d > min_lon - 1 GROUP BY id"))
def unequal_tile_boxes(spark, sf):
    """Boxes from one to 60,000 units wide that reach into the tiles."""
    k, m = F.col("id") % 13, F.col("id") % 7
    boxes = L.clustered_nodes(spark, sf).select("id", F.col("map_lat").alias("box_min_lat"), F.col("map_lon").alias("box_min_lon"), (F.col("map_lat") + k * k * 400 + 1).alias("box_max_lat"), (F.col("map_lon") + m * m * 900 + 1).alias("box_max_lon"))
    return R.rect_near_rect(boxes, cut(quad_tiles(spark, sf))).groupBy("id").agg(F.count("*").alias("n"), F.sum("area_idx").alias("idx_sum"))


# pseudo areas


def with_pseudo(spark, areas: DataFrame) -> DataFrame:
    """area_idx, edges, is_pseudo: the areas made disjoint, and the pseudo areas that fill the rest of the world."""
    rects = P.disjoint([tuple(r) for r in areas.select("min_lat", "min_lon", "max_lat", "max_lon").collect()])  # a row for each tile
    rest = P.cover(rects, D.WORLD)
    return spark.createDataFrame([(i, *r, i >= len(rects)) for i, r in enumerate([*rects, *rest])], "area_idx int, min_lat int, min_lon int, max_lat int, max_lon int, is_pseudo boolean")


CORNERS = "CROSS JOIN (VALUES (-1, -1), (-1, 1), (1, -1), (1, 1)) o(dy, dx)"


@query("pseudo_area_nodes", Q._with(f"{COARSE}, {ALL}", f"""
SELECT kind, id, CAST(n_real AS BIGINT) AS n_real, n_open > 0 AS in_pseudo FROM
  (SELECT kind, id, count(area_idx) AS n_real FROM every_ LEFT JOIN coarse ON map_lat BETWEEN min_lat AND max_lat AND map_lon BETWEEN min_lon AND max_lon GROUP BY ALL)
  JOIN (SELECT kind, id, count(*) FILTER (NOT held) AS n_open FROM (
    SELECT kind, id, dy, dx, count(area_idx) > 0 AS held FROM (SELECT * FROM every_ {CORNERS}) LEFT JOIN coarse ON 2 * map_lat + dy BETWEEN 2 * min_lat AND 2 * max_lat AND 2 * map_lon + dx BETWEEN 2 * min_lon AND 2 * max_lon GROUP BY ALL)
  GROUP BY ALL) USING (kind, id)"""))
def pseudo_area_nodes(spark, sf):
    """How many tiles hold a node, and whether a pseudo area does: one corner of the unit square around it is then in no tile."""
    areas = with_pseudo(spark, quad_tiles(spark, sf, clustered=400))
    every = _every(spark, sf)
    found = R.point_in_rect(every, areas).join(F.broadcast(areas.select("area_idx", "is_pseudo")), "area_idx")  # a row for each tile and strip
    return found.groupBy("kind", "id").agg(F.count(F.when(~F.col("is_pseudo"), 1)).alias("n_real"), F.max("is_pseudo").alias("in_pseudo"))


# two overlapping tiles that leave strips of the nodes' range to pseudo areas
WIDE = [(U.map_unit(-59.0), U.map_unit(-169.0), U.map_unit(59.5), U.map_unit(160.0)), (U.map_unit(-59.0), U.map_unit(150.0), U.map_unit(59.5), U.map_unit(169.0))]
_PARTS = [(a, b, c, d) for a, b, c, d in ((WIDE[0][0], WIDE[0][1], WIDE[0][2], WIDE[1][1]), (WIDE[0][0], WIDE[1][1], WIDE[0][2], WIDE[0][3]), (WIDE[0][0], WIDE[0][3], WIDE[0][2], WIDE[1][3]))]
_REAL = ["0", "0,1", "1"]


@query("pseudo_one_tile_relations", Q._with(f"""
parts(k, a, b, c, d) AS (VALUES {", ".join(f"({k}, {a}, {b}, {c}, {d})" for k, (a, b, c, d) in enumerate(_PARTS))}),
in_parts AS (
  SELECT id AS node_id, k FROM nodes JOIN parts ON map_lat BETWEEN a AND c AND map_lon BETWEEN b AND d
  UNION ALL SELECT id, 99 FROM nodes WHERE map_lat <= {WIDE[0][0]} OR map_lat >= {WIDE[0][2]} OR map_lon <= {WIDE[0][1]} OR map_lon >= {WIDE[1][3]}),
of_rels AS (
  SELECT rel_id, k FROM members JOIN in_parts ON type = 'node' AND ref = node_id
  UNION SELECT rel_id, k FROM members JOIN refs ON type = 'way' AND ref = way_id JOIN in_parts USING (node_id))""",
    f"SELECT rel_id, CASE any_value(k) WHEN 0 THEN '{_REAL[0]}' WHEN 1 THEN '{_REAL[1]}' ELSE '{_REAL[2]}' END AS areas FROM of_rels JOIN wanted ON rel_id = id GROUP BY rel_id HAVING count(*) = 1 AND any_value(k) < 99"))
def pseudo_one_tile_relations(spark, sf):
    """Relations within one distinct area, translated to the tiles that hold it; those in pseudo areas drop out."""
    tiles = spark.createDataFrame([(i, *r) for i, r in enumerate(WIDE)], "area_idx int, min_lat int, min_lon int, max_lat int, max_lon int")
    areas = with_pseudo(spark, tiles)
    f = Q.Flow(spark, sf, areas)
    return Q._text(P.one_tile_relations(f.known, L.relations(spark, sf), f.rels, areas.where("not is_pseudo"), tiles))
