"""Queries that go through the solver, rings and tile files."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import units as U
from tessella.operators import complete as C
from tessella.operators import density as D
from tessella.operators import solver as S
from tessella.operators.bisect import bisect
from tessella.operators.bounded import shared_folder
from tessella.operators.rangejoin import point_in_rect
from tessella.plans import lens as L
from tessella.plans import queries as Q
from tessella.plans.lens import sql
from tessella.plans.registry import ORACLES, QUERIES, query
from tessella.schema import MEMBERS, TAGS
from tessella.sources import maps, tilewriter

SHIFT, MOST = 11, 400


def _clustered(spark, sf) -> S.DensityMap:
    nodes = L.clustered_nodes(spark, sf)
    a, b, c, d = D.bbox(nodes).first()
    bounds = (U.down(a, SHIFT), U.down(b, SHIFT), U.up(c, SHIFT), U.up(d, SHIFT))
    return S.density_map(D.density(nodes, SHIFT, bounds), bounds, SHIFT)


def _counted(spark, m, tiles):
    rows = [(i, *m.rect(t), m.count(t)) for i, t in enumerate(tiles)]
    return spark.createDataFrame(rows, "area_idx int, min_lat int, min_lon int, max_lat int, max_lon int, n long")


@query("solver_tiles")
def solver_tiles(spark, sf):
    m = _clustered(spark, sf)
    return _counted(spark, m, S.split_parallel(spark, m, MOST, 5000))


_AT = "CASE WHEN {1} >= 4 THEN (least(greatest({0}, {1} // 5), {1} - {1} // 5) // 2) * 2 END"
_SUMS = "SELECT *, sum(n) OVER t AS total, sum(n * (x - x0)) OVER t // sum(n) OVER t AS mx, sum(n * (y - y0)) OVER t // sum(n) OVER t AS my FROM {} WINDOW t AS (PARTITION BY x0, y0, w, h)"
_CHOSEN = "SELECT *, CASE WHEN total <= {1} THEN NULL WHEN w <= h THEN coalesce(ay, ax) ELSE coalesce(ax, ay) END AS pos, CASE WHEN w <= h THEN ay IS NOT NULL ELSE ax IS NULL END AS by_y FROM (SELECT *, CASE WHEN ax > 0 AND ax < w THEN ax END AS ax, CASE WHEN ay > 0 AND ay < h THEN ay END AS ay FROM (SELECT * EXCLUDE (mx, my), {2} AS ax, {3} AS ay FROM ({0})))"


def _chosen(table: str) -> str:
    return _CHOSEN.format(_SUMS.format(table), MOST, _AT.format("mx", "w"), _AT.format("my", "h"))


BISECTED = f"""
b AS (SELECT min(map_lat) >> {SHIFT} << {SHIFT} AS a, min(map_lon) >> {SHIFT} << {SHIFT} AS b, (max(map_lat) + {(1 << SHIFT) - 1}) >> {SHIFT} << {SHIFT} AS c, (max(map_lon) + {(1 << SHIFT) - 1}) >> {SHIFT} << {SHIFT} AS d FROM clustered),
cells0 AS (SELECT least((map_lon - b) >> {SHIFT}, ((d - b) >> {SHIFT}) - 1) AS x, least((map_lat - a) >> {SHIFT}, ((c - a) >> {SHIFT}) - 1) AS y, count(*) AS n FROM clustered, b GROUP BY ALL),
levels AS (SELECT * FROM (WITH RECURSIVE r AS (
  SELECT x, y, n, CAST(0 AS BIGINT) AS x0, CAST(0 AS BIGINT) AS y0, CAST((d - b) >> {SHIFT} AS BIGINT) AS w, CAST((c - a) >> {SHIFT} AS BIGINT) AS h FROM cells0, b
  UNION ALL
  SELECT x, y, n, CASE WHEN NOT by_y AND x - x0 >= pos THEN x0 + pos ELSE x0 END, CASE WHEN by_y AND y - y0 >= pos THEN y0 + pos ELSE y0 END,
    CASE WHEN by_y THEN w WHEN x - x0 >= pos THEN w - pos ELSE pos END, CASE WHEN NOT by_y THEN h WHEN y - y0 >= pos THEN h - pos ELSE pos END
  FROM ({_chosen("r")}) WHERE pos IS NOT NULL) SELECT * FROM r))"""


@query("bisect_tiles", Q._with(BISECTED, f"SELECT CAST(a + (y0 << {SHIFT}) AS INTEGER) AS min_lat, CAST(b + (x0 << {SHIFT}) AS INTEGER) AS min_lon, CAST(a + ((y0 + h) << {SHIFT}) AS INTEGER) AS max_lat, CAST(b + ((x0 + w) << {SHIFT}) AS INTEGER) AS max_lon, CAST(sum(n) AS BIGINT) AS n FROM ({_chosen('levels')}), b WHERE pos IS NULL GROUP BY a, b, x0, y0, w, h"))
def bisect_tiles(spark, sf):
    """Tiles of the clustered nodes, level by level."""
    nodes = L.clustered_nodes(spark, sf)
    a, b, c, d = D.bbox(nodes).first()
    bounds = (U.down(a, SHIFT), U.down(b, SHIFT), U.up(c, SHIFT), U.up(d, SHIFT))
    found = bisect(D.density(nodes, SHIFT, bounds), bounds[3] - bounds[1] >> SHIFT, bounds[2] - bounds[0] >> SHIFT, MOST)
    at = lambda low, *v: (F.shiftleft(sum(map(F.col, v)), SHIFT) + low).cast("int")
    return found.select(at(bounds[0], "y0").alias("min_lat"), at(bounds[1], "x0").alias("min_lon"), at(bounds[0], "y0", "h").alias("max_lat"), at(bounds[1], "x0", "w").alias("max_lon"), "n")


@query("number_of_tiles")
def number_of_tiles(spark, sf):
    m = _clustered(spark, sf)
    return _counted(spark, m, S.split_by_number(m, 12, 5000))


@query("solved_total", sql("SELECT count(*) AS n FROM clustered"))
def solved_total(spark, sf):
    """The nodes in all solved tiles are those of the map."""
    m = _clustered(spark, sf)
    return _counted(spark, m, S.split_parallel(spark, m, MOST, 5000)).agg(F.sum("n").alias("n"))


@query("solved_nodes", sql("SELECT count(*) AS n FROM clustered"))
def solved_nodes(spark, sf):
    """Every node lies in a solved tile, whose borders belong to both sides."""
    m = _clustered(spark, sf)
    nodes = L.clustered_nodes(spark, sf)
    return point_in_rect(nodes, S.areas(spark, m, S.split_parallel(spark, m, MOST, 5000))).select("id").distinct().agg(F.count("*").alias("n"))


def _ring_sql(extra: str, own: str, ends: str) -> str:
    """Rings of own (rel_id, pos, way_id) with ends (way_id, first, last): members joined by pairs of ends, reached step by step."""
    return Q._with(f"""{extra}
own AS MATERIALIZED ({own}), way_ends AS ({ends}),
m AS MATERIALIZED (SELECT rel_id, pos, first, last, b.*, first IS NOT NULL AND b.way_id IS NOT NULL AS usable FROM own LEFT JOIN way_ends USING (way_id) LEFT JOIN boxes b USING (way_id)),
e AS (SELECT rel_id, pos, side, CASE side WHEN 0 THEN first ELSE last END AS node FROM m, range(2) t(side) WHERE usable AND first <> last),
p AS MATERIALIZED (
  SELECT rel_id, pos, CASE WHEN row_number() OVER w % 2 = 1 THEN lead(pos) OVER w ELSE lag(pos) OVER w END AS npos FROM e WINDOW w AS (PARTITION BY rel_id, node ORDER BY pos DESC, side DESC)),
c AS (SELECT * FROM (WITH RECURSIVE r AS (SELECT rel_id, pos, pos AS other FROM m WHERE usable UNION SELECT r.rel_id, r.pos, p.npos FROM r JOIN p ON p.rel_id = r.rel_id AND p.pos = r.other WHERE p.npos IS NOT NULL) SELECT rel_id, pos, max(other) AS ring FROM r GROUP BY ALL)),
o AS (SELECT rel_id, pos, bool_or(npos IS NULL) AS open_ FROM p GROUP BY ALL),
w AS (SELECT rel_id, bool_and(usable) AS whole FROM m GROUP BY rel_id)""", """
SELECT rel_id, ring, min(box_min_lat) AS box_min_lat, min(box_min_lon) AS box_min_lon, max(box_max_lat) AS box_max_lat, max(box_max_lon) AS box_max_lon, any_value(whole) AND NOT bool_or(coalesce(open_, false)) AS complete
FROM c JOIN m USING (rel_id, pos) JOIN w USING (rel_id) LEFT JOIN o USING (rel_id, pos) GROUP BY rel_id, ring""")


@query("ring_boxes", _ring_sql("", "SELECT rel_id, CAST(ref AS INTEGER) AS pos, ref AS way_id FROM members JOIN kinds ON rel_id = id WHERE members.type = 'way' AND role <> 'inner' AND kinds.type IN ('multipolygon', 'boundary')", "SELECT id AS way_id, refs[1] AS first, refs[len(refs)] AS last FROM ways WHERE len(refs) > 1"))
def ring_boxes(spark, sf):
    ways = L.ways(spark, sf)
    ends = ways.where(F.size("refs") > 1).select(F.col("id").alias("way_id"), F.element_at("refs", 1).alias("first"), F.element_at("refs", -1).alias("last"))
    mem = L.members(spark, sf).withColumn("pos", F.col("ref").cast("int"))
    boxes = C.way_boxes(C.way_points(L.way_refs(spark, sf), L.nodes(spark, sf)))
    return C.rings(L.relations(spark, sf), mem, ends, boxes)


# a relation for each nation; its members are orders' ways, whose ends meet in few nodes, so that chains, circles and junctions arise
_OF_NATION = "SELECT c_nationkey + 2000000 AS rel_id, CAST(o_orderkey AS INTEGER) AS pos, o_orderkey + 1 AS way_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority <> '5-LOW'"
_MEETING = "SELECT o_orderkey + 1 AS way_id, (o_orderkey * 7) % 211 AS first, (o_orderkey * 13 + o_custkey) % 211 AS last FROM orders WHERE o_orderkey % 400 <> 3"


@query("ring_junctions", _ring_sql("", _OF_NATION, _MEETING))
def ring_junctions(spark, sf):
    """Rings where many ends meet in a node, some members are missing and others closed."""
    key = F.col("o_orderkey")
    orders = L.read(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderpriority")
    of = orders.join(L.read(spark, sf, "customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    role = F.when(F.col("o_orderpriority") == "5-LOW", "inner").otherwise("outer")
    mem = of.select((F.col("c_nationkey") + F.lit(2_000_000).cast("long")).alias("rel_id"), key.cast("int").alias("pos"), F.lit("way").alias("type"), (key + 1).alias("ref"), role.alias("role"))
    ends = orders.where("o_orderkey % 400 <> 3").select((key + 1).alias("way_id"), (key * 7 % 211).alias("first"), ((key * 13 + F.col("o_custkey")) % 211).alias("last"))
    boxes = C.way_boxes(C.way_points(L.way_refs(spark, sf), L.nodes(spark, sf)))
    return C.rings(L.relations(spark, sf), mem, ends, boxes)


def _elements(spark, sf):
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    nodes = L.nodes(spark, sf).select(F.lit("node").alias("kind"), "id", F.lit(1).alias("version"), U.to_degrees(F.col("map_lat")).alias("lat"), U.to_degrees(F.col("map_lon")).alias("lon"), none("array<bigint>", "refs"), none(MEMBERS.replace("long", "bigint"), "members"), F.array(F.struct(F.lit("k").alias("k"), F.col("id").cast("string").alias("v"))).cast(TAGS).alias("tags"))
    ways = L.ways(spark, sf).select(F.lit("way").alias("kind"), "id", F.lit(1).alias("version"), none("double", "lat"), none("double", "lon"), "refs", none(MEMBERS.replace("long", "bigint"), "members"), F.array().cast(TAGS).alias("tags"))
    return nodes.union(ways)


def _with_relations(spark, sf):
    """The elements with relations, their members and tags."""
    own = L.members(spark, sf).groupBy(F.col("rel_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("type", "ref", "role"))).alias("members"))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    rels = L.relations(spark, sf).join(own, "id").select(F.lit("relation").alias("kind"), "id", F.lit(1).alias("version"), none("double", "lat"), none("double", "lon"), none("array<bigint>", "refs"), F.col("members").cast(MEMBERS.replace("long", "bigint")), F.col("tags").cast(TAGS))
    return _elements(spark, sf).unionByName(rels)


def told(path: str, rows) -> pd.DataFrame:
    """What a tile file holds of each kind: a row passes and is forgotten."""
    sums = {}
    for r in rows:
        if r[0] != "bounds":
            s = sums.setdefault(r[0], [0, 0, 0, 0])
            s[0] += 1
            s[1] += r[1]
            s[2] += sum(r[5] or ()) + sum(m[1] for m in r[6] or ())
            s[3] += len(r[7])
    map_id = int(path.rpartition("/")[2][:8])
    return pd.DataFrame([(map_id, k, *s) for k, s in sums.items()], columns=["map_id", "kind", "n", "id_sum", "ref_sum", "n_tags"])


def tile_names(spark, folder: str) -> DataFrame:
    """path: the files of a folder, a task for each, which opens it itself and reads on as rows are counted; so small a table would become one task."""
    names = spark.read.format("binaryFile").load(folder).select("path")
    return names.repartitionByRange(max(names.count(), 1), "path")


def _round_trip(form: str):
    def run(spark, sf):
        f, folder = Q.Flow(spark, sf), f"{shared_folder(spark)}/tiles"
        one = lambda kind, sets, name: f.known.arrays(sets, name).select(F.lit(kind).alias("kind"), F.col(name).alias("id"), "areas")
        sets = [("node", f.nodes, "node_id"), ("way", f.ways, "way_id"), ("relation", f.rels, "rel_id")]  # the last steps enter sets in the dictionary, too
        tiles = reduce(DataFrame.union, [one(*x) for x in sets])
        tilewriter.save_tiles(_with_relations(spark, sf), tiles, L.areas(spark), folder, form)

        def back(batches):
            for pdf in batches:
                for path in pdf["path"]:
                    yield told(path, maps.file_rows(path))

        return tile_names(spark, folder).mapInPandas(back, "map_id int, kind string, n long, id_sum long, ref_sum long, n_tags long")

    return run


_TOLD = Q._with("""
n_tags AS (
  SELECT id, CASE seg WHEN 'BUILDING' THEN 2 WHEN 'HOUSEHOLD' THEN 3 WHEN 'AUTOMOBILE' THEN 3 ELSE 1 END AS t FROM kinds
  UNION ALL SELECT n_nationkey + 2000000, 2 FROM nation UNION ALL SELECT r_regionkey + 3000000, 2 FROM region)""", """
SELECT CAST(63240001 + area_idx AS INTEGER) AS map_id, 'node' AS kind, count(*) AS n, CAST(sum(node_id) AS BIGINT) AS id_sum, CAST(0 AS BIGINT) AS ref_sum, count(*) AS n_tags FROM node_pairs GROUP BY area_idx
UNION ALL
SELECT CAST(63240001 + area_idx AS INTEGER), 'way', count(*), CAST(sum(way_id) AS BIGINT), CAST(sum(r.s) AS BIGINT), CAST(0 AS BIGINT) FROM way_pairs JOIN (SELECT way_id, sum(node_id) AS s FROM refs GROUP BY way_id) r USING (way_id) GROUP BY area_idx
UNION ALL
SELECT CAST(63240001 + area_idx AS INTEGER), 'relation', count(*), CAST(sum(rel_id) AS BIGINT), CAST(sum(r.s) AS BIGINT), CAST(sum(t) AS BIGINT) FROM rel_pairs JOIN (SELECT rel_id, sum(ref) AS s FROM members GROUP BY rel_id) r USING (rel_id) JOIN n_tags ON rel_id = id GROUP BY area_idx""")
for _form in ("pbf", "o5m", "xml"):
    QUERIES[f"tile_files_{_form}"] = _round_trip(_form)
    ORACLES[f"tile_files_{_form}"] = _TOLD
