"""Map entities derived from the star-schema tables by integer arithmetic, as DataFrames and as the same SQL.

part -> nodes, orders and lineitem -> ways, customer, nation and region -> three levels of relations, events -> a second,
clustered node set; areas are a fixed grid whose neighbours share their borders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.units import to_map_unit

ROWS, COLUMNS = 6, 8
LAT0, LON0, HEIGHT, WIDTH = -2_800_000, -8_000_000, 940_000, 2_000_000


def read(spark: SparkSession, sf: str, table: str, *columns: str) -> DataFrame:
    """Only the columns named reach the scan."""
    return spark.read.parquet(f"{sf}/{table}.parquet").select(*columns)


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    lat = F.lit(-60.0) + ((k * 7919) % 120000) / F.lit(1000.0)
    lon = F.lit(-170.0) + ((k * 104729) % 340000) / F.lit(1000.0)
    return read(spark, sf, "part", "p_partkey").select((k + 1).alias("id"), to_map_unit(lat).alias("map_lat"), to_map_unit(lon).alias("map_lon"))


def clustered_nodes(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    u = (i * 7919) % 1000
    v = (F.floor(i / 1000) * 613 + F.col("user_id") * 37 + i * 29) % 1000
    lat, lon = F.lit(40.0) + (u * u) / F.lit(100000.0), F.lit(5.0) + (v * v) / F.lit(100000.0)
    return read(spark, sf, "events", "event_id", "user_id").select((i + 1).alias("id"), to_map_unit(lat).alias("map_lat"), to_map_unit(lon).alias("map_lon"))


def way_refs(spark: SparkSession, sf: str) -> DataFrame:
    """way_id, pos, node_id; every fifth way is closed."""
    lines = read(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    own = lines.select((F.col("l_orderkey") + 1).alias("way_id"), (F.row_number().over(w) - 1).alias("pos"), (F.col("l_partkey") + 1).alias("node_id"))
    ends = own.where("(way_id - 1) % 5 = 0").groupBy("way_id").agg(F.count("*").cast("int").alias("pos"), F.min_by("node_id", "pos").alias("node_id"))
    return own.unionByName(ends)


def way_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """way_id, node_id, in no order: for what is united by way, where neither places nor the first node's return at the end of a closed way matter."""
    return read(spark, sf, "lineitem", "l_orderkey", "l_partkey").select((F.col("l_orderkey") + 1).alias("way_id"), (F.col("l_partkey") + 1).alias("node_id"))


def ways(spark: SparkSession, sf: str) -> DataFrame:
    """id and refs in order."""
    order = F.array_sort(F.collect_list(F.struct("pos", "node_id")))
    return way_refs(spark, sf).groupBy(F.col("way_id").alias("id")).agg(F.transform(order, lambda x: x["node_id"]).alias("refs"))


def members(spark: SparkSession, sf: str) -> DataFrame:
    """rel_id, pos, type, ref, role: customers of ways, nations of customers and suppliers' nodes, regions of nations."""
    role = F.when(F.col("o_orderpriority") == "5-LOW", "inner").otherwise("outer")
    orders = read(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderpriority").select((F.col("o_custkey") + 1_000_000).alias("rel_id"), F.lit("way").alias("type"), (F.col("o_orderkey") + 1).alias("ref"), role.alias("role"))
    customers = read(spark, sf, "customer", "c_custkey", "c_nationkey").select((F.col("c_nationkey") + F.lit(2_000_000).cast("long")).alias("rel_id"), F.lit("relation").alias("type"), (F.col("c_custkey") + 1_000_000).alias("ref"), F.lit("").alias("role"))
    suppliers = read(spark, sf, "supplier", "s_suppkey", "s_nationkey").select((F.col("s_nationkey") + F.lit(2_000_000).cast("long")).alias("rel_id"), F.lit("node").alias("type"), (F.col("s_suppkey") + 1).alias("ref"), F.lit("").alias("role"))
    nations = read(spark, sf, "nation", "n_nationkey", "n_regionkey").select((F.col("n_regionkey") + F.lit(3_000_000).cast("long")).alias("rel_id"), F.lit("relation").alias("type"), (F.col("n_nationkey") + F.lit(2_000_000).cast("long")).alias("ref"), F.lit("").alias("role"))
    return orders.union(customers).union(suppliers).union(nations)


def relations(spark: SparkSession, sf: str) -> DataFrame:
    """id and tags of all relations."""
    tag = lambda k, v: F.struct(F.lit(k).alias("k"), v.cast("string").alias("v"))
    seg, key = F.col("c_mktsegment"), F.col("c_custkey")
    tags = (
        F.when(seg == "BUILDING", F.array(tag("type", F.lit("multipolygon")), tag("name", F.col("c_name"))))
        .when(seg == "HOUSEHOLD", F.array(tag("type", F.lit("boundary")), tag("boundary", F.lit("administrative")), tag("admin_level", key % 12)))
        .when(seg == "MACHINERY", F.array(tag("type", F.lit("restriction"))))
        .when(seg == "AUTOMOBILE", F.array(tag("type", F.lit("route")), tag("route", F.when(key % 2 == 0, "bus").otherwise("road")), tag("short_name", F.col("c_name"))))
        .otherwise(F.array(tag("postal_code", key)))
    )
    own = read(spark, sf, "customer", "c_custkey", "c_name", "c_mktsegment").select((key + 1_000_000).alias("id"), tags.alias("tags"))
    upper = lambda table, k, base: read(spark, sf, table, k).select((F.col(k) + F.lit(base).cast("long")).alias("id"), F.array(tag("type", F.lit("boundary")), tag("boundary", F.lit("political"))).alias("tags"))
    return own.union(upper("nation", "n_nationkey", 2_000_000)).union(upper("region", "r_regionkey", 3_000_000))


def areas(spark: SparkSession, *_) -> DataFrame:
    i = F.col("id")
    y, x = F.floor(i / COLUMNS), i % COLUMNS
    low, left = y * HEIGHT + LAT0, x * WIDTH + LON0
    return spark.range(ROWS * COLUMNS).select(i.cast("int").alias("area_idx"), (i + 63240001).cast("int").alias("map_id"), low.cast("int").alias("min_lat"), left.cast("int").alias("min_lon"), (low + HEIGHT).cast("int").alias("max_lat"), (left + WIDTH).cast("int").alias("max_lon"))


def shifted_areas(spark: SparkSession, *_) -> DataFrame:
    """The grid moved by half a tile: overlaps the first."""
    a = areas(spark)
    return a.select("area_idx", (F.col("min_lat") - HEIGHT // 2).alias("min_lat"), (F.col("min_lon") - WIDTH // 2).alias("min_lon"), (F.col("max_lat") - HEIGHT // 2).alias("max_lat"), (F.col("max_lon") - WIDTH // 2).alias("max_lon"))


def area_list() -> list[tuple[int, int, int, int]]:
    return [(LAT0 + y * HEIGHT, LON0 + x * WIDTH, LAT0 + (y + 1) * HEIGHT, LON0 + (x + 1) * WIDTH) for y in range(ROWS) for x in range(COLUMNS)]


def cities(spark: SparkSession, sf: str) -> DataFrame:
    """A city for each supplier's node, peopled by its account."""
    s = read(spark, sf, "supplier", "s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    n = nodes(spark, sf)
    people = F.floor(F.abs(F.col("s_acctbal")) / 1000).cast("int")
    return s.join(n, s["s_suppkey"] + 1 == n["id"]).select(F.col("id").cast("int").alias("id"), F.col("s_nationkey").cast("string").alias("country"), F.col("s_name").alias("name"), F.col("map_lat").alias("lat"), F.col("map_lon").alias("lon"), people.alias("population"))


_UNIT = "CAST(trunc((CASE WHEN {0} > 0 THEN {0} + CAST(0.0000107288360595703125 AS DOUBLE) ELSE {0} - CAST(0.0000107288360595703125 AS DOUBLE) END) * CAST(16777216 AS DOUBLE) / CAST(360 AS DOUBLE)) AS INTEGER)"
_ONE_K, _BIG = "CAST(1000 AS DOUBLE)", "CAST(100000 AS DOUBLE)"
CTE = f"""
nodes AS MATERIALIZED (
  SELECT id, {_UNIT.format("lat")} AS map_lat, {_UNIT.format("lon")} AS map_lon FROM (
    SELECT p_partkey + 1 AS id, CAST(-60 AS DOUBLE) + ((p_partkey * 7919) % 120000) / {_ONE_K} AS lat, CAST(-170 AS DOUBLE) + ((p_partkey * 104729) % 340000) / {_ONE_K} AS lon FROM part)),
clustered AS MATERIALIZED (
  SELECT id, {_UNIT.format("lat")} AS map_lat, {_UNIT.format("lon")} AS map_lon FROM (
    SELECT id, CAST(40 AS DOUBLE) + (u * u) / {_BIG} AS lat, CAST(5 AS DOUBLE) + (v * v) / {_BIG} AS lon FROM (
      SELECT event_id + 1 AS id, (event_id * 7919) % 1000 AS u, ((event_id // 1000) * 613 + user_id * 37 + event_id * 29) % 1000 AS v FROM events))),
refs0 AS (
  SELECT l_orderkey + 1 AS way_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS INTEGER) AS pos, l_partkey + 1 AS node_id FROM lineitem),
refs AS MATERIALIZED (
  SELECT way_id, pos, node_id FROM refs0
  UNION ALL
  SELECT way_id, CAST(count(*) AS INTEGER), arg_min(node_id, pos) FROM refs0 WHERE (way_id - 1) % 5 = 0 GROUP BY way_id),
ways AS (SELECT way_id AS id, list(node_id ORDER BY pos) AS refs FROM refs GROUP BY way_id),
members AS MATERIALIZED (
  SELECT o_custkey + 1000000 AS rel_id, 'way' AS type, o_orderkey + 1 AS ref, CASE WHEN o_orderpriority = '5-LOW' THEN 'inner' ELSE 'outer' END AS role FROM orders
  UNION ALL SELECT c_nationkey + 2000000, 'relation', c_custkey + 1000000, '' FROM customer
  UNION ALL SELECT s_nationkey + 2000000, 'node', s_suppkey + 1, '' FROM supplier
  UNION ALL SELECT n_regionkey + 3000000, 'relation', n_nationkey + 2000000, '' FROM nation),
kinds AS (
  SELECT c_custkey + 1000000 AS id, c_name AS name, c_custkey AS key, c_mktsegment AS seg,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'multipolygon' WHEN 'HOUSEHOLD' THEN 'boundary' WHEN 'MACHINERY' THEN 'restriction' WHEN 'AUTOMOBILE' THEN 'route' END AS type FROM customer),
wanted AS (
  SELECT id FROM kinds WHERE seg IN ('BUILDING', 'MACHINERY') OR (seg = 'HOUSEHOLD' AND key % 12 BETWEEN 5 AND 11)),
areas AS (
  SELECT CAST(y * {COLUMNS} + x AS INTEGER) AS area_idx, CAST({LAT0} + y * {HEIGHT} AS INTEGER) AS min_lat, CAST({LON0} + x * {WIDTH} AS INTEGER) AS min_lon, CAST({LAT0} + (y + 1) * {HEIGHT} AS INTEGER) AS max_lat, CAST({LON0} + (x + 1) * {WIDTH} AS INTEGER) AS max_lon
  FROM range({ROWS}) a(y), range({COLUMNS}) b(x)),
shifted AS (
  SELECT area_idx, min_lat - {HEIGHT // 2} AS min_lat, min_lon - {WIDTH // 2} AS min_lon, max_lat - {HEIGHT // 2} AS max_lat, max_lon - {WIDTH // 2} AS max_lon FROM areas),
node_pairs AS MATERIALIZED (
  SELECT id AS node_id, CAST(area_idx AS INTEGER) AS area_idx FROM nodes JOIN areas ON map_lat BETWEEN min_lat AND max_lat AND map_lon BETWEEN min_lon AND max_lon),
way_pairs AS MATERIALIZED (SELECT DISTINCT way_id, area_idx FROM refs JOIN node_pairs USING (node_id)),
rel_pairs AS MATERIALIZED (
  SELECT DISTINCT rel_id, area_idx FROM members JOIN node_pairs ON type = 'node' AND ref = node_id
  UNION SELECT DISTINCT rel_id, area_idx FROM members JOIN way_pairs ON type = 'way' AND ref = way_id),
problem_ways AS (SELECT way_id FROM way_pairs GROUP BY way_id HAVING count(*) > 1),
problem_rels AS (SELECT rel_id FROM rel_pairs JOIN wanted ON rel_id = id GROUP BY rel_id HAVING count(*) > 1),
points AS MATERIALIZED (SELECT way_id, pos, node_id, map_lat, map_lon FROM refs JOIN nodes ON id = node_id),
boxes AS (
  SELECT way_id, min(map_lat) AS box_min_lat, min(map_lon) AS box_min_lon,
    CASE WHEN min(map_lat) = max(map_lat) THEN max(map_lat) + 1 ELSE max(map_lat) END AS box_max_lat, CASE WHEN min(map_lon) = max(map_lon) THEN max(map_lon) + 1 ELSE max(map_lon) END AS box_max_lon
  FROM points GROUP BY way_id),
segments AS MATERIALIZED (
  SELECT * FROM (SELECT way_id, pos, map_lat AS lat1, map_lon AS lon1, lead(map_lat) OVER w AS lat2, lead(map_lon) OVER w AS lon2 FROM points WINDOW w AS (PARTITION BY way_id ORDER BY pos)) WHERE lat2 IS NOT NULL),
closed AS (SELECT id AS way_id FROM ways WHERE len(refs) > 1 AND refs[1] = refs[len(refs)]),
box_pairs AS (
  SELECT way_id, CAST(area_idx AS INTEGER) AS area_idx FROM boxes JOIN areas ON box_min_lat < max_lat + 1 AND box_max_lat > min_lat - 1 AND box_min_lon < max_lon + 1 AND box_max_lon > min_lon - 1),
segment_pairs AS MATERIALIZED (
  SELECT DISTINCT way_id, CAST(area_idx AS INTEGER) AS area_idx FROM (
    SELECT *, (lon2 - lon1) * (b - lat1) - (lat2 - lat1) * (l - lon1) AS s1, (lon2 - lon1) * (b - lat1) - (lat2 - lat1) * (r - lon1) AS s2,
      (lon2 - lon1) * (t - lat1) - (lat2 - lat1) * (l - lon1) AS s3, (lon2 - lon1) * (t - lat1) - (lat2 - lat1) * (r - lon1) AS s4
    FROM (SELECT way_id, CAST(lat1 AS BIGINT) AS lat1, CAST(lon1 AS BIGINT) AS lon1, CAST(lat2 AS BIGINT) AS lat2, CAST(lon2 AS BIGINT) AS lon2 FROM segments)
    JOIN (SELECT area_idx, min_lat - 1 AS b, max_lat + 1 AS t, min_lon - 1 AS l, max_lon + 1 AS r FROM areas)
      ON least(lat1, lat2) <= t AND greatest(lat1, lat2) >= b AND least(lon1, lon2) <= r AND greatest(lon1, lon2) >= l)
  WHERE NOT (least(s1, s2, s3, s4) > 0 OR greatest(s1, s2, s3, s4) < 0)),
open_nodes AS (SELECT p.way_id, p.pos, a.area_idx FROM points p LEFT JOIN node_pairs a USING (node_id) WHERE p.way_id NOT IN (SELECT way_id FROM closed)),
crossing AS (SELECT way_id FROM open_nodes GROUP BY way_id HAVING count(*) FILTER (WHERE area_idx IS NULL) > 0 OR count(DISTINCT area_idx) <> 1),
whole_pairs AS MATERIALIZED (
  SELECT way_id, area_idx FROM box_pairs WHERE way_id IN (SELECT way_id FROM closed)
  UNION SELECT way_id, area_idx FROM open_nodes WHERE area_idx IS NOT NULL
  UNION SELECT way_id, area_idx FROM segment_pairs WHERE way_id IN (SELECT way_id FROM crossing)),
whole_rel_pairs AS MATERIALIZED (
  SELECT DISTINCT rel_id, area_idx FROM members JOIN node_pairs ON type = 'node' AND ref = node_id
  UNION SELECT DISTINCT rel_id, area_idx FROM members JOIN whole_pairs ON type = 'way' AND ref = way_id),
below AS (SELECT DISTINCT rel_id, ref FROM members WHERE type = 'relation'),
reach AS (
  SELECT rel_id, ref FROM below UNION SELECT a.rel_id, b.ref FROM below a JOIN below b ON a.ref = b.rel_id),
tree_pairs AS MATERIALIZED (
  SELECT rel_id, area_idx FROM whole_rel_pairs UNION SELECT reach.rel_id, area_idx FROM reach JOIN whole_rel_pairs p ON reach.ref = p.rel_id),
passed_ways AS MATERIALIZED (
  SELECT way_id, area_idx FROM whole_pairs UNION SELECT ref, area_idx FROM members JOIN tree_pairs USING (rel_id) WHERE type = 'way'),
passed_nodes AS MATERIALIZED (
  SELECT node_id, area_idx FROM node_pairs UNION SELECT ref, area_idx FROM members JOIN tree_pairs USING (rel_id) WHERE type = 'node'
  UNION SELECT node_id, area_idx FROM refs JOIN passed_ways USING (way_id))
"""


def sql(select: str) -> str:
    """The select over the tables above."""
    return f"WITH {CTE}\n{select}"
