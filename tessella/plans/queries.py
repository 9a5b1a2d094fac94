"""Map-data queries over the lens, with their SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import tags as G
from tessella.functions import units as U
from tessella.operators import assign as A
from tessella.operators import complete as C
from tessella.operators import density as D
from tessella.operators import idsets as I
from tessella.operators import problems as P
from tessella.operators import rangejoin as R
from tessella.operators.areasets import AreaSets, areas_of
from tessella.operators.bounded import cut
from tessella.plans import lens as L
from tessella.plans.lens import sql
from tessella.plans.registry import query


def _text(df: DataFrame) -> DataFrame:
    """Sets as comma-joined text, which both engines hash alike."""
    return df.withColumn("areas", F.array_join("areas", ","))


def _sets(key: str, pairs: str, where: str = "", having: str = "") -> str:
    return sql(f"SELECT {key}, array_to_string(list_sort(list(DISTINCT area_idx)), ',') AS areas FROM {pairs} {where} GROUP BY {key} {having}")


# coordinates


@query("map_units", sql("SELECT id, map_lat, map_lon FROM nodes"))
def map_units(spark, sf):
    return L.nodes(spark, sf)


@query("degrees", sql("SELECT id, round(CAST(map_lat AS DOUBLE) * 360 / 16777216, 9) AS lat FROM nodes"))
def degrees(spark, sf):
    return L.nodes(spark, sf).select("id", F.round(U.to_degrees(F.col("map_lat")), 9).alias("lat"))


@query("rounding", sql("SELECT id, (map_lat >> 11) * 2048 AS down11, ((map_lat + 2047) >> 11) * 2048 AS up11, ((map_lat + 2) >> 2) * 4 AS near2 FROM nodes"))
def rounding(spark, sf):
    v = F.col("map_lat")
    return L.nodes(spark, sf).select("id", U.round_down(v, 11).alias("down11"), U.round_up(v, 11).alias("up11"), U.round_near(v, 2).alias("near2"))


@query("round_area", sql("SELECT area_idx, (greatest(min_lat, -3961287) >> 11) * 2048 AS min_lat, greatest((min_lon >> 11) * 2048, -8388608) AS min_lon, ((least(max_lat, 3961287) + 2047) >> 11) * 2048 AS max_lat, least(((max_lon + 2047) >> 11) * 2048, 8388608) AS max_lon FROM shifted"))
def round_area(spark, sf):
    return L.shifted_areas(spark).select("area_idx", *[v.alias(k) for k, v in U.round_rect(U.rect(), 11).items()])


@query("verify_areas", sql("SELECT area_idx, min_lat >= -4194304 AND max_lat <= 4194304 AND min_lon >= -8388608 AND max_lon <= 8388608 AS ok FROM shifted"))
def verify_areas(spark, sf):
    return L.shifted_areas(spark).select("area_idx", U.verify(U.rect()).alias("ok"))


@query("extended_bounds", sql("SELECT area_idx, min_lat - 2000 AS min_lat, min_lon - 2000 AS min_lon, max_lat + 2000 AS max_lat, max_lon + 2000 AS max_lon FROM areas"))
def extended_bounds(spark, sf):
    return L.areas(spark).select("area_idx", *[v.alias(k) for k, v in U.grown(U.rect(), 2000).items()])


@query("area_relations", sql("""
SELECT a.area_idx AS a, b.area_idx AS b, a.min_lat < b.max_lat AND a.max_lat > b.min_lat AND a.min_lon < b.max_lon AND a.max_lon > b.min_lon AS overlap,
  greatest(a.min_lat, b.min_lat) AS min_lat, greatest(a.min_lon, b.min_lon) AS min_lon, least(a.max_lat, b.max_lat) AS max_lat, least(a.max_lon, b.max_lon) AS max_lon,
  least(a.min_lat, b.min_lat) AS bottom, greatest(a.max_lon, b.max_lon) AS right_
FROM areas a JOIN shifted b ON a.min_lat <= b.max_lat AND a.max_lat >= b.min_lat AND a.min_lon <= b.max_lon AND a.max_lon >= b.min_lon"""))
def area_relations(spark, sf):
    a = L.areas(spark).select(F.col("area_idx").alias("a"), *[v.alias("a_" + k) for k, v in U.rect().items()])
    b = L.shifted_areas(spark).select(F.col("area_idx").alias("b"), *[v.alias("b_" + k) for k, v in U.rect().items()])
    x, y = U.rect("a_"), U.rect("b_")
    both = F.broadcast(a).join(b, U.touches(x, y))  # 48 rows each
    return both.select("a", "b", U.overlaps(x, y).alias("overlap"), *[v.alias(k) for k, v in U.intersection(x, y).items()], U.union(x, y)["min_lat"].alias("bottom"), U.union(x, y)["max_lon"].alias("right_"))


@query("aspect_ratio", sql("""
SELECT area_idx, round((max_lon - min_lon) * (CASE WHEN min_lat < 0 AND max_lat > 0 THEN 1.0 ELSE greatest(cos(radians(min_lat * 360.0::DOUBLE / 16777216)), cos(radians(max_lat * 360.0::DOUBLE / 16777216))) END) / (max_lat - min_lat), 6) AS ratio FROM areas"""))
def aspect_ratio(spark, sf):
    return L.areas(spark).select("area_idx", F.round(U.aspect_ratio(*(F.col(k) for k in ("min_lat", "max_lat", "min_lon", "max_lon"))), 6).alias("ratio"))


@query("map_ids", sql("SELECT area_idx, lpad(CAST(63240001 + area_idx AS VARCHAR), 8, '0') AS file_id FROM areas"))
def map_ids(spark, sf):
    return L.areas(spark).select("area_idx", G.padded_id(F.col("map_id")).alias("file_id"))


# density

DENSITY = "SELECT (map_lon + 8388608) >> 11 AS x, (map_lat + 3962880) >> 11 AS y, count(*) AS n FROM {} GROUP BY ALL"
COLUMN_SUMS = "d AS (" + DENSITY.format("clustered") + "), c AS (SELECT x, CAST(sum(n) AS BIGINT) AS n FROM d GROUP BY x), r AS (SELECT x, n, sum(n) OVER (ORDER BY x) AS upto, (SELECT sum(n) FROM c) AS total FROM c)"


def _with(extra: str, select: str) -> str:
    return f"WITH {L.CTE}, {extra}\n{select}"


def _cells(spark, sf):
    return D.density(L.clustered_nodes(spark, sf))


def _columns(spark, sf):
    return D.line_sums(_cells(spark, sf), "x")


@query("density", sql(DENSITY.format("nodes")))
def density(spark, sf):
    return D.density(L.nodes(spark, sf))


@query("density_clustered", sql(DENSITY.format("clustered")))
def density_clustered(spark, sf):
    return _cells(spark, sf)


@query("bbox", sql("SELECT min(map_lat) AS min_lat, min(map_lon) AS min_lon, max(map_lat) AS max_lat, max(map_lon) AS max_lon FROM clustered"))
def bbox(spark, sf):
    return D.bbox(L.clustered_nodes(spark, sf))


@query("union_bounds", sql("SELECT min(min_lat) AS min_lat, min(min_lon) AS min_lon, max(max_lat) AS max_lat, max(max_lon) AS max_lon FROM shifted"))
def union_bounds(spark, sf):
    return D.union_bounds(L.shifted_areas(spark))


@query("density_subset", _with("d AS (" + DENSITY.format("clustered") + ")", "SELECT x - 4350 AS x, y - 2850 AS y, n FROM d WHERE x BETWEEN 4350 AND 4449 AND y BETWEEN 2850 AND 2949"))
def density_subset(spark, sf):
    return D.subset(_cells(spark, sf), 4350, 2850, 100, 100)


@query("row_col_sums", _with("d AS (" + DENSITY.format("clustered") + ")", "SELECT 'x' AS axis, x AS line, CAST(sum(n) AS BIGINT) AS n FROM d GROUP BY x UNION ALL SELECT 'y', y, CAST(sum(n) AS BIGINT) FROM d GROUP BY y"))
def row_col_sums(spark, sf):
    d = _cells(spark, sf)
    one = lambda a: D.line_sums(d, a).select(F.lit(a).alias("axis"), F.col(a).alias("line"), "n")
    return one("x").union(one("y"))


@query("largest_cell", _with("d AS (" + DENSITY.format("clustered") + ")", "SELECT max(n) AS n, CAST(sum(n) AS BIGINT) AS total, CAST((sum(n) + 499) // 500 AS BIGINT) AS parts FROM d"))
def largest_cell(spark, sf):
    return _cells(spark, sf).agg(F.max("n").alias("n"), F.sum("n").alias("total")).withColumn("parts", D.min_parts(F.col("total"), 500))


@query("valid_split_range", _with(COLUMN_SUMS, "SELECT min(x) + 1 AS first, max(x) + 1 AS last FROM r WHERE upto >= 100 AND total - upto >= 100"))
def valid_split_range(spark, sf):
    return D.valid_split_range(_columns(spark, sf), "x", 100)


@query("weighted_median_split", _with(COLUMN_SUMS, "SELECT x + 1 AS split, CAST(upto AS BIGINT) AS below, CAST(total - upto AS BIGINT) AS above FROM r ORDER BY abs(2 * upto - total), x LIMIT 1"))
def weighted_median_split(spark, sf):
    return D.median_split(_columns(spark, sf), "x")


@query("first_above", _with(COLUMN_SUMS, "SELECT min(x) AS position FROM r WHERE upto > 300"))
def first_above(spark, sf):
    return D.first_above(_columns(spark, sf), "x", 300)


@query("empty_runs", _with("d AS (" + DENSITY.format("nodes") + "), g AS (SELECT x, lead(x) OVER (ORDER BY x) AS nxt FROM (SELECT DISTINCT x FROM d))", "SELECT x + 1 AS start, nxt - x - 1 AS length FROM g WHERE nxt > x + 1"))
def empty_runs(spark, sf):
    return D.empty_runs(D.line_sums(D.density(L.nodes(spark, sf)), "x"), "x")


@query("bisect_one_level", _with("d AS (" + DENSITY.format("clustered") + "), m AS (SELECT min(x) AS lo, max(x) + 1 AS hi, CAST(sum(n * x) // sum(n) AS BIGINT) AS mean FROM d), k AS (SELECT greatest(least(mean, hi - (hi - lo) // 5), lo + (hi - lo) // 5) AS mid FROM m), s AS (SELECT mid - mid % 2 AS mid FROM k)", "SELECT x >= mid AS upper, any_value(mid) AS split, CAST(sum(n) AS BIGINT) AS n FROM d, s GROUP BY 1"))
def bisect_one_level(spark, sf):
    """The weighted mean column, kept in the middle three fifths and made even, halves the map."""
    d = _cells(spark, sf)
    lo, hi = F.col("lo"), F.col("hi")
    m = d.agg(F.min("x").alias("lo"), (F.max("x") + 1).alias("hi"), F.floor(F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("mean"))
    fifth = F.floor((hi - lo) / 5)
    mid = m.select(F.greatest(F.least("mean", hi - fifth), lo + fifth).alias("mid")).select((F.col("mid") - F.col("mid") % 2).alias("mid"))
    both = d.join(F.broadcast(mid))  # one row
    return both.groupBy((F.col("x") >= F.col("mid")).alias("upper")).agg(F.first("mid").alias("split"), F.sum("n").alias("n"))


@query("sea_merge", _with("d AS (" + DENSITY.format("nodes") + "), e AS (" + DENSITY.format("clustered") + ")", "SELECT * FROM (SELECT x, y, CASE WHEN coalesce(d.n, 0) = 0 THEN 2 * e.n ELSE d.n END AS n FROM d FULL JOIN e USING (x, y)) WHERE n > 0"))
def sea_merge(spark, sf):
    return D.merge_sea(D.density(L.nodes(spark, sf)), _cells(spark, sf))


# assignment


@query("node_areas", sql("SELECT node_id, area_idx FROM node_pairs"))
def node_areas(spark, sf):
    return A.node_areas(L.nodes(spark, sf), L.areas(spark))


@query("node_areas_overlap", sql("SELECT id AS node_id, CAST(area_idx AS INTEGER) AS area_idx FROM nodes JOIN areas ON map_lat BETWEEN min_lat - 2000 AND max_lat + 2000 AND map_lon BETWEEN min_lon - 2000 AND max_lon + 2000"))
def node_areas_overlap(spark, sf):
    return A.node_areas(L.nodes(spark, sf), L.areas(spark), overlap=2000)


@query("node_area_counts", sql("SELECT area_idx, count(*) AS n FROM node_pairs GROUP BY area_idx"))
def node_area_counts(spark, sf):
    return A.node_areas(L.nodes(spark, sf), L.areas(spark)).groupBy("area_idx").agg(F.count("*").alias("n"))


class Flow:
    """From nodes to the sets of whole elements. A step is made when it is first asked for, cut where later steps read it again."""

    def __init__(self, spark, sf, areas: DataFrame | None = None) -> None:
        self.spark, self.sf, self.known = spark, sf, AreaSets(spark)
        self.areas = L.areas(spark) if areas is None else areas

    @cached_property
    def refs(self) -> DataFrame:
        return cut(L.way_refs(self.spark, self.sf))

    @cached_property
    def mem(self) -> DataFrame:
        return cut(L.members(self.spark, self.sf))

    @cached_property
    def nodes(self) -> DataFrame:
        return cut(self.known.united(A.node_areas(L.nodes(self.spark, self.sf), self.areas), "node_id"))

    @cached_property
    def ways(self) -> DataFrame:
        return cut(A.way_sets(self.known, L.way_nodes(self.spark, self.sf), self.nodes))  # places are not needed

    @cached_property
    def rels(self) -> DataFrame:
        return cut(A.relation_sets(self.known, self.mem, self.nodes, self.ways))

    @cached_property
    def problem_ways(self) -> DataFrame:
        return P.problem_ways(self.known, self.ways)

    @cached_property
    def problem_rels(self) -> DataFrame:
        return cut(P.problem_relations(self.known, L.relations(self.spark, self.sf), self.rels))

    @cached_property
    def needed_ways(self) -> DataFrame:
        return cut(C.needed_ways(self.problem_ways.select(F.col("id").alias("way_id")), self.mem, self.problem_rels.select(F.col("id").alias("rel_id"))))

    @cached_property
    def whole_ways(self) -> DataFrame:
        ends = self.refs.groupBy(F.col("way_id").alias("id")).agg(F.min_by("node_id", "pos").alias("first"), F.max_by("node_id", "pos").alias("last"), F.count("*").alias("n"))
        ways = ends.select("id", F.when(F.col("n") > 1, F.array("first", "last")).otherwise(F.array("first")).alias("refs"))  # both ends tell whether a way is closed
        return cut(C.whole_way_sets(self.known, ways, cut(C.way_points(self.refs, L.nodes(self.spark, self.sf))), self.areas))

    @cached_property
    def whole_rels(self) -> DataFrame:
        return cut(A.relation_sets(self.known, self.mem, self.nodes, self.whole_ways))

    @cached_property
    def trees(self) -> DataFrame:
        return cut(C.with_children(self.known, self.whole_rels, self.mem))

    @cached_property
    def passed_ways(self) -> DataFrame:
        return cut(C.passed_to_members(self.known, self.trees, self.mem, "way", self.whole_ways, "way_id"))

    @cached_property
    def passed_nodes(self) -> DataFrame:
        return cut(C.passed_to_nodes(self.known, self.passed_ways, self.refs, C.passed_to_members(self.known, self.trees, self.mem, "node", self.nodes, "node_id")))

    @cached_property
    def final_ways(self) -> DataFrame:
        over = self.passed_ways.join(self.problem_ways.select(F.col("id").alias("way_id")), "way_id", "left_semi")
        return A.preferred(self.ways, over, "way_id")

    def text(self, name: str, key: str) -> DataFrame:
        return _text(self.known.arrays(getattr(self, name), key))


@query("way_areas", _sets("way_id", "way_pairs"))
def way_areas(spark, sf):
    return Flow(spark, sf).text("ways", "way_id")


@query("relation_areas", _sets("rel_id", "rel_pairs"))
def relation_areas(spark, sf):
    return Flow(spark, sf).text("rels", "rel_id")


@query("set_sizes", sql("SELECT CAST(size AS INTEGER) AS n_areas, count(*) AS n_elements, count(DISTINCT areas) AS n_sets FROM (SELECT count(*) AS size, array_to_string(list_sort(list(area_idx)), ',') AS areas FROM way_pairs GROUP BY way_id) GROUP BY size"))
def set_sizes(spark, sf):
    f = Flow(spark, sf)
    return P.coverage(f.known, f.ways)


@query("area_set_ops", sql("""
SELECT way_id, array_to_string(list_sort(list_distinct(list_concat(a, [0, 9]))), ',') AS either, array_to_string(list_sort(list_filter(a, lambda v: v NOT IN (0, 9))), ',') AS rest, len(a) = 1 AS single
FROM (SELECT way_id, list(DISTINCT area_idx) AS a FROM way_pairs GROUP BY way_id)"""))
def area_set_ops(spark, sf):
    f, other = Flow(spark, sf), F.array(F.lit(0), F.lit(9))
    s = f.known.arrays(f.ways, "way_id")
    return s.select("way_id", F.array_join(U.area_set(F.array_union("areas", other)), ",").alias("either"), F.array_join(F.array_sort(F.array_except("areas", other)), ",").alias("rest"), (F.size("areas") == 1).alias("single"))


@query("area_overlaps", sql("SELECT CAST(a.area_idx AS INTEGER) AS a, CAST(b.area_idx AS INTEGER) AS b FROM (SELECT * FROM areas UNION ALL SELECT area_idx + 100, min_lat, min_lon, max_lat, max_lon FROM shifted) a JOIN (SELECT * FROM areas UNION ALL SELECT area_idx + 100, min_lat, min_lon, max_lat, max_lon FROM shifted) b ON a.area_idx < b.area_idx AND a.min_lat < b.max_lat AND a.max_lat > b.min_lat AND a.min_lon < b.max_lon AND a.max_lon > b.min_lon"))
def area_overlaps(spark, sf):
    both = L.areas(spark).drop("map_id").union(L.shifted_areas(spark).withColumn("area_idx", F.col("area_idx") + 100))
    return R.overlapping_areas(both)


QUARTERS = "q AS (SELECT area_idx * 4 + k AS area_idx, min_lat + (k // 2) * 470000 AS min_lat, min_lon + (k % 2) * 1000000 AS min_lon, min_lat + (k // 2) * 470000 + 470000 AS max_lat, min_lon + (k % 2) * 1000000 + 1000000 AS max_lon FROM areas, range(4) t(k))"


@query("distinct_to_real", _with(QUARTERS, "SELECT CAST(q.area_idx AS INTEGER) AS area_idx, array_to_string(list_sort(list(s.area_idx)), ',') AS areas FROM q JOIN shifted s ON s.min_lat <= q.min_lat AND s.min_lon <= q.min_lon AND s.max_lat >= q.max_lat AND s.max_lon >= q.max_lon GROUP BY q.area_idx"))
def distinct_to_real(spark, sf):
    k = F.col("k")
    low, left = F.col("min_lat") + F.floor(k / 2).cast("int") * 470_000, F.col("min_lon") + (k % 2).cast("int") * 1_000_000
    q = L.areas(spark).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3)))).select((F.col("area_idx") * 4 + k).alias("area_idx"), low.alias("min_lat"), left.alias("min_lon"), (low + 470_000).alias("max_lat"), (left + 1_000_000).alias("max_lon"))
    return _text(R.contained_in(q, L.shifted_areas(spark)))


# problem lists


@query("problem_ways", sql("SELECT 'way' AS kind, way_id AS id FROM problem_ways"))
def problem_ways(spark, sf):
    return Flow(spark, sf).problem_ways


@query("relation_filter", sql("SELECT id FROM wanted"))
def relation_filter(spark, sf):
    return L.relations(spark, sf).where(G.wanted_relation(F.col("tags"))).select("id")


@query("relation_filter_lists", sql("SELECT id FROM kinds WHERE seg IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') OR (seg = 'AUTOMOBILE' AND key % 2 = 0)"))
def relation_filter_lists(spark, sf):
    """Lists of wanted boundaries and routes."""
    return L.relations(spark, sf).where(G.wanted_relation(F.col("tags"), boundaries=["administrative"], routes=["bus"])).select("id")


@query("display_names", sql("SELECT id, CASE seg WHEN 'BUILDING' THEN name WHEN 'AUTOMOBILE' THEN name WHEN 'HOUSEHOLD' THEN '?' WHEN 'MACHINERY' THEN '?' ELSE 'postal_code=' || key END AS name FROM kinds"))
def display_names(spark, sf):
    return L.relations(spark, sf).where("id < 2000000").select("id", G.display_name(F.col("tags")).alias("name"))


@query("problem_relations", sql("SELECT 'rel' AS kind, rel_id AS id FROM problem_rels"))
def problem_relations(spark, sf):
    return Flow(spark, sf).problem_rels


@query("all_problems", sql("SELECT 'way' AS kind, way_id AS id FROM problem_ways UNION SELECT 'rel', rel_id FROM problem_rels"))
def all_problems(spark, sf):
    f = Flow(spark, sf)
    return P.all_problems(f.problem_ways, f.problem_rels)


@query("one_tile_relations", sql("SELECT p.rel_id, CAST(any_value(area_idx) AS VARCHAR) AS areas FROM rel_pairs p JOIN wanted ON rel_id = id GROUP BY p.rel_id HAVING count(*) = 1"))
def one_tile_relations(spark, sf):
    f = Flow(spark, sf)
    return _text(P.one_tile_relations(f.known, L.relations(spark, sf), f.rels, f.areas, f.areas))


# complete elements


@query("relation_closure", sql("SELECT rel_id, depth FROM (SELECT 3000000 AS rel_id, 0 AS depth UNION ALL SELECT ref, 1 FROM below WHERE rel_id = 3000000 UNION ALL SELECT b.ref, 2 FROM below a JOIN below b ON a.ref = b.rel_id WHERE a.rel_id = 3000000)"))
def relation_closure(spark, sf):
    return C.closure(L.members(spark, sf), spark.range(1).select(F.lit(3_000_000).cast("long").alias("rel_id")))


@query("descendants", sql("SELECT rel_id, ref AS below FROM reach"))
def descendants(spark, sf):
    return C.descendants(L.members(spark, sf))


# suppliers of a nation and of the same two hundred keys hold each other in a ring; customers hold the next one, up to 20 in
# a chain, whose last holds a supplier's ring; every one has a node of its own
RINGS = """
ring AS (SELECT s_suppkey + 5000000 AS rel_id, coalesce(lead(s_suppkey) OVER w, min(s_suppkey) OVER (PARTITION BY s_nationkey, s_suppkey // 200)) + 5000000 AS ref FROM supplier WINDOW w AS (PARTITION BY s_nationkey, s_suppkey // 200 ORDER BY s_suppkey)),
chain AS (
  SELECT c_custkey + 6000000 AS rel_id, c_custkey + 6000001 AS ref FROM customer WHERE c_custkey % 20 <> 19 AND c_custkey + 1 IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT c_custkey + 6000000, s_suppkey + 5000000 FROM customer JOIN supplier ON s_suppkey = c_custkey // 20 WHERE c_custkey % 20 = 19),
graph AS (SELECT * FROM ring UNION ALL SELECT * FROM chain)"""


def _graph(spark, sf) -> DataFrame:
    """rel_id, pos, type, ref, role: the rings and chains, and a node for each of their relations."""
    s = L.read(spark, sf, "supplier", "s_suppkey", "s_nationkey").withColumn("part", F.floor(F.col("s_suppkey") / 200))
    w = W.partitionBy("s_nationkey", "part")
    ring = s.select((F.col("s_suppkey") + 5_000_000).alias("rel_id"), (F.coalesce(F.lead("s_suppkey").over(w.orderBy("s_suppkey")), F.min("s_suppkey").over(w)) + 5_000_000).alias("ref"))
    c = L.read(spark, sf, "customer", "c_custkey")
    nxt = c.where("c_custkey % 20 <> 19").join(c.select((F.col("c_custkey") - 1).alias("c_custkey")), "c_custkey", "left_semi").select((F.col("c_custkey") + 6_000_000).alias("rel_id"), (F.col("c_custkey") + 6_000_001).alias("ref"))
    last = c.where("c_custkey % 20 = 19").join(s, F.floor(F.col("c_custkey") / 20) == F.col("s_suppkey")).select((F.col("c_custkey") + 6_000_000).alias("rel_id"), (F.col("s_suppkey") + 5_000_000).alias("ref"))
    of = lambda df, kind: df.select("rel_id", F.lit(kind).alias("type"), "ref", F.lit("").alias("role"))
    nodes = s.select((F.col("s_suppkey") + 5_000_000).alias("rel_id"), (F.col("s_suppkey") + 1).alias("ref")).union(c.select(F.col("c_custkey") + 6_000_000, F.col("c_custkey") + 1))
    return of(ring.union(nxt).union(last), "relation").union(of(nodes, "node"))


@query("relation_loops", _with(RINGS, "SELECT rel_id, 'duplicate' AS problem FROM (SELECT rel_id FROM members WHERE type = 'relation' GROUP BY rel_id, ref HAVING count(*) > 1) GROUP BY rel_id UNION ALL SELECT rel_id, 'loop' FROM ring"))
def relation_loops(spark, sf):
    return C.loops(L.members(spark, sf).unionByName(_graph(spark, sf)))


@query("chain_depths", _with(RINGS, "SELECT rel_id, CAST(min(depth) AS INTEGER) AS depth FROM (WITH RECURSIVE down AS (SELECT c_custkey + 6000000 AS rel_id, 0 AS depth FROM customer WHERE c_custkey % 20 = 0 UNION SELECT ref, depth + 1 FROM down JOIN graph USING (rel_id) WHERE depth < 60) SELECT * FROM down) GROUP BY rel_id"))
def chain_depths(spark, sf):
    """Every relation below the first of a chain, however deep; those on rings are met once."""
    start = L.read(spark, sf, "customer", "c_custkey").where("c_custkey % 20 = 0").select((F.col("c_custkey") + 6_000_000).alias("rel_id"))
    return C.closure(_graph(spark, sf), start)


@query("looped_rel_areas", _with(RINGS + """,
own AS (SELECT s_suppkey + 5000000 AS rel_id, area_idx FROM supplier JOIN node_pairs ON node_id = s_suppkey + 1 UNION SELECT c_custkey + 6000000, area_idx FROM customer JOIN node_pairs ON node_id = c_custkey + 1),
down AS (SELECT * FROM (WITH RECURSIVE r AS (SELECT rel_id AS top, rel_id FROM graph UNION SELECT top, ref FROM r JOIN graph USING (rel_id)) SELECT DISTINCT top, rel_id FROM r))""",
    "SELECT top AS rel_id, array_to_string(list_sort(list(DISTINCT area_idx)), ',') AS areas FROM (SELECT top, area_idx FROM down JOIN own USING (rel_id) UNION SELECT rel_id, area_idx FROM own) GROUP BY top"))
def looped_rel_areas(spark, sf):
    """Sets go up chains of 20 relations; those on a ring share theirs."""
    f, mem = Flow(spark, sf), cut(_graph(spark, sf))
    own = A.relation_sets(f.known, mem, f.nodes, spark.createDataFrame([], "way_id long, set_no long"))
    return _text(f.known.arrays(C.with_children(f.known, own, mem), "rel_id"))


NEEDED = "need AS (SELECT way_id FROM problem_ways UNION SELECT ref FROM members JOIN problem_rels USING (rel_id) WHERE type = 'way')"


@query("needed_ways", _with(NEEDED, "SELECT way_id FROM need"))
def needed_ways(spark, sf):
    return I.members(Flow(spark, sf).needed_ways, "way_id")


@query("needed_nodes", _with(NEEDED, "SELECT node_id FROM refs JOIN need USING (way_id) UNION SELECT ref FROM members JOIN problem_rels USING (rel_id) WHERE type = 'node'"))
def needed_nodes(spark, sf):
    f = Flow(spark, sf)
    return I.members(C.needed_nodes(f.refs, f.needed_ways, f.mem, f.problem_rels.select(F.col("id").alias("rel_id"))), "node_id")


@query("unneeded_relations", sql("SELECT DISTINCT rel_id FROM members WHERE rel_id NOT IN (SELECT rel_id FROM problem_rels)"))
def unneeded_relations(spark, sf):
    f = Flow(spark, sf)
    return f.mem.select("rel_id").distinct().join(f.problem_rels.select(F.col("id").alias("rel_id")), "rel_id", "left_anti")


def _points(spark, sf):
    return C.way_points(L.way_refs(spark, sf), L.nodes(spark, sf))


@query("closed_ways", sql("SELECT way_id FROM closed"))
def closed_ways(spark, sf):
    return L.ways(spark, sf).where(G.closed_way(F.col("refs"))).select(F.col("id").alias("way_id"))


@query("way_bbox", sql("SELECT * FROM boxes"))
def way_bbox(spark, sf):
    return C.way_boxes(_points(spark, sf))


@query("way_bbox_areas", sql("SELECT way_id, area_idx FROM box_pairs"))
def way_bbox_areas(spark, sf):
    return R.rect_near_rect(C.way_boxes(_points(spark, sf)), L.areas(spark)).select("way_id", "area_idx")


@query("way_segments", sql("SELECT * FROM segments"))
def way_segments(spark, sf):
    return C.way_segments(_points(spark, sf))


@query("segment_areas", sql("SELECT way_id, area_idx FROM segment_pairs"))
def segment_areas(spark, sf):
    return C.segment_sets(C.way_segments(_points(spark, sf)), L.areas(spark)).select("way_id", F.explode(areas_of(F.col("set_no"))).alias("area_idx"))


@query("multi_tile_ways", _sets("way_id", "whole_pairs"))
def multi_tile_ways(spark, sf):
    return Flow(spark, sf).text("whole_ways", "way_id")


@query("rel_member_areas", _sets("rel_id", "whole_rel_pairs"))
def rel_member_areas(spark, sf):
    return Flow(spark, sf).text("whole_rels", "rel_id")


@query("parent_rel_areas", _sets("rel_id", "tree_pairs"))
def parent_rel_areas(spark, sf):
    return Flow(spark, sf).text("trees", "rel_id")


@query("propagate_members", _sets("way_id", "passed_ways"))
def propagate_members(spark, sf):
    return Flow(spark, sf).text("passed_ways", "way_id")


@query("propagate_nodes", _sets("node_id", "passed_nodes"))
def propagate_nodes(spark, sf):
    return Flow(spark, sf).text("passed_nodes", "node_id")


@query("final_node_tiles", _sets("node_id", "(SELECT node_id, area_idx FROM node_pairs UNION SELECT node_id, area_idx FROM passed_nodes)"))
def final_node_tiles(spark, sf):
    f = Flow(spark, sf)
    return _text(f.known.arrays(A.merged(f.known, f.nodes, f.passed_nodes, "node_id"), "node_id"))


FINAL_WAYS = "over AS (SELECT * FROM passed_ways WHERE way_id IN (SELECT way_id FROM problem_ways)), f AS (SELECT * FROM over UNION ALL SELECT * FROM way_pairs WHERE way_id NOT IN (SELECT way_id FROM over))"


@query("final_way_tiles", _with(FINAL_WAYS, "SELECT way_id, array_to_string(list_sort(list(DISTINCT area_idx)), ',') AS areas FROM f GROUP BY way_id"))
def final_way_tiles(spark, sf):
    return Flow(spark, sf).text("final_ways", "way_id")


@query("final_rel_tiles", _with("one AS (SELECT rel_id FROM rel_pairs JOIN wanted ON rel_id = id GROUP BY rel_id HAVING count(*) = 1), over AS (SELECT * FROM tree_pairs WHERE rel_id IN (SELECT rel_id FROM problem_rels)), f AS (SELECT * FROM rel_pairs WHERE rel_id IN (SELECT rel_id FROM one) UNION ALL SELECT * FROM over WHERE rel_id NOT IN (SELECT rel_id FROM one) UNION ALL SELECT * FROM rel_pairs WHERE rel_id NOT IN (SELECT rel_id FROM one) AND rel_id NOT IN (SELECT rel_id FROM over))", "SELECT rel_id, array_to_string(list_sort(list(DISTINCT area_idx)), ',') AS areas FROM f GROUP BY rel_id"))
def final_rel_tiles(spark, sf):
    f = Flow(spark, sf)
    one = P.one_tile_relations(f.known, L.relations(spark, sf), f.rels, f.areas, f.areas)
    over = f.trees.join(f.problem_rels.select(F.col("id").alias("rel_id")), "rel_id", "left_semi")
    return _text(f.known.arrays(A.preferred(f.rels, over, "rel_id", f.known.numbered(one, "rel_id")), "rel_id"))


@query("tile_payload", _with(FINAL_WAYS, "SELECT area_idx, count(DISTINCT way_id) AS n_ways, CAST(sum(way_id) AS BIGINT) AS id_sum FROM (SELECT DISTINCT way_id, area_idx FROM f) GROUP BY area_idx"))
def tile_payload(spark, sf):
    """What is written to each tile: sets are taken apart where they lie and counted by a partial aggregate."""
    each = Flow(spark, sf).final_ways.select("way_id", F.explode(areas_of(F.col("set_no"))).alias("area_idx"))
    return each.groupBy("area_idx").agg(F.count("*").alias("n_ways"), F.sum("way_id").alias("id_sum"))


# names

CITIES = "c AS (SELECT CAST(id AS INTEGER) AS id, CAST(s_nationkey AS VARCHAR) AS country, s_name AS name, map_lat AS lat, map_lon AS lon, CAST(floor(abs(s_acctbal) / 1000) AS INTEGER) AS population FROM supplier JOIN nodes ON s_suppkey + 1 = id)"


@query("cities_in_areas", _with(CITIES, "SELECT c.id, area_idx FROM c JOIN areas ON lat BETWEEN min_lat AND max_lat AND lon BETWEEN min_lon AND max_lon"))
def cities_in_areas(spark, sf):
    return R.cities_in_areas(L.cities(spark, sf), L.areas(spark)).select("id", "area_idx")


@query("best_city", _with(CITIES, "SELECT CAST(area_idx AS INTEGER) AS area_idx, id, country, name, population FROM c JOIN areas ON lat BETWEEN min_lat AND max_lat AND lon BETWEEN min_lon AND max_lon QUALIFY row_number() OVER (PARTITION BY area_idx ORDER BY population DESC, id) = 1"))
def best_city(spark, sf):
    return R.best_city(L.cities(spark, sf), L.areas(spark))
