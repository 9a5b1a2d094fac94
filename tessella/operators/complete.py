"""Keeping elements complete: closure over relations, areas of whole ways and rings, and sets passed on to members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import units as U
from tessella.functions.tags import closed_way, get_tag
from tessella.operators import graph as G
from tessella.operators import idsets as I
from tessella.operators.areasets import AreaSets, union
from tessella.operators.bounded import cut, hinted
from tessella.operators.rangejoin import point_in_rect, rect_near_rect, segments_near_rect

def _below(mem: DataFrame) -> DataFrame:
    return mem.where("type = 'relation'").select("rel_id", F.col("ref").alias("below")).distinct()


def closure(mem: DataFrame, start: DataFrame) -> DataFrame:
    """rel_id, depth: the start relations and all relations below them, each at its least depth, however deep.

    A frontier goes down level by level; what was met before is left out, so loops end. mem: rel_id, type, ref.
    """
    below = cut(_below(mem))
    front = met = cut(start.select("rel_id").distinct().withColumn("depth", F.lit(0)))
    depth = 0
    while not front.isEmpty():
        depth += 1
        nxt = front.select("rel_id").join(below, "rel_id").select(F.col("below").alias("rel_id")).distinct()
        front = cut(nxt.join(met, "rel_id", "left_anti").withColumn("depth", F.lit(depth)))
        met = cut(met.unionByName(front))
    return met


def descendants(mem: DataFrame) -> DataFrame:
    """rel_id, below: every pair of a relation and one that it reaches. All pairs: a report, not a step on the way to tiles."""
    edge = met = front = cut(_below(mem))
    while not front.isEmpty():
        nxt = front.join(edge.select(F.col("rel_id").alias("below"), F.col("below").alias("next")), "below").select("rel_id", F.col("next").alias("below")).distinct()
        front = cut(nxt.join(met, ["rel_id", "below"], "left_anti"))
        met = cut(met.unionByName(front))
    return met


def loops(mem: DataFrame) -> DataFrame:
    """Relations on a loop of member relations, and those that name a member relation more than once."""
    rings = G.strong_components(_below(mem).select(F.col("rel_id").alias("a"), F.col("below").alias("b"))).select(F.col("v").alias("rel_id"), F.lit("loop").alias("problem"))
    twice = mem.where("type = 'relation'").groupBy("rel_id", "ref").count().where("count > 1").select("rel_id", F.lit("duplicate").alias("problem")).distinct()
    return rings.unionByName(twice)


def needed_ways(problem_way_ids: DataFrame, mem: DataFrame, rels: DataFrame) -> DataFrame:
    """Id set of the problem ways and the way members of the relations."""
    own = mem.where("type = 'way'").join(hinted(rels), "rel_id", "left_semi").select(F.col("ref").alias("way_id"))
    return I.id_set(problem_way_ids.select("way_id").union(own), "way_id")


def needed_nodes(refs: DataFrame, ways: DataFrame, mem: DataFrame, rels: DataFrame) -> DataFrame:
    """Id set of the nodes of the needed ways (an id set) and the node members of the relations."""
    of_ways = I.within(refs, "way_id", ways).select("node_id")
    own = mem.where("type = 'node'").join(hinted(rels), "rel_id", "left_semi").select(F.col("ref").alias("node_id"))
    return I.id_set(of_ways.union(own), "node_id")


def way_points(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """way_id, pos, node_id, map_lat, map_lon of the nodes that are known."""
    return refs.join(nodes.select(F.col("id").alias("node_id"), "map_lat", "map_lon"), "node_id").select("way_id", "pos", "node_id", "map_lat", "map_lon")


def way_boxes(points: DataFrame) -> DataFrame:
    """way_id and the box of its known nodes, one unit wide and high at least."""
    e = points.groupBy("way_id").agg(F.min("map_lat").alias("a"), F.min("map_lon").alias("b"), F.max("map_lat").alias("c"), F.max("map_lon").alias("d"))
    return e.select("way_id", F.col("a").alias("box_min_lat"), F.col("b").alias("box_min_lon"), U.widen(F.col("a"), F.col("c")).alias("box_max_lat"), U.widen(F.col("b"), F.col("d")).alias("box_max_lon"))


def way_segments(points: DataFrame) -> DataFrame:
    """way_id, pos, lat1, lon1, lat2, lon2 between known nodes that follow each other; a way's points form one window."""
    w = W.partitionBy("way_id").orderBy("pos")
    both = points.select("way_id", "pos", F.col("map_lat").alias("lat1"), F.col("map_lon").alias("lon1"), F.lead("map_lat").over(w).alias("lat2"), F.lead("map_lon").over(w).alias("lon2"))
    return both.where("lat2 is not null")


def simple_neighbours(areas: list[tuple[int, int, int, int]], most: int = 1000, size: int = 10) -> list[list[int]]:
    """Sets of areas that add up to a rectangle, grown by pairs that share a whole side."""
    known: dict[frozenset[int], tuple[int, int, int, int]] = {frozenset([i]): a for i, a in enumerate(areas)}
    front = dict(known)
    while front and len(known) - len(areas) < most:
        fresh: dict[frozenset[int], tuple[int, int, int, int]] = {}
        by_side: dict[tuple, list[frozenset[int]]] = {}
        for s, r in known.items():
            for side in (("left", r[1], r[0], r[2]), ("right", r[3], r[0], r[2]), ("bottom", r[0], r[1], r[3]), ("top", r[2], r[1], r[3])):
                by_side.setdefault(side, []).append(s)
        other = {"left": "right", "right": "left", "bottom": "top", "top": "bottom"}
        for s, r in front.items():
            for name, at, low, high in (("left", r[1], r[0], r[2]), ("right", r[3], r[0], r[2]), ("bottom", r[0], r[1], r[3]), ("top", r[2], r[1], r[3])):
                for t in by_side.get((other[name], at, low, high), ()):
                    both = s | t
                    if len(both) <= size and both not in known and both not in fresh:
                        q = known[t]
                        fresh[both] = (min(r[0], q[0]), min(r[1], q[1]), max(r[2], q[2]), max(r[3], q[3]))
        known |= fresh
        front = fresh
    return sorted(sorted(s) for s in known if len(s) > 1)


def whole_way_sets(known: AreaSets, ways: DataFrame, points: DataFrame, areas: DataFrame, simple: DataFrame | None = None) -> DataFrame:
    """way_id, set_no: where whole ways lie.

    Closed ways: areas that their box reaches. Open ways: areas of their nodes and, where the way may leave them (a node
    in no area, or several areas that do not make up a rectangle), areas that a segment hits. simple: areas (canonical
    sets) that make up a rectangle.
    """
    shut = ways.select(F.col("id").alias("way_id"), closed_way(F.col("refs")).alias("closed"))
    at = cut(points.join(shut, "way_id").repartition("way_id"))  # what follows is by way
    by_box = rect_near_rect(way_boxes(at.where("closed")), areas).select("way_id", "area_idx")
    open_points = at.where("not closed").drop("closed")
    places = open_points.select("node_id", "map_lat", "map_lon").distinct()  # a node lies where it lies for all of its ways
    of_node = cut(union(point_in_rect(places, areas).select("node_id", "area_idx"), "node_id"))
    by_point = open_points.select("way_id", "node_id").join(of_node, "node_id").select("way_id", "set_no")
    bare = open_points.select("way_id", "node_id").join(of_node, "node_id", "left_anti").select("way_id")
    own = cut(union(by_point, "way_id"))
    if simple is None:
        several = known.several(own)
    else:
        sets = known.arrays(own, "way_id").where(F.size("areas") > 1)
        several = sets.join(hinted(simple.select("areas")), "areas", "left_anti").select("way_id")
    may = bare.union(several).distinct()
    by_segment = segment_sets(way_segments(open_points.join(may, "way_id", "left_semi")), areas)
    return known.united(union(by_box, "way_id").union(own).union(by_segment), "way_id")


def segment_sets(segments: DataFrame, areas: DataFrame) -> DataFrame:
    """way_id, set_no: the areas that a way's segments hit; a task holds a number for each of its ways and not a row for each pair."""
    return union(segments_near_rect(segments, areas).select("way_id", "area_idx"), "way_id")


def _partners(ends: DataFrame) -> DataFrame:
    """ends (rel_id, pos, side, node) with npos, nside: the member that goes on where this end stops, and the end by which it is left again.

    The ends that meet in a node are paired from the last member on: the last with the one before it, and so on.
    """
    at = W.partitionBy("rel_id", "node").orderBy(F.col("pos").desc(), F.col("side").desc())
    other = lambda c: F.when(F.row_number().over(at) % 2 == 1, F.lead(c).over(at)).otherwise(F.lag(c).over(at))
    return ends.select("rel_id", "pos", "side", other("pos").alias("npos"), (1 - other("side")).alias("nside"))


def _shortened(live: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """Members (rel_id, pos, n0, s0, n1, s1) without about a third of them, and those taken out (rel_id, pos, up: the place of a neighbour that stays).

    n0 and n1 follow by the ends 0 and 1; s0 and s1 are the ends by which these are left again. Out goes who has a smaller hash than
    both neighbours, which are joined with each other; no two neighbours go in the same turn.
    """
    rank = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col("rel_id"), F.col(c)), F.col(c))
    less = lambda c: F.col(c).isNull() | (rank("pos") < rank(c))
    marked = live.withColumn("out", F.coalesce("n0", "n1").isNotNull() & less("n0") & less("n1"))
    out, kind = marked.where("out"), dict(live.dtypes)
    told = [out.where(f"n{k} is not null").select("rel_id", F.col(f"n{k}").alias("pos"), (1 - F.col(f"s{k}")).alias("side"), F.col(f"n{1 - k}").alias("n"), F.col(f"s{1 - k}").alias("s")) for k in (0, 1)]
    news = told[0].unionByName(told[1]).select("rel_id", "pos", F.lit(False).alias("own"), *[v for k in (0, 1) for v in (F.lit(None).cast(kind["n0"]).alias(f"n{k}"), F.lit(None).cast(kind["s0"]).alias(f"s{k}"), F.when(F.col("side") == k, F.struct("n", "s")).alias(f"new{k}"))])
    kept = marked.where("not out").select("rel_id", "pos", F.lit(True).alias("own"), *[v for k in (0, 1) for v in (F.col(f"n{k}"), F.col(f"s{k}"), F.lit(None).cast(f"struct<n:{kind['n0']},s:{kind['s0']}>").alias(f"new{k}"))])
    both = kept.unionByName(news).groupBy("rel_id", "pos").agg(*[F.max(f"{c}{k}").alias(f"{c}{k}") for k in (0, 1) for c in ("n", "s", "new")])
    at = lambda c, k: F.when(F.col(f"new{k}").isNotNull(), F.col(f"new{k}.{c}")).otherwise(F.col(f"{c}{k}")).alias(f"{c}{k}")
    return both.select("rel_id", "pos", *[at(c, k) for k in (0, 1) for c in ("n", "s")]), out.select("rel_id", "pos", F.coalesce("n0", "n1").alias("up"))


def _chains(partners: DataFrame, least: int = 1_000_000) -> DataFrame:
    """rel_id, pos, ring (the last place of its chain or circle), open, of members whose ends are paired (see _partners).

    While more than `least` members are left, a third of them goes in each turn, so that all turns together handle some three times the
    members. Along the rest pointers are doubled until nothing changes. The others then follow the neighbours that they left to, last turn first.
    """
    of = lambda c, k: F.max(F.when(F.col("side") == k, F.col(c)))
    whole = cut(partners.groupBy("rel_id", "pos").agg(*[of(c, k).alias(f"{a}{k}") for k in (0, 1) for c, a in (("npos", "n"), ("nside", "s"))], F.max(F.col("npos").isNull()).alias("open")))
    live, gone, left = whole.drop("open"), [], whole.count()
    while left > least:
        live, out = map(cut, _shortened(live, len(gone)))
        if (now := live.count()) == left:
            break
        gone, left = [*gone, out], now
    steps = cut(live.select("rel_id", "pos", F.inline(F.array(*[F.struct(F.lit(k).alias("side"), F.col(f"n{k}").alias("npos"), F.col(f"s{k}").alias("nside")) for k in (0, 1)])), F.col("pos").alias("top")))
    changed = True
    while changed:
        a, b = steps.alias("a"), steps.alias("b")
        on = (F.col("a.rel_id") == F.col("b.rel_id")) & (F.col("a.npos") == F.col("b.pos")) & (F.col("a.nside") == F.col("b.side"))
        steps = cut(a.join(b, on, "left").select("a.rel_id", "a.pos", "a.side", F.col("b.npos").alias("npos"), F.col("b.nside").alias("nside"), F.greatest("a.top", "b.top").alias("top"), F.coalesce(F.col("b.top") > F.col("a.top"), F.lit(False)).alias("more")))
        changed = not steps.where("more").isEmpty()  # no pointer brought anything, so none will: what lies beyond it is no more than what lies before
        steps = steps.drop("more")
    named = cut(steps.groupBy("rel_id", "pos").agg(F.max("top").alias("name")))
    for out in reversed(gone):
        named = cut(named.unionByName(out.join(named.withColumnRenamed("pos", "up"), ["rel_id", "up"]).select("rel_id", "pos", "name")))
    all_ = whole.select("rel_id", "pos", "open").join(named, ["rel_id", "pos"])
    rings = all_.groupBy("rel_id", "name").agg(F.max("pos").alias("ring"), F.max("open").alias("open"))
    return all_.drop("open").join(rings, ["rel_id", "name"]).select("rel_id", "pos", "ring", "open")


def rings(relations: DataFrame, mem: DataFrame, way_ends: DataFrame, boxes: DataFrame) -> DataFrame:
    """rel_id, ring (the place of its last member), box_ edges, complete: the rings of multipolygons, of the way members that are not inner ones.

    Ends that meet are paired, so that members form chains and circles, which are then shortened (see _chains); no task holds a
    relation. way_ends: way_id, first, last; ways that are missing or have one node are left out, and the rings of their relation
    then count as incomplete, as open chains do.
    """
    area = relations.where(get_tag(F.col("tags"), "type").isin("multipolygon", "boundary")).select(F.col("id").alias("rel_id"))
    own = mem.where("type = 'way' and role <> 'inner'").join(area, "rel_id", "left_semi").select("rel_id", "pos", F.col("ref").alias("way_id"))
    rows = cut(own.join(way_ends, "way_id", "left").join(boxes, "way_id", "left").withColumn("usable", F.col("first").isNotNull() & F.col("box_min_lat").isNotNull()))
    ends = rows.where("usable and first <> last").select("rel_id", "pos", F.inline(F.array(*[F.struct(F.lit(k).alias("side"), F.col(c).alias("node")) for k, c in enumerate(("first", "last"))])))
    chains = _chains(_partners(ends))
    known = rows.join(chains, ["rel_id", "pos"], "left").where("usable")
    edges = [F.min("box_min_lat").alias("box_min_lat"), F.min("box_min_lon").alias("box_min_lon"), F.max("box_max_lat").alias("box_max_lat"), F.max("box_max_lon").alias("box_max_lon")]
    found = known.groupBy("rel_id", F.coalesce("ring", "pos").alias("ring")).agg(*edges, F.max(F.coalesce("open", F.lit(False))).alias("open"))
    whole = rows.groupBy("rel_id").agg(F.min("usable").alias("whole"))
    return found.join(whole, "rel_id").select("rel_id", "ring", "box_min_lat", "box_min_lon", "box_max_lat", "box_max_lon", (F.col("whole") & ~F.col("open")).alias("complete"))


def ring_sets(known: AreaSets, ring_boxes: DataFrame, areas: DataFrame) -> DataFrame:
    """rel_id, set_no: the areas that a relation's rings reach into."""
    boxes = ring_boxes.select("rel_id", "box_min_lat", "box_min_lon", "box_max_lat", "box_max_lon")
    return known.united(rect_near_rect(boxes, areas).select("rel_id", "area_idx"), "rel_id")


def with_children(known: AreaSets, rel_sets: DataFrame, mem: DataFrame) -> DataFrame:
    """rel_id, set_no: each relation's own set with those of all relations below it, however deep.

    Loops become one node each, as the relations on them share what they have. Along ways that are single ones (see graph) sets
    are taken from twice as far in each turn. What is left then goes up the graph level by level, united in each relation that it
    reaches; a step has as many rows as relations and groups of areas, whatever was gathered below.
    """
    edges = cut(_below(mem).select(F.col("rel_id").alias("a"), F.col("below").alias("b")))
    if edges.isEmpty():
        return rel_sets.select("rel_id", "set_no")
    rings = G.strong_components(edges)
    graph = cut(G.condensed(edges, rings).select("a", F.col("b").alias("v")))
    all_ = rel_sets.select("rel_id").union(edges.select("a")).union(edges.select("b")).distinct()
    name = cut(all_.join(rings.withColumnRenamed("v", "rel_id"), "rel_id", "left").select("rel_id", F.coalesce("scc", "rel_id").alias("v")))
    have = cut(union(rel_sets.join(name, "rel_id"), "v"))
    ways = cut(G.single_ways(graph.select("a", F.col("v").alias("b"))))
    while not (live := ways.where("end is not null").select("v", "end")).isEmpty():
        got = live.join(have.withColumnRenamed("v", "end"), "end").select("v", "set_no")
        have, ways = cut(union(have.union(got), "v")), G.doubled(ways).drop("more")
    rest = cut(graph.join(ways.where("bad").select(F.col("v").alias("a")), "a", "left_semi"))
    front, steps = have if not rest.isEmpty() else have.limit(0), 0
    while not front.isEmpty():
        front = cut(union(front.join(rest, "v").select(F.col("a").alias("v"), "set_no"), "v"))
        steps += 1
        have = have.union(front) if steps % 8 else cut(union(have.union(front), "v"))
    return name.join(known.united(have, "v"), "v").select("rel_id", "set_no")


def passed_to_members(known: AreaSets, rel_sets: DataFrame, mem: DataFrame, kind: str, own: DataFrame, key: str) -> DataFrame:
    """key, set_no: the elements' own sets with those of the relations that they are members of."""
    got = mem.where(F.col("type") == kind).select("rel_id", F.col("ref").alias(key)).join(rel_sets, "rel_id").select(key, "set_no")
    return known.united(own.select(key, "set_no").union(got), key)


def passed_to_nodes(known: AreaSets, way_sets: DataFrame, refs: DataFrame, own: DataFrame) -> DataFrame:
    """node_id, set_no: nodes' own sets with those of the ways that they belong to."""
    got = refs.select("way_id", "node_id").join(way_sets, "way_id").select("node_id", "set_no")
    return known.united(own.select("node_id", "set_no").union(got), "node_id")
