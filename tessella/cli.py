"""Options, their checks, and the phases: split, gen-problem-list, handle-problem-list, dist."""

from __future__ import annotations

import argparse
import warnings
from collections.abc import Iterable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import units as U
from tessella.operators import assign as A
from tessella.operators import complete as C
from tessella.operators import density as D
from tessella.operators import idsets as I
from tessella.operators import problems as P
from tessella.operators import regions as R
from tessella.operators import solver as S
from tessella.operators.areasets import AreaSets
from tessella.operators.bounded import cut
from tessella.operators.rangejoin import area_names
from tessella.sources import element, maps, storage, texts, tilewriter, xml

__version__ = "0.1"
DEFAULT_OVERLAP = 2000


UNUSED = {
    "max_areas": "all areas are written in one pass",
    "max_threads": "the cluster's executors decide",
    "status_freq": "progress shows in Spark's UI",
    "cache": "the input is read again where needed",
    "mixed": "elements may come in any order",
}


class OptionError(ValueError):
    pass


@dataclass
class SplitOptions:
    mapid: int = 63240001
    description: str | None = None
    max_areas: int = 2048
    overlap: str = "auto"
    max_nodes: int = 1_600_000
    num_tiles: int | None = None
    resolution: int = 13
    mixed: bool = False
    cache: str | None = None
    output_dir: str = "."
    split_file: str | None = None
    geonames_file: str | None = None
    write_kml: str | None = None
    status_freq: int = 120
    no_trim: bool = False
    max_threads: str = "auto"
    output: str = "pbf"
    problem_file: str | None = None
    keep_complete: bool = True
    problem_report: str | None = None
    polygon_file: str | None = None
    polygon_desc_file: str | None = None
    stop_after: str = "dist"
    precomp_sea: str | None = None
    boundary_tags: str = "use-exclude-list"
    wanted_admin_level: int = 5
    search_limit: int = 200_000
    handle_element_version: str = "remove"
    ignore_osm_bounds: bool = False
    route_rel_values: str = ""
    densities_file: str | None = None

    def validate(self) -> SplitOptions:
        rules = [
            (0 <= self.mapid <= 99_999_999, "mapid must be from 0 to 99999999"),
            (self.max_nodes >= 10_000, "max-nodes must be 10000 or more"),
            (self.num_tiles is None or self.num_tiles >= 2, "num-tiles must be 2 or more"),
            (self.output in ("xml", "pbf", "o5m", "simulate"), "output must be xml, pbf, o5m or simulate"),
            (1 <= self.resolution <= 24, "resolution must be from 1 to 24"),
            (1 <= self.max_areas <= 9999, "max-areas must be from 1 to 9999"),
            (not (self.polygon_file and self.polygon_desc_file), "polygon-file and polygon-desc-file exclude each other"),
            (not (self.mixed and (self.keep_complete or self.problem_file)), "mixed input can't keep elements complete"),
            (self.overlap == "auto" or (self.overlap.isdigit()), "overlap must be auto or a number from 0"),
            (0 <= self.wanted_admin_level <= 12, "wanted-admin-level must be from 0 to 12"),
            (self.handle_element_version in ("remove", "fake", "keep"), "handle-element-version must be remove, fake or keep"),
            (self.stop_after in ("split", "gen-problem-list", "handle-problem-list", "dist"), "stop-after names no phase"),
            (self.search_limit >= 1000, "search-limit must be 1000 or more"),
            (self.max_threads == "auto" or self.max_threads.isdigit(), "max-threads must be auto or a number"),
        ]
        for ok, why in rules:
            if not ok:
                raise OptionError(why)
        return self

    def overlap_units(self) -> int:
        """None of it where elements are kept complete or nothing is written."""
        if self.keep_complete or self.output == "simulate":
            return 0
        return DEFAULT_OVERLAP if self.overlap == "auto" else int(self.overlap)


def _flag(text: str) -> bool:
    if text.lower() not in ("true", "false"):
        raise argparse.ArgumentTypeError(f"{text} is neither true nor false")
    return text.lower() == "true"


def parse(argv: list[str]) -> tuple[SplitOptions, list[str]]:
    p = argparse.ArgumentParser(prog="tessella", allow_abbrev=False)
    p.add_argument("--version", action="version", version=__version__)
    for f in fields(SplitOptions):
        name = "--" + f.name.replace("_", "-")
        if isinstance(f.default, bool):
            p.add_argument(name, default=f.default, type=_flag)
            argv = [f"{name}=true" if a == name else a for a in argv]  # a bare flag takes no further word
        else:
            p.add_argument(name, default=f.default, type=int if "int" in str(f.type) else str)
    p.add_argument("files", nargs="*")
    got = vars(p.parse_args(argv))
    files = got.pop("files")
    for name in UNUSED:
        if got[name] != SplitOptions.__dataclass_fields__[name].default:
            warnings.warn(f"--{name.replace('_', '-')} has no effect here: {UNUSED[name]}", stacklevel=2)
    return SplitOptions(**got).validate(), files


@dataclass
class Result:
    areas: DataFrame
    problems: DataFrame | None = None
    tiles: DataFrame | None = None
    counters: DataFrame | None = None  # kind, n, last: observed while tiles are written, else counted when asked for


def _text(spark: SparkSession, path: str) -> str:
    raw = spark.read.format("binaryFile").load(path).select("content").first()
    return maps.unpack(path, bytes(raw[0])).decode()


def _bounds(spark: SparkSession, o: SplitOptions, elements: DataFrame, files: list[str]) -> tuple[tuple | None, tuple | None]:
    """The box of the nodes, and the bounds that the input tells: file by file, where bounds that come after a file without
    any are added to the box of the nodes up to there."""
    whole = lambda r: None if r is None or r[0] is None else tuple(r)
    joined = lambda a, b: a and b and (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])) or a or b
    if o.ignore_osm_bounds:
        return whole(D.bbox(element.nodes(elements)).first()), None
    detail = told = None
    for i, rows in enumerate([maps.read_elements(spark, [f]) for f in files] if len(files) > 1 else [elements]):
        if i and told is None:
            told = detail
        told = joined(told, whole(D.union_bounds(element.bounds(rows)).first()))
        detail = joined(detail, whole(D.bbox(element.nodes(rows)).first()))
    return detail, told


def plan_areas(spark: SparkSession, o: SplitOptions, elements: DataFrame, files: list[str] = ()) -> DataFrame:
    """The area table: read, or computed from the density of the nodes."""
    from tessella.schema import AREAS

    if o.split_file:
        rows = texts.read_areas(o.split_file, _text(spark, o.split_file))
        return spark.createDataFrame([(i, m, None, *r, False, True) for i, (m, r) in enumerate(rows)], AREAS)
    shift = 24 - o.resolution
    nodes = element.nodes(elements).select("id", "map_lat", "map_lon")
    told = None
    if o.densities_file:
        cells, detail, told = texts.read_density(_text(spark, o.densities_file))
        if o.precomp_sea:
            warnings.warn("precomp-sea is not used with densities-file, whose counts hold it already", stacklevel=2)
    else:
        cells, (detail, told) = None, _bounds(spark, o, elements, files)
    exact = told or detail
    rings = texts.read_poly(_text(spark, o.polygon_file))[1] if o.polygon_file else None
    regions = _regions(spark, o)
    if regions:
        rings = [ring for _, _, own in regions for ring in own]
    if rings and S.too_complex(rings, shift):
        warnings.warn("the bounding polygon is too complex for this resolution: its box is used", stacklevel=2)
        rings = [(True, _box(rings))]
    a, b, c, d = exact or D.WORLD
    if rings:
        lats, lons = [U.map_unit(p[1]) for _, r in rings for p in r], [U.map_unit(p[0]) for _, r in rings for p in r]
        a, b, c, d = max(a, min(lats)), max(b, min(lons)), min(c, max(lats)), min(d, max(lons))
    w = D.world(shift)
    bounds = (max(w[0], U.down(a, shift)), max(w[1], U.down(b, shift)), min(w[2], U.up(c, shift)), min(w[3], U.up(d, shift)))
    if cells is None:
        found = D.density(nodes, shift, bounds)
        if o.precomp_sea:
            sea = R.sea_density(spark, o.precomp_sea, bounds, shift)
            found = D.merge_sea(found, sea) if sea is not None else found
        cells = S.collected(found)
        x0, y0 = bounds[1] - w[1] >> shift, bounds[0] - w[0] >> shift
        if detail:
            _save(o.output_dir, "densities-out.txt", texts.write_density(zip((cells[0] + x0).tolist(), (cells[1] + y0).tolist(), cells[2].tolist(), strict=True), detail, told))
    else:
        x0, y0 = bounds[1] - w[1] >> shift, bounds[0] - w[0] >> shift
        width, height = bounds[3] - bounds[1] >> shift, bounds[2] - bounds[0] >> shift
        cells = [(x - x0, y - y0, n) for x, y, n in cells if 0 <= x - x0 < width and 0 <= y - y0 < height]
    if regions:
        if o.num_tiles:
            warnings.warn("num-tiles is not used with polygon-desc-file: every polygon is split by max-nodes", stacklevel=2)
        parts = S.split_polygons(cells, bounds, shift, {name: own for name, _, own in regions}, o.max_nodes, o.search_limit, not o.no_trim)
        rects = [r for part in parts.values() for r in part]
    elif rings and not o.num_tiles:
        rects = S.split_parts(cells, bounds, shift, rings, o.max_nodes, o.search_limit, not o.no_trim)
    else:
        m = S.DensityMap(cells, bounds, shift, S.raster(rings, bounds, shift) if rings else None)
        tiles = S.split_by_number(m, o.num_tiles, o.search_limit, not o.no_trim) if o.num_tiles else S.split_parallel(spark, m, o.max_nodes, o.search_limit, not o.no_trim)
        rects = [m.rect(S.clipped(m, t)) for t in tiles]
    out = S.area_table(spark, rects, o.mapid)
    if o.geonames_file:
        named = {r.area_idx: r.name for r in area_names(out, texts.read_cities(spark, o.geonames_file)).collect()}  # a row for each area
        return S.area_table(spark, rects, o.mapid, named)
    return out.withColumn("name", F.lit(o.description)) if o.description else out


def _box(rings) -> list[tuple[float, float]]:
    xs, ys = [p[0] for _, r in rings for p in r], [p[1] for _, r in rings for p in r]
    return [(min(xs), min(ys)), (min(xs), max(ys)), (max(xs), max(ys)), (max(xs), min(ys)), (min(xs), min(ys))]


def _regions(spark: SparkSession, o: SplitOptions) -> list:
    return R.described_polygons(maps.read_elements(spark, [o.polygon_desc_file]), 24 - o.resolution) if o.polygon_desc_file else []


def run(spark: SparkSession, o: SplitOptions, files: list[str]) -> Result:
    """All phases up to stop_after; frames stay lazy beyond what a phase has to know."""
    elements = xml.strict_nodes(maps.read_elements(spark, files))
    areas = cut(plan_areas(spark, o, elements, files))
    result = Result(areas, counters=element.counters(elements))
    listed = [(r.map_id, (r.min_lat, r.min_lon, r.max_lat, r.max_lon), r.name) for r in areas.orderBy("map_id").collect()]
    save = lambda name, text: _save(o.output_dir, name, text)
    if not o.split_file:
        save("areas.list", texts.write_area_list((m, r) for m, r, _ in listed))
    save("areas.poly", texts.write_poly("area", [r for _, r, _ in listed]))
    save("template.args", texts.write_template([(m, n) for m, _, n in listed], maps.EXTENSIONS.get(o.output) or "osm.pbf"))
    for name, text in R.region_files(_regions(spark, o), listed, maps.EXTENSIONS.get(o.output) or "osm.pbf").items():
        save(name, text)
    if o.write_kml:
        save(o.write_kml, texts.write_kml((m, r) for m, r, _ in listed))
    if o.stop_after == "split":
        return result
    nodes, ways, relations = element.nodes(elements), element.ways(elements), element.relations(elements)
    mem, refs = A.members(relations), A.way_refs(ways)
    known = AreaSets(spark)
    node_sets = cut(known.united(A.node_areas(nodes, areas, o.overlap_units()), "node_id"))
    way_sets = cut(A.way_sets(known, refs, node_sets))
    rel_sets = A.relation_sets(known, mem, node_sets, way_sets)
    if o.keep_complete or o.problem_file:
        wants = {"lowest_admin_level": o.wanted_admin_level, "boundaries": None if o.boundary_tags == "use-exclude-list" else o.boundary_tags.split(","), "routes": o.route_rel_values.split(",") if o.route_rel_values else None}
        # pseudo areas fill the rest of the world, so that elements that leave all tiles count as lying in several
        rects = P.disjoint([r for _, r, _ in listed])
        rest = P.cover(rects, D.WORLD)
        from tessella.schema import AREAS

        distinct = spark.createDataFrame([(i, 0, None, *r, i >= len(rects), True) for i, r in enumerate([*rects, *rest])], AREAS)
        apart = AreaSets(spark)
        own = cut(apart.united(A.node_areas(nodes, distinct), "node_id"))
        own_ways = cut(A.way_sets(apart, refs, own))
        own_rels = cut(A.relation_sets(apart, mem, own, own_ways))
        found = P.problem_ways(apart, own_ways).union(P.problem_relations(apart, relations, own_rels, **wants)) if o.keep_complete else spark.createDataFrame([], "kind string, id long")
        told = texts.scan_problems(spark, o.problem_file) if o.problem_file else spark.createDataFrame([], "kind string, id long")
        result.problems = cut(P.all_problems(found, told))
        if o.problem_report:
            _save(o.output_dir, o.problem_report, (r.value + "\n" for r in texts.problem_lines(result.problems).toLocalIterator()))
        if o.stop_after == "gen-problem-list":
            return result
        one_tile = known.numbered(P.one_tile_relations(apart, relations, own_rels, distinct.where("not is_pseudo"), areas, **wants), "rel_id")
        node_sets, way_sets, rel_sets = _complete(spark, known, nodes, ways, relations, areas, listed, result.problems, node_sets, way_sets, rel_sets, one_tile)
    one = lambda df, kind, key: known.arrays(df, key).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), "areas")
    result.tiles = cut(one(node_sets, "node", "node_id").union(one(way_sets, "way", "way_id")).union(one(rel_sets, "relation", "rel_id")))
    if o.stop_after == "dist" and o.output != "simulate":
        empty = result.tiles.isEmpty()  # nothing would be read then, nor observed
        read, seen = element.observed(elements)
        plain = read.where("kind <> 'bounds'").withColumn("tags", F.filter("tags", lambda t: t["k"] != "created_by"))
        tilewriter.save_tiles(plain, result.tiles, areas, o.output_dir, o.output, o.handle_element_version)
        result.counters = result.counters if empty else element.told(spark, seen)
    return result


def _complete(spark, known, nodes, ways, relations, areas, listed, problems, node_sets, way_sets, rel_sets, one_tile):
    """Sets with complete problem elements: rings replace member sets, children count for parents, parents for members."""
    mem, refs = cut(A.members(relations)), A.way_refs(ways)
    rels = C.closure(mem, problems.where("kind = 'rel'").select(F.col("id").alias("rel_id")))
    needed = cut(C.needed_ways(problems.where("kind = 'way'").select(F.col("id").alias("way_id")), mem, rels))
    own_ways, own_mem = I.within(ways, "id", needed), cut(mem.join(rels, "rel_id", "left_semi"))
    wanted = cut(C.needed_nodes(refs, needed, mem, rels))
    points = cut(C.way_points(A.way_refs(own_ways), I.within(nodes, "id", wanted)))
    odd = [r.way_id for r in C.way_boxes(points).where(U.crosses_antimeridian(U.rect("box_"))).select("way_id").limit(20).collect()]
    if odd:
        warnings.warn(f"ways that seem to cross the 180th meridian (20 of them at most): {odd}", stacklevel=2)
    simple = spark.createDataFrame([(s,) for s in C.simple_neighbours([r for _, r, _ in listed])], "areas array<int>")
    whole = cut(C.whole_way_sets(known, own_ways, points, areas, simple))
    from_members = A.relation_sets(known, own_mem, node_sets, whole)
    ends = own_ways.where(F.size("refs") > 1).select(F.col("id").alias("way_id"), F.element_at("refs", 1).alias("first"), F.element_at("refs", -1).alias("last"))
    rings = C.rings(relations.join(rels.withColumnRenamed("rel_id", "id"), "id", "left_semi"), own_mem, ends, C.way_boxes(points))
    trees = cut(C.with_children(known, A.preferred(from_members, C.ring_sets(known, rings, areas), "rel_id"), own_mem))
    passed = cut(C.passed_to_members(known, trees, own_mem, "way", whole, "way_id"))
    over_nodes = C.passed_to_nodes(known, passed, A.way_refs(own_ways), C.passed_to_members(known, trees, own_mem, "node", node_sets.limit(0), "node_id"))
    return A.merged(known, node_sets, over_nodes, "node_id"), A.preferred(way_sets, passed, "way_id"), A.preferred(rel_sets, trees, "rel_id", one_tile)


def _save(folder: str, name: str, text: str | Iterable[str]) -> None:
    """A small file, or lines one after another, written by the driver to a folder or store."""
    storage.save(f"{folder.rstrip('/')}/{name}", (x.encode() for x in ([text] if isinstance(text, str) else text)))


def main(argv: list[str] | None = None) -> int:
    import sys

    options, files = parse(sys.argv[1:] if argv is None else argv)
    run(SparkSession.builder.appName("tessella").getOrCreate(), options, files)
    return 0


def convert(spark: SparkSession, paths: list[str], target: str, form: str = "pbf") -> None:
    """Any format to any other, versions removed, as one file."""
    maps.whole_file(maps.read_elements(spark, paths), target, form)


if __name__ == "__main__":
    raise SystemExit(main())
