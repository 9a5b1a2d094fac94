"""Options, whole runs over a small map, and the stream of densities."""

import os

import pytest
from pyspark.sql import functions as F

from tessella import cli
from tessella.operators import complete as C
from tessella.sources import maps, pbf, texts
from tessella.sources.element import nodes, row


def test_options():
    o, files = cli.parse(["--max-nodes=20000", "--keep-complete=false", "--no-trim", "a.pbf", "b.o5m"])
    assert o.max_nodes == 20_000 and not o.keep_complete and o.no_trim and files == ["a.pbf", "b.o5m"]
    assert o.overlap_units() == 2000 and cli.SplitOptions().overlap_units() == 0
    for bad in ({"mapid": -1}, {"max_nodes": 10}, {"num_tiles": 1}, {"output": "l p"}, {"resolution": 25}, {"max_areas": 0}, {"polygon_file": "a", "polygon_desc_file": "b"}, {"mixed": True}, {"overlap": "x"}, {"wanted_admin_level": 13}, {"handle_element_version": "x"}, {"stop_after": "x"}, {"search_limit": 1}):
        with pytest.raises(cli.OptionError):
            cli.SplitOptions(**bad).validate()
    with pytest.raises(SystemExit):
        cli.parse(["--what=1"])


@pytest.fixture(scope="module")
def small_map(tmp_path_factory):
    """A lattice of 40 by 40 nodes with long ways, a ring of ways, and relations that form a loop."""
    place = lambda y, x: 1 + y * 40 + x
    rows = [row("node", place(y, x), 1, 50 + y / 20, 8 + x / 20) for y in range(40) for x in range(40)]
    rows += [row("way", 1 + y, 1, refs=[place(y, x) for x in range(0, 40, 13)]) for y in range(40)]
    rows += [row("way", 101, 1, refs=[place(1, 1), place(1, 38)]), row("way", 102, 1, refs=[place(1, 38), place(38, 38), place(38, 1)]), row("way", 103, 1, refs=[place(38, 1), place(1, 1)]), row("way", 104, 1, refs=[place(0, 0), place(0, 1), 999_999])]
    rows += [row("relation", 1, 1, members=[("way", 101, "outer"), ("way", 102, "outer"), ("way", 103, "outer")], tags=[("type", "multipolygon")])]
    rows += [row("relation", 2, 1, members=[("relation", 3, ""), ("way", 1, "")], tags=[("type", "restriction")]), row("relation", 3, 1, members=[("relation", 2, ""), ("node", 5, "")], tags=[("type", "other")])]
    path = tmp_path_factory.mktemp("map") / "m.osm.pbf"
    path.write_bytes(pbf.encode(rows))
    return str(path), rows


def test_complete_run(spark, small_map, tmp_path, monkeypatch):
    path, rows = small_map
    tiles_out = str(tmp_path / "out")
    o = cli.SplitOptions(output_dir=tiles_out, problem_report="problems.list", write_kml="areas.kml", resolution=13, search_limit=1000)
    o.max_nodes = 500
    r = cli.run(spark, o, [path])
    listed = texts.read_area_list(open(f"{tiles_out}/areas.list").read())
    assert len(listed) >= 4 and texts.read_kml(open(f"{tiles_out}/areas.kml").read()) == listed
    problems = texts.read_problems(open(f"{tiles_out}/problems.list").read())
    assert ("rel", 1) in problems and ("way", 10) in problems
    by_tile = {}
    for map_id, rect in listed:
        got = list(pbf.decode(open(f"{tiles_out}/{map_id:08d}.osm.pbf", "rb").read()))
        by_tile[map_id] = {k: {x[1]: x for x in got if x[0] == k} for k in ("node", "way", "relation")}
        own = [x for x in rows if x[0] == "node" and rect[0] <= cli.U.map_unit(x[3]) <= rect[2] and rect[1] <= cli.U.map_unit(x[4]) <= rect[3]]
        assert {x[1] for x in own} <= set(by_tile[map_id]["node"])
    seen = {k: set().union(*(t[k] for t in by_tile.values())) for k in ("node", "way", "relation")}
    assert seen["node"] == {x[1] for x in rows if x[0] == "node"} and seen["way"] == {x[1] for x in rows if x[0] == "way"} and seen["relation"] == {1, 2, 3}
    own = {("way", i) for k, i in problems if k == "way"}
    for t in by_tile.values():
        for w in t["way"].values():
            if ("way", w[1]) in own:
                assert set(w[5]) - {999_999} <= set(t["node"])
    # the ring's multipolygon is in every tile, those inside it too, with all its ways
    assert all(1 in t["relation"] and {101, 102, 103} <= set(t["way"]) for t in by_tile.values())
    assert r.tiles.where("size(areas) = 0").count() == 0


@pytest.mark.parametrize("form", ["o5m", "xml", "simulate"])
def test_plain_run(spark, small_map, tmp_path, form):
    o = cli.SplitOptions(output_dir=str(tmp_path), keep_complete=False, output=form, overlap="0")
    o.max_nodes = 500
    r = cli.run(spark, o, [small_map[0]])
    names = {n for n in os.listdir(tmp_path) if n[:4] == "6324"}
    assert len(names) == (0 if form == "simulate" else r.areas.count())
    if names:
        back = maps.read_elements(spark, [str(tmp_path / n) for n in sorted(names)])
        assert nodes(back).select("id").distinct().count() == 1600


def test_split_file_and_phases(spark, small_map, tmp_path):
    (tmp_path / "in.list").write_text(texts.write_area_list([(63240001, (2_320_000, 360_000, 2_380_000, 420_000)), (63240002, (2_380_000, 360_000, 2_430_000, 480_000))]))
    o = cli.SplitOptions(output_dir=str(tmp_path), split_file=str(tmp_path / "in.list"), stop_after="gen-problem-list")
    r = cli.run(spark, o, [small_map[0]])
    assert r.areas.count() == 2 and r.problems.count() > 0 and r.tiles is None


def test_regions_and_sea(spark, small_map, tmp_path):
    corner = {1: (50.1, 8.1), 2: (50.1, 9.3), 3: (51.5, 9.3), 4: (51.5, 8.1), 5: (50.5, 8.9), 6: (50.5, 9.9), 7: (51.2, 9.9), 8: (51.2, 8.9)}
    shapes = [row("node", i, 1, *p) for i, p in corner.items()] + [row("way", 1, 1, refs=[1, 2, 3, 4, 1], tags=[("name", "west"), ("mapid", "70000001")]), row("way", 2, 1, refs=[5, 6, 7, 8, 5], tags=[("name", "east"), ("mapid", "71000001")]), row("way", 3, 1, refs=[1, 2], tags=[("name", "none")])]
    (tmp_path / "regions.osm.pbf").write_bytes(pbf.encode(shapes))
    lat, lon = (cli.U.down(cli.U.map_unit(v), 15) for v in (50.9, 8.9))
    (tmp_path / "index.txt").write_text(f"{lat}_{lon};mixed.osm.pbf\n0_0;sea\n")
    (tmp_path / "mixed.osm.pbf").write_bytes(pbf.encode([row("node", 1, 1, 50.91, 8.91)]))
    o = cli.SplitOptions(output_dir=str(tmp_path / "o"), polygon_desc_file=str(tmp_path / "regions.osm.pbf"), precomp_sea=str(tmp_path), stop_after="split", search_limit=1000)
    o.max_nodes = 200
    rects = [(r.min_lat, r.min_lon, r.max_lat, r.max_lon) for r in cli.run(spark, o, [small_map[0]]).areas.collect()]
    assert len(rects) > 4
    edge = 0.05
    for _, _, _, y, x, *_ in (e for e in small_map[1] if e[0] == "node"):
        if 50.1 + edge < y < 51.5 - edge and 8.1 + edge < x < 9.3 - edge or 50.5 + edge < y < 51.2 - edge and 8.9 + edge < x < 9.9 - edge:
            assert any(a <= cli.U.map_unit(y) <= c and b <= cli.U.map_unit(x) <= d for a, b, c, d in rects)
    assert {"west-areas.poly", "east-areas.poly", "west-template.args"} <= set(os.listdir(tmp_path / "o"))
    assert "mapname: 71000001" in open(tmp_path / "o" / "east-template.args").read()


def test_convert(spark, small_map, tmp_path):
    cli.convert(spark, [small_map[0]], str(tmp_path / "c.o5m"), "o5m")
    assert maps.read_elements(spark, [str(tmp_path / "c.o5m")]).where("kind <> 'bounds'").count() == len(small_map[1])


def test_loops_end(spark):
    mem = spark.createDataFrame([(1, "relation", 2), (2, "relation", 3), (3, "relation", 1), *[(i, "relation", i + 1) for i in range(10, 40)]], "rel_id long, type string, ref long")
    start = spark.createDataFrame([(1,), (10,)], "rel_id long")
    got = {r.rel_id: r.depth for r in C.closure(mem, start).collect()}
    assert got == {1: 0, 2: 1, 3: 2, **{10 + i: i for i in range(31)}}
    assert {r.rel_id for r in C.loops(mem).collect()} == {1, 2, 3}


def test_density_stream(spark, tmp_path):
    from tessella.plans import lens
    from tessella.streaming.density import density_stream, windowed_density

    n = lens.nodes(spark, "/root/testdata/sf0.001").withColumn("ts", F.timestamp_seconds(F.col("id") * 600))
    n.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(n.schema).parquet(str(tmp_path / "in"))
    density_stream(stream()).writeStream.format("memory").queryName("cells").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("cells").agg(F.sum("n")).first()[0] == 200
    windowed_density(stream(), "ts").writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert 0 < spark.table("windows").count() <= 200
