"""Tile files from parts of several tasks: whole and single, whatever happened to earlier attempts."""

import json
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.schema import AREAS, ELEMENT
from tessella.sources import maps, storage, tilewriter
from tessella.sources.element import row

RECTS = [(0, 7, None, 0, 0, 1000, 1000, False, True), (1, 8, None, 0, 1000, 1000, 2000, False, True), (2, 9, None, 5000, 5000, 6000, 6000, False, True)]


def made(spark):
    rows = [row("node", i, 1, i / 1e4, i / 1e4, tags=[("k", str(i))]) for i in range(1, 900)]
    rows += [row("way", i, 1, refs=[i, i + 1, i + 2], tags=[("highway", "x")]) for i in range(1, 300)]
    rows += [row("relation", i, 1, members=[("way", i, "outer"), ("relation", i + 1, "")], tags=[("type", "multipolygon"), ("name", "é")]) for i in range(1, 200)]
    df = spark.createDataFrame(rows, ELEMENT).repartition(3)
    tiles = df.select("kind", "id", F.when(F.col("id") % 2 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("areas"))
    return rows, df, tiles, spark.createDataFrame(RECTS, AREAS)


@pytest.mark.parametrize("form", ["pbf", "o5m", "xml"])
def test_tiles_are_whole(spark, tmp_path, form):
    rows, df, tiles, areas = made(spark)
    folder = str(tmp_path / "out")
    for _ in range(2):  # written twice: the second files replace the first
        tilewriter.save_tiles(df, tiles, areas, folder, form)
    assert sorted(os.listdir(folder)) == [f"0000000{k}.{maps.EXTENSIONS[form]}" for k in (7, 8)]
    for map_id, wanted in ((7, rows), (8, [r for r in rows if r[1] % 2 == 0])):
        got = maps.read_elements(spark, [f"{folder}/0000000{map_id}.{maps.EXTENSIONS[form]}"]).where("kind <> 'bounds'").collect()
        plain = sorted((r.kind, r.id, tuple(r.refs or ()), tuple(map(tuple, r.members or ())), tuple(map(tuple, r.tags))) for r in got)
        assert plain == sorted((r[0], r[1], tuple(r[5] or ()), tuple(r[6] or ()), tuple(r[7])) for r in wanted)


def test_lost_attempts_leave_nothing(spark, tmp_path, monkeypatch):
    rows, df, tiles, areas = made(spark)
    batch = df.where("kind = 'node'").orderBy("id").withColumn("map_id", F.lit(7)).toArrow().to_batches()
    writer = tilewriter.PartWriter(str(tmp_path / "p"), "pbf")
    monkeypatch.setattr(maps, "PIECE_ROWS", 100)

    def killed():
        yield from (pa.RecordBatch.from_arrays([c.slice(0, 250) for c in b.columns], schema=b.schema) for b in batch)
        raise RuntimeError("the executor is gone")

    with pytest.raises(RuntimeError):
        writer.write(killed())
    done = writer.write(iter(batch))
    writer.commit([done, None])
    told = [json.loads(x) for x in storage.lines(f"{tmp_path}/p/{tilewriter.LIST}")]
    assert [t["name"] for t in told] == [name for _, _, name in done.found] and len(told) == 1
    folder = str(tmp_path / "out")
    tilewriter._join(spark, str(tmp_path / "p"), areas, folder, "pbf", False)
    assert maps.read_elements(spark, [f"{folder}/00000007.osm.pbf"], ("node",)).count() == 899
    writer.abort([done])
    assert not os.path.exists(tmp_path / "p")
    tilewriter.save_tiles(df.limit(0), tiles, areas, folder)


@pytest.mark.parametrize("form", ["pbf", "xml"])
def test_rows_come_while_a_file_is_read(tmp_path, monkeypatch, form):
    """The first row is there before most of the file has been read; all rows come in the end."""
    rows, path = [row("way", i, 0, refs=[i * 7919 % 10**9, i * 104729 % 10**9], tags=[("k", str(i))]) for i in range(1, 60_000)], f"{tmp_path}/0000000007.{maps.EXTENSIONS[form]}"
    storage.save(path, [maps.opening(form), maps.piece(form, rows), maps.closing(form)])
    opened, plain = [], storage.open_input
    keep = lambda p: opened.append(plain(p)) or opened[-1]
    monkeypatch.setattr(storage, "open_input", keep)
    monkeypatch.setattr(maps.pbf, "open_input", keep)
    got = maps.file_rows(path)
    first = next(got)
    assert first[1] == 1 and opened[-1].tell() < os.path.getsize(path) / 2
    assert [r[1] for r in got] == list(range(2, 60_000))


def test_elements_inside_others():
    text = b"<osmChange><create><node id='1' lat='1' lon='2'><tag k='a' v='b'/></node></create><delete><way id='3' action='delete'/></delete><way id='2'><nd ref='1'/></way></osmChange>"
    assert [(r[0], r[1], r[5], r[7]) for r in maps._plain_xml(text)] == [("node", 1, None, [("a", "b")]), ("way", 2, [1], [])]


def test_files_are_shared_out(spark, tmp_path, monkeypatch):
    """As many tasks write ranges and read files back as there is work for, however few bytes it takes."""
    from tessella.plans.files import tile_names

    rows, df, tiles, areas = made(spark)
    folder, plain = str(tmp_path / "out"), tilewriter._join
    told = []

    def joined(spark, parts, *more):
        told.extend(json.loads(x) for x in storage.lines(f"{parts}/{tilewriter.LIST}"))
        return plain(spark, parts, *more)

    monkeypatch.setattr(tilewriter, "_join", joined)
    tilewriter.save_tiles(df, tiles, areas, folder)
    assert len({t["nth"] for t in told}) > 8
    assert tile_names(spark, folder).select(F.spark_partition_id().alias("task")).distinct().count() == len(os.listdir(folder)) == 2
