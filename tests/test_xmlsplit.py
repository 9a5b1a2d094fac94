"""One-scan XML: every element once, wherever the borders fall."""

import bz2
import gzip
import random

import pytest

from tessella.sources import maps, xml, xmlsplit
from tessella.sources.element import row

KINDS = ("node", "way", "relation", "bounds")


def document():
    r = random.Random(3)
    tag = lambda: [(r.choice(["name", "a&b", "é<way>"]), r.choice(["v", "<node id='1'/>", "x\ny"])) for _ in range(r.randint(0, 2))]
    rows = [row("node", i, 1, i / 7, -i / 9, tags=tag()) for i in range(1, 120)]
    rows += [row("way", i, 1, refs=[r.randint(1, 119) for _ in range(r.randint(0, 6))], tags=tag()) for i in range(1, 61)]
    rows += [row("relation", i, 1, members=[("way", i, "outer"), ("node", 5, "")], tags=tag()) for i in range(1, 41)]
    return rows, xml.encode(rows, (1.0, 2.0, 3.0, 4.0))


def plain(rows):
    return sorted((r[0], r[1] or 0, tuple(r[5] or ()), tuple(map(tuple, r[6] or ())), tuple(map(tuple, r[7]))) for r in rows)


def test_borders(tmp_path, monkeypatch):
    rows, data = document()
    (tmp_path / "a.osm").write_bytes(data)
    monkeypatch.setattr(xmlsplit, "BLOCK", 50)
    for split in (37, 400, 5000, 10**9):
        got = [r for part in xmlsplit._Reader(str(tmp_path / "a.osm"), KINDS, split).partitions() for r in xmlsplit.elements(part.path, part.start, part.end, KINDS)]
        assert plain(r for r in got if r[0] != "bounds") == plain(rows)
        assert [r[8] for r in got if r[0] == "bounds"] == [[1.0, 2.0, 3.0, 4.0]]


def test_lists_of_changes_and_broken_files(tmp_path):
    (tmp_path / "c.osc").write_text("<?xml version='1.0'?>\n<osmChange><create>\n<node id='1' lat='1' lon='2'/></create><modify><way id='2'><nd ref='1'/></way><node id='3' lat='x' lon='1'/></modify>\n<delete><node id='4' lat='1' lon='1' action='delete'/></delete></osmChange>")
    assert [r[:2] for r in xmlsplit.elements(str(tmp_path / "c.osc"), 0, None, KINDS)] == [("node", 1), ("way", 2)]
    for broken in ("<osm><node id='1' lat='1' lon='2'><tag k='a'", "<osm><way id='1'><nd ref='1'></way></osm>"):
        (tmp_path / "b.osm").write_text(broken)
        with pytest.raises((EOFError, Exception)):
            list(xmlsplit.elements(str(tmp_path / "b.osm"), 0, None, KINDS))
    (tmp_path / "e.osm").write_text("")
    assert list(xmlsplit.elements(str(tmp_path / "e.osm"), 0, 10, KINDS)) == []


def test_folders_and_kinds(spark, tmp_path):
    rows, data = document()
    for name, content in (("a.osm", data), ("b.osm.gz", gzip.compress(data)), ("c.osm.bz2", bz2.compress(data)), ("_skipped", b"<node id='9' lat='1' lon='1'/>")):
        (tmp_path / name).write_bytes(content)
    spark.dataSource.register(xmlsplit.XmlSource)
    whole = spark.read.format("map_xml").option("kinds", "node,way,relation,bounds").option("split", 3000).load(str(tmp_path))
    n = {r.kind: r["count"] for r in whole.groupBy("kind").count().collect()}
    assert n == {"node": 3 * 119, "way": 180, "relation": 120, "bounds": 3}
    assert maps.read_elements(spark, [str(tmp_path)], ("way",)).select("kind").distinct().collect()[0][0] == "way"


def test_files_of_the_query_follow_the_tasks(spark, sf, monkeypatch):
    """A compressed file is one task, so a fixed number of files would be the number of tasks at any size."""
    from tessella.plans import formats
    from tessella.sources import storage

    found = []
    monkeypatch.setattr(formats.maps, "read_elements", lambda s, paths, kinds, real=formats.maps.read_elements: found.append(len(storage.files(paths[0]))) or real(s, paths, kinds))
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "9"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = {r.kind: r.n for r in formats.elements_xml(spark, sf).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert found == [9] and got["node"] == formats.L.nodes(spark, sf).count()
