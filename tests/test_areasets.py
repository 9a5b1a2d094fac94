"""Sets by number where much is gathered in one element, and where area_idx are large and far apart."""

from pyspark.sql import functions as F

from tessella.operators import complete as C
from tessella.operators.areasets import BITS, AreaSets


def test_much_in_one_element(spark):
    """3,000 members with different sets: what a holder gathers has a row for each group of areas, not one for each set."""
    known, n = AreaSets(spark), 3000
    own = spark.range(n).select(F.col("id").alias("rel_id"), F.explode(F.array(*[(F.col("id") * k % 71).cast("int") for k in (1, 5, 29)])).alias("area_idx"))
    mem = spark.range(n).select(F.lit(n).cast("long").alias("rel_id"), F.lit("relation").alias("type"), F.col("id").alias("ref"))
    trees = C.with_children(known, known.united(own, "rel_id"), mem)
    assert trees.where(f"rel_id = {n}").count() == 2 == -(-71 // BITS)
    assert known.arrays(trees.where(f"rel_id = {n}"), "rel_id").first().areas == list(range(71))


def test_large_numbers(spark):
    known, told = AreaSets(spark), {1: [0, 35, 36, 2**31 - 1], 2: [7], 3: [2**31 - 1], 4: [71, 72]}
    sets = known.united(spark.createDataFrame([(k, a) for k, s in told.items() for a in s * 2], "k long, area_idx int"), "k")
    assert {r.k: r.areas for r in known.arrays(sets, "k").collect()} == told
    assert {r.k for r in known.several(sets).collect()} == {1, 4}
    assert {(r.k, r.area_idx) for r in known.single(sets).collect()} == {(2, 7), (3, 2**31 - 1)}


def test_segments_by_way(spark):
    """A long way over ten areas side by side: a row for the way and not one for each area, and the same areas as pairs."""
    areas = spark.range(10).select(F.col("id").cast("int").alias("area_idx"), F.lit(0).alias("min_lat"), (F.col("id") * 1000).cast("int").alias("min_lon"), F.lit(1000).alias("max_lat"), (F.col("id") * 1000 + 1000).cast("int").alias("max_lon"))
    segments = spark.range(50).select((F.col("id") % 2).alias("way_id"), F.col("id").cast("int").alias("pos"), F.lit(500).alias("lat1"), (F.col("id") * 200).cast("int").alias("lon1"), F.lit(510).alias("lat2"), (F.col("id") * 200 + 150).cast("int").alias("lon2"))
    sets = C.segment_sets(segments, areas)
    assert sets.count() == 2
    pairs = {(r.way_id, r.area_idx) for r in C.segments_near_rect(segments, areas).collect()}
    assert {(r.way_id, a) for r in AreaSets(spark).arrays(sets, "way_id").collect() for a in r.areas} == pairs
