"""Queries over polygons with holes, drawn around the suppliers' nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import density as D
from tessella.operators import polygons as Y
from tessella.operators.bounded import cut
from tessella.plans import lens as L
from tessella.plans import queries as Q
from tessella.plans.registry import query

# eight directions; a corner's distance follows from the supplier's key, so that polygons are stars, and a hole is a third as wide
DIRECTIONS = [(4, 0), (3, 3), (0, 4), (-3, 3), (-4, 0), (-3, -3), (0, -4), (3, -3)]


def rings(spark, sf) -> DataFrame:
    """poly_id, ring: an outer ring and, for two suppliers of three, a hole."""
    s = L.read(spark, sf, "supplier", "s_suppkey").join(L.nodes(spark, sf), F.col("s_suppkey") + 1 == F.col("id"))
    far = lambda i: 20_000 + (F.col("s_suppkey") * ((i + 3) * 7919)) % 80_000

    def ring(part: int):
        return F.array(*[F.struct((F.col("map_lat") + F.floor(far(i) / part).cast("int") * y).alias("lat"), (F.col("map_lon") + F.floor(far(i) / part).cast("int") * x).alias("lon")) for i, (y, x) in enumerate(DIRECTIONS)])

    all_ = F.when(F.col("s_suppkey") % 3 > 0, F.array(ring(1), F.reverse(ring(3)))).otherwise(F.array(ring(1)))
    return s.select(F.col("s_suppkey").cast("int").alias("poly_id"), F.explode(all_).alias("ring"))


CORNERS = f"(VALUES {', '.join(f'({i}, {y}, {x})' for i, (y, x) in enumerate(DIRECTIONS))}) d(i, dy, dx), (VALUES (1), (3)) h(part)"
EDGES = f"""
corner AS (
  SELECT CAST(s_suppkey AS INTEGER) AS poly_id, part, i, CAST(map_lat AS BIGINT) + (20000 + (s_suppkey * (i + 3) * 7919) % 80000) // part * dy AS lat, CAST(map_lon AS BIGINT) + (20000 + (s_suppkey * (i + 3) * 7919) % 80000) // part * dx AS lon
  FROM supplier JOIN nodes ON s_suppkey + 1 = id, {CORNERS} WHERE part = 1 OR s_suppkey % 3 > 0),
edge AS MATERIALIZED (SELECT a.poly_id, a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2 FROM corner a JOIN corner b ON a.poly_id = b.poly_id AND a.part = b.part AND b.i = (a.i + 1) % 8)"""
_ODD = """
  SELECT {0}, poly_id FROM (SELECT {0}, poly_id FROM {1} JOIN edge ON (lon1 <= {3}) <> (lon2 <= {3}) AND (({3} - lon1) * (lat2 - lat1) - ({2} - lat1) * (lon2 - lon1)) * sign(lon2 - lon1) >= 0) GROUP BY ALL HAVING count(*) % 2 = 1"""


@query("nodes_in_polygons", Q._with(EDGES, f"SELECT poly_id, count(*) AS n, CAST(sum(id) AS BIGINT) AS id_sum FROM ({_ODD.format('id', 'nodes', 'map_lat', 'map_lon')} UNION ALL {_ODD.format('id', 'clustered', 'map_lat', 'map_lon')}) GROUP BY poly_id"))
def nodes_in_polygons(spark, sf):
    """How many nodes lie in each polygon, holes left out."""
    all_ = L.nodes(spark, sf).unionByName(L.clustered_nodes(spark, sf)).withColumnRenamed("id", "id_sum")
    return Y.totals(all_, cut(rings(spark, sf)), ["id_sum"])


SHIFT = 13


@query("cells_in_polygons", Q._with(EDGES + f""",
cell AS (SELECT x, y, n, (y << {SHIFT}) + {D.world(SHIFT)[0]} + {1 << SHIFT - 1} AS lat, (x << {SHIFT}) + {D.world(SHIFT)[1]} + {1 << SHIFT - 1} AS lon FROM (
  SELECT (map_lon - ({D.world(SHIFT)[1]})) >> {SHIFT} AS x, (map_lat - ({D.world(SHIFT)[0]})) >> {SHIFT} AS y, count(*) AS n FROM clustered GROUP BY ALL))""",
    f"SELECT poly_id, count(*) AS cells, CAST(sum(n) AS BIGINT) AS n FROM ({_ODD.format('x, y, n', 'cell', 'lat', 'lon')}) GROUP BY poly_id"))
def cells_in_polygons(spark, sf):
    """Cells of the density map whose middle lies in a polygon, and their nodes."""
    w, half = D.world(SHIFT), 1 << SHIFT - 1
    mid = lambda c, low: (F.shiftleft(F.col(c), SHIFT) + (low + half)).cast("int")
    cells = D.density(L.clustered_nodes(spark, sf), SHIFT).select(F.col("n").alias("nodes"), mid("y", w[0]).alias("map_lat"), mid("x", w[1]).alias("map_lon"))
    return Y.totals(cells, cut(rings(spark, sf)), ["nodes"]).select("poly_id", F.col("n").alias("cells"), F.col("nodes").alias("n"))
