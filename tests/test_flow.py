"""Steps of the flow that do without the order of nodes."""

from tessella.plans import lens as L
from tessella.plans import queries as Q


def test_way_sets_need_no_order(spark, sf):
    pairs = lambda df: {tuple(x) for x in df.select("way_id", "node_id").collect()}
    assert pairs(L.way_nodes(spark, sf)) == pairs(L.way_refs(spark, sf))
    f = Q.Flow(spark, sf)
    assert f.problem_rels.count() > 0 and f.problem_ways.count() > 0 and "refs" not in vars(f)
