"""Rings by doubled pointers against walks along the pairs."""

import random

from tessella.operators import complete as C

WAYS = "way_id long, first long, last long"
BOX = "way_id long, box_min_lat int, box_min_lon int, box_max_lat int, box_max_lon int"


def walked(members, ends):
    """Pairs of ends from the last member on, then everything that hangs together."""
    at = {}
    for pos, way in sorted(members, reverse=True):
        if way in ends and ends[way][0] != ends[way][1]:
            for side in (1, 0):
                at.setdefault(ends[way][side], []).append(pos)
    pairs = [(x[i], x[i + 1]) for x in at.values() for i in range(0, len(x) - 1, 2)]
    single = {x[-1] for x in at.values() if len(x) % 2}
    top = {pos: pos for pos, way in members if way in ends}
    for _ in top:
        before = dict(top)
        for a, b in pairs:
            top[a] = top[b] = max(top[a], top[b])
        if top == before:
            break
    whole = all(way in ends for _, way in members)
    return {r: whole and not single & {p for p, t in top.items() if t == r} for r in top.values()}


def test_rings(spark):
    r = random.Random(9)
    ends = {w: (r.randrange(12), r.randrange(12)) for w in range(120)}
    members = {1: [(p, w) for p, w in enumerate(r.sample(range(100), 40))], 2: [(p, w) for p, w in enumerate(r.sample(range(100), 9))] + [(50, 3), (51, 3)], 3: [(0, 500), (1, 5)], 4: []}
    ends |= {1000 + i: (5000 + i, 5000 + (i + 1) % 700) for i in range(700)}  # one circle
    ends |= {2000 + i: (8000 + i, 8001 + i) for i in range(300)}  # one chain
    order = r.sample(range(700), 700)
    members[5] = [(p, 1000 + i) for p, i in enumerate(order)] + [(700 + i, 2000 + i) for i in range(300)]
    tag = lambda v: [("type", v)]
    rels = spark.createDataFrame([*((k, tag("multipolygon")) for k in members), (9, tag("route"))], "id long, tags array<struct<k:string,v:string>>")
    rows = [(k, p, "way", w, "outer") for k, m in members.items() for p, w in m] + [(1, 900, "way", 7, "inner"), (9, 0, "way", 1, ""), (1, 901, "node", 1, "")]
    mem = spark.createDataFrame(rows, "rel_id long, pos int, type string, ref long, role string")
    told = spark.createDataFrame([(w, *e) for w, e in ends.items()], WAYS)
    boxes = spark.createDataFrame([(w, w, -w, w + 1, 1 - w) for w in ends], BOX)
    got = C.rings(rels, mem, told, boxes).collect()
    for k, m in members.items():
        assert {x.ring: x.complete for x in got if x.rel_id == k} == walked(m, ends)
    circle = next(x for x in got if x.rel_id == 5 and x.complete)
    assert (circle.ring, circle.box_min_lat, circle.box_max_lat, circle.box_min_lon) == (699, 1000, 1700, -1699)
    assert not [x for x in got if x.rel_id == 9]


def test_chains_are_shortened(spark):
    """Chains, circles, pairs that meet at both ends and single members, with every turn taken and with none."""
    r = random.Random(11)
    ends = [(rel, p, side, node) for rel, nodes, n in ((1, 40, 300), (2, 2, 7), (3, 500, 500)) for p in range(n) for side, node in enumerate(r.sample(range(nodes), 2))]
    ends += [(4, p, side, (p * 7 % 400 + side) % 400) for p in range(400) for side in (0, 1)]  # one circle, in no order
    pairs = C._partners(spark.createDataFrame(ends, "rel_id long, pos int, side int, node long"))
    told = [{tuple(x) for x in C._chains(pairs, least).collect()} for least in (0, 10_000)]
    assert told[0] == told[1] and {(x[1], x[2:]) for x in told[0] if x[0] == 4} == {(p, (399, False)) for p in range(400)}
    ways = {rel: {p: (a[3], b[3]) for a, b in zip(ends[::2], ends[1::2]) if a[0] == rel for p in [a[1]]} for rel in (1, 2, 3)}
    for rel, own in ways.items():
        assert {x[2]: not x[3] for x in told[0] if x[0] == rel} == walked([(p, p) for p in own], own)
    live = C.cut(pairs.groupBy("rel_id", "pos").agg(*[C.F.max(C.F.when(C.F.col("side") == k, C.F.col(c))).alias(f"{a}{k}") for k in (0, 1) for c, a in (("npos", "n"), ("nside", "s"))]).where("rel_id = 4"))
    assert C._shortened(live, 0)[0].count() < 300
