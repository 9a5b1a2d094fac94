"""Clusters against plain rounds and against SQL."""

import hashlib
import os
import random

import duckdb
import numpy as np

from tessella.llm import catalog, clusters

SCHEMA = "vec_id long, embedding array<float>, cluster string, distance int"


def plain(rows, k, rounds, scale):
    """Every distance in every round."""
    v = [(i, [int(np.floor(float(np.float32(x)) * scale)) for x in e]) for i, e in rows]
    order = sorted(v, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    at = [list(e) for _, e in order[:k]]

    def nearest(e):
        return min((sum((a - b) ** 2 for a, b in zip(e, c, strict=True)), j) for j, c in enumerate(at))

    for _ in range(rounds):
        got = [nearest(e)[1] for _, e in v]
        for j in range(len(at)):
            own = [e for g, (_, e) in zip(got, v, strict=True) if g == j]
            if own:
                at[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    return sorted(((i, *nearest(e)[::-1]) for i, e in v), key=str), at


def test_rounds_against_plain_ones(spark):
    """Few values, so that many distances tie; repeated vectors and ids; vectors that do not count."""
    r = random.Random(5)
    rows = [(i, [r.choice([-1.0, -0.5, 0.0, 0.26, 1.0]) for _ in range(4)]) for i in range(400)]
    rows += [(r.randrange(400), rows[r.randrange(50)][1]) for _ in range(200)] + [(None, [0.0] * 4)]
    odd = [(900, None), (901, []), (902, [1.0] * 3), (903, [1.0, None, 1.0, 1.0]), (904, [float("nan")] * 4), (905, [float("inf")] * 4)]
    df = spark.createDataFrame([(*x, "own", 1) for x in rows + odd], SCHEMA)
    for k, rounds, scale in ((5, 3, 4), (16, 3, 64), (1, 2, 64), (7, 0, 2)):
        got, at = clusters.k_means(df, k, rounds, 4, scale)
        want, centres = plain(rows, k, rounds, scale)
        assert at == centres
        assert sorted(((x.vec_id, x.cluster, x.distance) for x in got.collect()), key=str) == want


def test_few_and_none(spark):
    df = spark.createDataFrame([(1, [0.5] * 64, "", 1), (2, [0.25] * 64, "", 1)], SCHEMA)
    assert sorted((r.vec_id, r.distance, r.inertia) for r in clusters.cluster_digests(df).collect()) == [(1, 0, 0), (2, 0, 0)]
    assert clusters.cluster_digests(df.limit(0)).count() == 0
    assert clusters.cluster_digests(df.selectExpr("vec_id", "slice(embedding, 1, 3) AS embedding")).count() == 0


def test_bounds_save_distances_and_hold():
    g = np.random.default_rng(3)
    centres = g.integers(-300, 300, (8, 6))
    v = (centres[g.integers(0, 8, 3000)] + g.integers(-20, 20, (3000, 6))).astype(np.int32)
    at, before, state, took = [list(map(int, x)) for x in v[:8]], None, None, []
    for _ in range(4):
        b = clusters.Bounds(at, before)
        cluster, upper, lower = b.start(v) if state is None else (state[0], *b.shift(*state))
        cluster, upper, lower, n = b.assign(v, cluster, upper, lower)
        d = np.array([clusters.squares(v, c) for c in b.at])
        assert (cluster == d.argmin(axis=0)).all()
        assert (upper.astype(np.float64) ** 2 >= d[cluster, np.arange(len(v))]).all() and (lower.T.astype(np.float64) ** 2 <= d).all()
        state, before = (cluster, upper, lower), at
        at = [[int(x) for x in v[cluster == j].sum(axis=0, dtype=np.int64) // max(1, (cluster == j).sum())] if (cluster == j).any() else at[j] for j in range(8)]
        took.append(n)
    assert took[-1] < 3000 * 8 / 4


def test_clusters_against_sql(spark, sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{f}')")
    want = sorted(con.execute(catalog.ORACLES["op13_clusters"]).fetchall())
    assert sorted(tuple(r) for r in catalog.QUERIES["op13_clusters"](spark, sf).collect()) == want
