"""Water-filling and sampling against a plain version."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessella.llm import mixing as M
from tests_llm_plain import plain_targets

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def size(text):
    return len(WORD.findall((text or "").encode()))


def rows(spark, seed=5):
    r = random.Random(seed)
    told = []
    for i in range(400):
        source = r.choice(["hot"] * 10 + ["a", "Ä", "b", "z", "tiny", None, ""])
        told.append((i, " ".join("w" * r.randint(1, 3) for _ in range(1 if source == "tiny" else r.randint(0, 40))), source))
    told += [(500, None, "a"), (501, "", "none"), (502, None, "none"), (503, "x y z", "b"), (503, "x y z", "b"), (503, "other words", "b"), (None, "p q", "z"), (None, "p q r", None), (504, "long " * 30_000, "hot")]
    extra = [(*x, "kept", 7, -1.0) for x in told]
    return told, spark.createDataFrame(extra, "doc_id long, text string, source string, mix_size string, mix_key int, weight double")


def check(told, got, share=1.5, most=2.0):
    sizes = {}
    for _, t, s in told:
        sizes[s] = sizes.get(s, 0) + size(t)
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want = plain_targets(sizes, weights, share * sum(sizes.values()), most)
    assert sorted(((str(x.doc_id), x.text or "", str(x.source)) for x in got)) == sorted((str(i), t or "", str(s)) for i, t, s in told)
    taken, largest = {}, {}
    for x in got:
        assert x.mix_size == size(x.text) and x.mix_source_size == sizes[x.source]
        assert x.mix_target == pytest.approx(want[x.source], rel=1e-9, abs=1e-9)
        assert x.mix_taken == x.mix_repeats * x.mix_size and 0 <= x.mix_repeats <= most
        taken[x.source] = taken.get(x.source, 0) + x.mix_taken
        largest[x.source] = max(largest.get(x.source, 0), x.mix_size)
    for s, n in taken.items():
        assert n <= want[s] + 1e-6 and want[s] - n <= 2 * largest[s]  # a repeated row counts as one
    return taken


@pytest.mark.parametrize("few", [100_000, 0])
@pytest.mark.parametrize("bucket", [1024, 16])
def test_mix(spark, few, bucket):
    told, df = rows(spark)
    words = M.word_count(F.col("text"))
    mixed = [M.mix(d, words, M.code_point_weights, rows_per_bucket=bucket, few=few) for d in (df, df.repartition(5))]
    one, two = (d.collect() for d in mixed)
    assert mixed[0].columns == ["doc_id", "text", "source", "mix_key", "weight", "mix_size", "mix_source_size", "mix_target", "mix_repeats", "mix_taken"]
    assert {x.mix_key for x in one} == {7}
    check(told, one)
    key = lambda x: (str(x.doc_id), x.text or "", x.mix_repeats)
    assert sorted(map(key, one)) == sorted(map(key, two))  # reruns agree
    twins = [x.mix_repeats for x in one if x.doc_id == 503 and x.text == "x y z"]
    assert len(twins) == 2 and len(set(twins)) == 1


def test_shares(spark):
    told, df = rows(spark, 8)
    words = M.word_count(F.col("text"))
    for share in (0.01, 0.7, 1.0, 1.99, 2.0, 5.0):  # beyond the limit every source is clamped
        got = M.mix(df, words, M.code_point_weights, share=share).collect()
        if share < 2:
            check(told, got, share)
        else:
            assert all(x.mix_repeats == 2 for x in got if x.mix_size)


def test_nothing_to_mix(spark):
    _, df = rows(spark)
    words = M.word_count(F.col("text"))
    assert M.mix(df.limit(0), words, M.code_point_weights).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "a"), (2, "", "a")], "doc_id long, text string, source string")
    assert [(x.mix_size, x.mix_target, x.mix_taken) for x in M.mix(blank, words, M.code_point_weights).collect()] == [(0, 0.0, 0)] * 3
