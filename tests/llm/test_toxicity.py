"""The toxicity fit at several shares of toxic labels and with vocabularies of unlike size."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.llm import toxicity as T

BAD = [f"bad{c}" + c * 4 for c in "abcdefghijkl"]
MILD = [f"tame{c}" + c * 4 for c in "abcdefghijkl"]


def table(spark, n, share, words=BAD, seed=3):
    """doc_id, text, toxic: a toxic text has a run of bad words; a few others hold one by chance."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        toxic = int(i < share * n)
        text = [r.choice(MILD) + r.choice("xyz") for _ in range(30)]
        if toxic:
            text[10:10] = r.sample(words, 4)
        elif r.random() < 0.02:
            text[5] = r.choice(words)
        rows.append((i, " ".join(text), toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)


@pytest.mark.parametrize("share", [0.05, 0.2, 0.3, 0.5, 0.7])
def test_recall_at_shares_of_toxic_labels(spark, share):
    rows = table(spark, 1500, share)
    model = T.fit(rows, rows, lambda i: ~T.held_out(i))
    assert model.weights
    got = T.score_toxicity(rows, model).where(T.held_out(F.col("doc_id"))).select("toxic", "toxic_score").collect()
    told = {k: [x.toxic_score >= 0.5 for x in got if x.toxic == k] for k in (0, 1)}
    assert sum(told[1]) >= 0.95 * len(told[1]) and sum(told[0]) <= 0.05 * len(told[0])


def test_small_vocabulary_beside_a_hot_one(spark):
    hot = table(spark, 3000, 0.1, ["hotword", "hotwort", "hotmot", "hotpala"])
    rare = table(spark, 300, 0.1, BAD[:6], seed=4).withColumn("doc_id", F.col("doc_id") + 10_000)
    model = T.fit(hot.union(rare), hot.union(rare), lambda i: ~T.held_out(i))
    got = T.score_toxicity(rare, model).where(T.held_out(F.col("doc_id")) & (F.col("toxic") == 1)).select("toxic_score").collect()
    assert got and all(x.toxic_score >= 0.5 for x in got)
