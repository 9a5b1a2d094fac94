"""Mixing sources to target weights by capped water-filling. DataFrame operations only.

Targets: every source gets weight * level words, but at most max_epochs times its size; the level is raised until the
budget is spent, so what a clamped source leaves goes to the others by weight. Sampling: each document is taken
floor(target / size of its source) times whole; for the rest, documents in seeded order are taken once more until the
rest is filled. The order is cut into buckets of about rows_per_bucket documents; bucket totals find the bucket in which
a source's rest ends, and only that bucket is gone through document by document (the largest part ever gathered).

No document is taken more often than max_epochs, rounded up.

Defined results: a null source is a source of its own; null and empty texts have size 0 and may be taken or not at no
cost; rows that repeat an id and a text are taken or left together; sources of size 0 have target 0; empty in, empty
out. Sources are one row each in a table of their own, which is broadcast only if it has at most `few` rows. A
text counts whole however long it is; one longer than what a source's rest has room for is passed over for the next.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.llm import scratch

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_level(sources: DataFrame, budget: float, max_epochs: float) -> float | None:
    """The level at which weight * level, clamped at the caps, sums to the budget; None: every source is clamped.

    sources: size, weight. Each round clamps the sources that the last level overfills and shares the rest anew; the
    level only rises, and a round is one aggregate.
    """
    cap = F.col("size") * F.lit(float(max_epochs))
    level = 0.0
    while True:
        clamped = cap <= F.col("weight") * F.lit(level)
        spent, weight = sources.agg(F.sum(F.when(clamped, cap)), F.sum(F.when(~clamped, F.col("weight")))).first()
        if not weight:
            return None
        nxt = (budget - (spent or 0.0)) / weight
        if nxt <= level:
            return level
        level = nxt


def targets(sources: DataFrame, share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """Adds target (double) to a table of source, size, weight; the budget is share times the size of all."""
    total = sources.agg(F.sum("size")).first()[0] or 0
    level = water_level(sources, share * total, max_epochs)
    cap = F.col("size") * F.lit(float(max_epochs))
    return sources.withColumn("target", cap if level is None else F.least(cap, F.col("weight") * F.lit(level)))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def mix(docs: DataFrame, size: Column, weigh, share: float = 1.5, max_epochs: float = 2.0, seed: int = 42, rows_per_bucket: int = 1024, few: int = 100_000) -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target, mix_repeats and mix_taken (words taken, repeats counted).

    docs needs doc_id, text and source; columns of docs with those new names are replaced. weigh: a function from the
    table of source and size to the same with a weight column.
    """
    new = ["mix_size", "mix_source_size", "mix_target", "mix_repeats", "mix_taken"]
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    docs = docs.drop(*new)
    slim = scratch.table(docs.select(F.col("source").cast("string").alias("source"), key.alias("key"), size.alias("size")), "sizes")
    sums = slim.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    plan = scratch.table(targets(weigh(scratch.table(sums, "sources")), share, max_epochs), "targets")
    whole = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0)
    plan = plan.select("source", F.col("size").alias("source_size"), "target", whole.alias("whole"), F.ceil(F.col("n") / rows_per_bucket).alias("buckets")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    is_few = scratch.small(plan, few)
    by_source = (lambda df: F.broadcast(df)) if is_few else (lambda df: df)

    left = slim.alias("a").join(by_source(plan).alias("b"), _same(F.col("a.source"), F.col("b.source"))).select("a.source", "a.key", "a.size", "rest", F.pmod("key", "buckets").alias("bucket"))
    order = W.partitionBy("source").orderBy("bucket")
    totals = left.groupBy("source", "bucket").agg(F.sum("size").alias("size"), F.first("rest").alias("rest"))
    ends = totals.withColumn("upto", F.sum("size").over(order)).where("upto > rest").groupBy("source").agg(F.min_by(F.struct("bucket", (F.col("rest") - F.col("upto") + F.col("size")).alias("room")), "bucket").alias("end"))
    ends = scratch.table(ends.select("source", "end.bucket", "end.room"), "ends")
    last = left.alias("a").join(by_source(ends).alias("b"), _same(F.col("a.source"), F.col("b.source")) & (F.col("a.bucket") == F.col("b.bucket"))).groupBy("a.source", "key").agg(F.sum("size").alias("size"), F.first("room").alias("room"))
    taken = F.aggregate(
        F.array_sort(F.collect_list(F.struct(F.xxhash64("key").alias("at"), "key", "size"))),
        F.struct(F.first("room").alias("room"), F.array().cast("array<bigint>").alias("keys")),
        lambda a, x: F.when(x["size"] <= a["room"], F.struct((a["room"] - x["size"]).alias("room"), F.array_append(a["keys"], x["key"]).alias("keys"))).otherwise(a),
        lambda a: a["keys"],
    )
    chosen = last.groupBy("source").agg(taken.alias("keys"))
    full = plan.alias("p").join(ends.alias("e"), _same(F.col("p.source"), F.col("e.source")), "left").join(chosen.alias("c"), _same(F.col("p.source"), F.col("c.source")), "left")
    full = scratch.table(full.select(F.col("p.source").alias("mix_source"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), "whole", "buckets", F.coalesce("bucket", "buckets").alias("end"), "keys"), "plan")

    # a document travels as one column, so that its columns meet none of these
    told = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("source").cast("string").alias("source"), size.alias("mix_size"), key.alias("key"))
    bucket = F.pmod(F.col("key"), F.col("buckets"))
    more = F.when(bucket < F.col("end"), 1).when((bucket == F.col("end")) & F.coalesce(F.array_contains("keys", F.col("key")), F.lit(False)), 1).otherwise(0)
    out = told.join(by_source(full), _same(F.col("source"), F.col("mix_source"))).withColumn("mix_repeats", F.least(F.col("whole") + more, F.lit(math.ceil(max_epochs))).cast("int")).withColumn("mix_taken", F.col("mix_repeats") * F.col("mix_size"))
    return out.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns], *new)


def code_point_weights(sources: DataFrame) -> DataFrame:
    """Weights 5, 2, 1, repeating, by code point of the source, null last. The table has one row for each source."""
    turn = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % 3
    return sources.withColumn("weight", F.when(turn == 0, 5.0).when(turn == 1, 2.0).otherwise(1.0))
