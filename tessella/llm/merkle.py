"""Merkle manifest of a data set: a tree for each group of rows, a tree of their roots, and a proof for every row.

Leaves are numbered within their group by key without gathering a group: rows are sorted into ranges over all tasks, and
the rows of a group before a range are summed from one count for each range and group. Trees are then built by
superblocks: the numbers of a group are cut into buckets of fanout ** levels, one applyInPandas task call collapses the
levels of a bucket, and the roots of the buckets are the nodes of the next, much smaller round. A bucket holds
fanout ** levels nodes at most, whatever the size of a group. The proof of a node is what its bucket gives (the lower
levels) with the proof of the bucket's root behind it (the upper ones).

A proof is text: for each level "/before:after", the digests that stand before and after the node in its run, joined.

Defined results: null fields count as absent ("-") in a leaf, a null group is a group of its own and comes first, null
keys come first in their group; rows of equal key follow their leaves' digests, so that repeated rows change places
without any effect; texts count whole, however long; empty in, empty out. Other columns of docs play no part.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm import scratch

FANOUT, LEVELS, FEW = 2, 10, 50_000
NODE = "grp long, bucket long, i long, path string, root string"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(v: Column) -> Column:
    """A value with its length in bytes before it, so that no two rows read the same; '-' if null."""
    s = v.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(*fields: Column) -> Column:
    return digest(F.concat(*[field(f) for f in fields]))


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """rows with grp (number of the group among all groups that a range starts or holds), i and n: place in the group, its size.

    No task ever holds a group: what is gathered is one row for each range and group in it.
    """
    by = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    laid = scratch.table(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_at", 33)
    parts = laid.groupBy(part.alias("_part"), *group).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = W.partitionBy(*group).orderBy("_part")
    parts = parts.withColumn("_before", F.sum("_n").over(before) - F.col("_n")).withColumn("n", F.sum("_n").over(W.partitionBy(*group))).withColumn("grp", F.min("_first").over(W.partitionBy(*group)))
    a, b = laid.alias("a"), _few(parts).alias("b")
    same = (F.shiftright("a._at", 33) == F.col("b._part"))
    for c in group:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, same).select("a.*", F.col("b.grp"), (F.col("a._at") - F.col("b._first") + F.col("b._before")).alias("i"), F.col("b.n")).drop("_at")


def _few(df: DataFrame, limit: int = FEW) -> DataFrame:
    return F.broadcast(df) if scratch.small(df, limit) else df


def depth(n: int, fanout: int) -> int:
    """Levels above n nodes."""
    k = 0
    while n > 1:
        n, k = -(-n // fanout), k + 1
    return k


def collapse(digests: list[str], levels: int, fanout: int) -> tuple[str, list[str]]:
    """The root of consecutive nodes after so many levels, and each node's path to it."""
    rows = [digests]
    for _ in range(levels):
        at = rows[-1]
        rows.append([hashlib.sha256("".join(at[j : j + fanout]).encode()).hexdigest() for j in range(0, len(at), fanout)])
    paths = [""] * len(rows[-1])
    for at in reversed(rows[:-1]):
        runs = [at[j : j + fanout] for j in range(0, len(at), fanout)]
        paths = [f"/{''.join(run[:k])}:{''.join(run[k + 1 :])}{paths[j]}" for j, run in enumerate(runs) for k in range(len(run))]
    return rows[-1][0], paths


def reduce_tree(nodes: DataFrame, keep: list[str], fanout: int = FANOUT, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """(grp, i, path, and the columns of keep, which are text) of every node, and (grp, root) of every group.

    nodes: grp, i (from 0, without gaps), n (nodes of the group), h and those of keep. A round for every `levels` levels
    of the largest group; what is kept travels with the nodes, so that the first round's rows meet no join but that with the
    roots of their buckets.
    """
    size = fanout**levels

    def block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        root, paths = collapse(pdf["h"].tolist(), min(levels, depth(int(pdf["n"].iloc[0]), fanout)), fanout)
        return pd.DataFrame({"grp": key[0], "bucket": key[1], "i": pdf["i"], "path": paths, "root": [root] + [None] * (len(paths) - 1)} | {c: pdf[c] for c in keep})

    dealt = nodes.select("grp", F.expr(f"i div {size}").alias("bucket"), "i", "n", "h", *keep)
    lower = scratch.table(dealt.groupBy("grp", "bucket").applyInPandas(block, ", ".join([NODE, *(f"{c} string" for c in keep)])), "lower")
    most = nodes.agg(F.max("n")).first()[0] or 0
    roots = lower.where("root is not null")
    if most <= size:
        return lower.select("grp", "i", "path", *keep), roots.select("grp", "root")
    counts = nodes.where("i = 0").select("grp", F.ceil(F.col("n") / size).alias("n"))
    tops = roots.join(_few(counts), "grp").select("grp", F.col("bucket").alias("i"), "n", F.col("root").alias("h"))
    upper, out = reduce_tree(scratch.table(tops, "tops"), [], fanout, levels)
    above = upper.select("grp", F.col("i").alias("bucket"), F.col("path").alias("above"))
    return lower.join(_few(above), ["grp", "bucket"]).select("grp", "i", F.concat("path", "above").alias("path"), *keep), out


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its proof give."""
    steps = F.when(path == "", F.array().cast("array<string>")).otherwise(F.split(F.substring(path, 2, 1 << 30), "/"))
    return F.aggregate(steps, start, lambda acc, s: digest(F.concat(F.substring_index(s, ":", 1), acc, F.substring_index(s, ":", -1))))


def siblings(path: Column) -> Column:
    """All digests of a proof, level by level, left to right."""
    return F.translate(path, "/:", "")


def manifest(leaves: DataFrame, group: str, key: str, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """leaves (group, key, leaf and others) with subroot, root and path: the proof from the leaf by its group's root to the root."""
    kept = {c: f"_kept_{j}" for j, c in enumerate(leaves.columns)}
    rows = numbered(scratch.table(leaves, "leaves"), [group], [key, "leaf"])
    nodes = rows.select("grp", "i", "n", F.col("leaf").alias("h"), *[F.col(c).cast("string").alias(k) for c, k in kept.items()])
    paths, roots = reduce_tree(nodes, list(kept.values()), fanout, levels)
    names = rows.where("i = 0").select("grp", F.col(group).alias("_name"))
    named = roots.join(_few(names), "grp").select(F.lit(0).alias("_all"), "_name", F.col("grp").cast("string").alias("_of"), F.col("root").alias("h"))
    above, root = reduce_tree(numbered(named, ["_all"], ["_name"]).withColumn("_sub", F.col("h")), ["_of", "_sub"], fanout, levels)
    upper = above.join(F.broadcast(root), "grp")  # one row
    upper = upper.select(F.col("_of").cast("long").alias("grp"), F.col("_sub").alias("subroot"), "root", F.col("path").alias("above"))
    full = paths.join(_few(upper), "grp")
    types = {f.name: f.dataType for f in leaves.schema}
    return full.select(*[F.col(k).cast(types[c]).alias(c) for c, k in kept.items()], "subroot", "root", F.concat("path", "above").alias("path"))


def document_manifest(docs: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, path and tampered: the leaf of a row whose n_chars somebody has raised by one, else null.

    Tampered with are the rows with an n_chars whose id's checksum (crc32 of the decimal id) 7 divides.
    """
    of = lambda n: leaf(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    more = (F.col("n_chars").cast("decimal(38,0)") + 1).cast("string")
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), of(F.col("n_chars")).alias("leaf"), F.when(hit, of(more)).alias("tampered"))
    return manifest(rows, "lang", "doc_id", fanout, levels).drop("lang")


def manifest_digests(docs: DataFrame) -> DataFrame:
    """The contract's columns: proofs as digests, and what folding the tampered leaf (else the leaf) gives."""
    got = document_manifest(docs).withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("path")))
    return got.select("doc_id", "leaf", "subroot", "root", digest(siblings(F.col("path"))).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
