"""Loops of the graph of relations and their member relations, without a table of all pairs.

Relations from which every way down is a single one (each holds one relation at most, and so do all below) need no steps level
by level: pointers along their ways are doubled, so that turns are as many as the logarithm of the longest way. Where pointers
arrive then are the loops among them.

The other edges are peeled: a relation whose members have all gone, or that no relation is left to hold, lies on no loop. What
remains is the loops and what joins them; there, the largest id that reaches a relation is passed on along the edges
until nothing changes, and from each relation that met its own id this goes back along edges of the same colour: what it
meets is the relation's strongly connected component. Found components leave, and the rest is coloured anew. A step is an
aggregate by relation and a join; its result is cut in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.bounded import cut


def _peeled(edges: DataFrame) -> DataFrame:
    """The edges between relations that have both holders and members left, loops of one relation aside."""
    n = edges.count()
    while n:
        inner = edges.select(F.col("a").alias("v")).intersect(edges.select(F.col("b").alias("v")))
        kept = cut(edges.join(inner.select(F.col("v").alias("a")), "a", "left_semi").join(inner.select(F.col("v").alias("b")), "b", "left_semi").select("a", "b"))
        left = kept.count()
        if left == n:
            break
        edges, n = kept, left
    return edges


def _risen(values: DataFrame, edges: DataFrame) -> DataFrame:
    """v, c: the largest c that reaches v along edges v -> b, its own one included."""
    now, mark = values, None
    while True:
        told = now.join(edges, "v").select(F.col("b").alias("v"), "c")
        now = cut(now.union(told).groupBy("v").agg(F.max("c").alias("c")))
        seen = now.agg(F.sum(F.col("c").cast("decimal(38,0)"))).first()[0]  # colours only rise
        if seen == mark:
            return now
        mark = seen


def single_ways(edges: DataFrame) -> DataFrame:
    """v, end, top, bad of each relation a that holds others: end is the one it holds, or null and bad where it holds several."""
    n = edges.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("b"))
    return n.select(F.col("a").alias("v"), F.when(F.col("n") == 1, F.col("b")).alias("end"), F.col("a").alias("top"), (F.col("n") > 1).alias("bad"))


def doubled(ways: DataFrame) -> DataFrame:
    """The same for ways twice as long, and more: whether this told a relation anything.

    end is null once a way ends, bad where it meets a relation that holds several, top the largest id before end.
    """
    a, b = ways.where("end is not null").alias("a"), ways.alias("b")
    more = F.coalesce((F.col("b.top") > F.col("a.top")) | F.col("b.bad"), F.lit(False)).alias("more")
    far = a.join(b, F.col("a.end") == F.col("b.v"), "left").select("a.v", F.col("b.end").alias("end"), F.greatest("a.top", "b.top").alias("top"), F.coalesce("b.bad", F.lit(False)).alias("bad"), more)
    return cut(far.unionByName(ways.where("end is null").select("v", "end", "top", "bad", F.lit(False).alias("more"))))


def _single_loops(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Loops (v, scc) among relations whose ways down are single ones, and the edges between the other relations."""
    ways, seen = cut(single_ways(edges)), None
    while True:
        ways = doubled(ways)
        told = not ways.where("more").isEmpty()
        ways = ways.drop("more")
        if told:
            continue
        ends = ways.where("end is not null").select(F.col("end").alias("v")).distinct()
        if (n := ends.count()) == seen or not n:  # ways twice as long arrive at the same relations, so these lie on loops, and all others of the kind don't
            break
        seen = n
    bad = ways.where("bad").select("v")
    rest = edges.join(bad.withColumnRenamed("v", "a"), "a", "left_semi").join(bad.withColumnRenamed("v", "b"), "b", "left_semi").select("a", "b")
    return cut(ways.join(ends, "v", "left_semi").select("v", F.col("top").alias("scc"))), cut(rest)


def strong_components(edges: DataFrame) -> DataFrame:
    """v, scc: the relations that lie on a loop and the largest id on it; edges: a, b."""
    edges = cut(edges.where("a is not null and b is not null").distinct())
    alone = edges.where("a = b").select(F.col("a").alias("v"))
    found, rest = _single_loops(edges.where("a <> b"))
    rest = _peeled(rest)
    while not rest.isEmpty():
        nodes = rest.select(F.col("a").alias("v")).union(rest.select("b")).distinct()
        colour = _risen(nodes.withColumn("c", F.col("v")), rest.select(F.col("a").alias("v"), "b"))
        same = rest.join(colour.select(F.col("v").alias("a"), F.col("c").alias("ca")), "a").join(colour.select(F.col("v").alias("b"), F.col("c").alias("cb")), "b").where("ca = cb")
        back = cut(same.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # from the relation that gave a colour its name, against the edges
        front = met = cut(colour.where("v = c").select("v", F.col("c").alias("scc")))
        while not front.isEmpty():
            nxt = front.join(back.withColumnRenamed("a", "v"), "v").select(F.col("b").alias("v"), "scc").distinct()
            front = cut(nxt.join(met, "v", "left_anti"))
            met = cut(met.union(front))
        loops = met.join(met.groupBy("scc").count().where("count > 1").select("scc"), "scc", "left_semi").select("v", "scc")
        found = found.union(loops)
        gone = met.select("v")
        rest = _peeled(cut(rest.join(gone.withColumnRenamed("v", "a"), "a", "left_anti").join(gone.withColumnRenamed("v", "b"), "b", "left_anti").select("a", "b")))
    lone = alone.withColumn("scc", F.col("v"))
    return cut(found.union(lone.join(found, "v", "left_anti")))


def condensed(edges: DataFrame, components: DataFrame) -> DataFrame:
    """a, b: the edges between components, each named by its scc (or by the relation itself), without loops."""
    name = lambda k: components.select(F.col("v").alias(k), F.col("scc").alias(f"{k}_scc"))
    out = edges.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("a_scc", "a").alias("a"), F.coalesce("b_scc", "b").alias("b"))
    return out.where("a <> b").distinct()
