"""Near copies by exact similarity of word-shingle sets: SimHash anchors give candidates, and banded MinHash those that they miss.

Rows of equal shingle sets are one first. SimHash fingerprints of the shingles are linked by anchors of a covering code (see
simhash). That finds copies that differ little, yet few of those at a similarity close to 0.8, whose fingerprints differ in
some 10 of 64 bits; an anchor's reach up to there would take in a large part of all pairs. So each distinct set also then has BANDS fingerprints, each of WIDTH minimum hashes; a
pair of similarity s shares one of them with probability 1 - (1 - s ** WIDTH) ** BANDS, 0.9996 at 0.8. Every link that
is used is confirmed on the two sets themselves: first one for each row, to the smallest of the rows that lead its
fingerprints; then to some rows of its fingerprints in other components, drawn by hash; at last all pairs of
a fingerprint that are not in one component by then. Those are compared within tasks, never as rows: the rows of a fingerprint
are cut into shares, and two shares meet in a cell, which counts the common shingles of all its pairs at once. Shares of the
fingerprint's largest component meet those of the others only. So what travels is the rows of a fingerprint, some times over
where they are more than two shares. Texts travel once, for those rows alone that have a candidate.

Defined results: null and empty texts, and texts of white space alone, are alike; a text of fewer words than a shingle is
one shingle; a null doc_id never names a component (one of null ids alone has a null name).
Texts are taken whole however long they are; a task holds the shingles of one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm import scratch
from tessella.llm.arrow import map_rows, texts
from tessella.llm.components import components
from tessella.llm.simhash import forest, shingle_hashes, simhash
from tessella.llm.simhash import links as simhash_links

BANDS, WIDTH = 20, 5
_RNG = np.random.default_rng(42)
_MIX = _RNG.integers(0, 1 << 64, BANDS * WIDTH, np.uint64)
_ODD = _RNG.integers(0, 1 << 64, BANDS * WIDTH, np.uint64) | np.uint64(1)


def shingles(text: bytes, k: int) -> np.ndarray:
    """The set of a text's shingle hashes, in order."""
    return _set(shingle_hashes(text, k))


def _set(hashes: list[int]) -> np.ndarray:
    return np.unique(np.array(hashes, np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Shared shingles over all shingles; 1 for two empty sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def bands(sets: list[np.ndarray]) -> list[list[int]]:
    """The fingerprints of many sets; none for an empty one."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    full = np.flatnonzero(sizes)
    out: list[list[int]] = [[] for _ in sets]
    if len(full):
        flat = np.concatenate([sets[i] for i in full])
        begin = np.cumsum(sizes[full]) - sizes[full]
        least = np.empty((len(full), len(_MIX)), np.uint64)
        for i, (x, y) in enumerate(zip(_MIX, _ODD, strict=True)):
            h = (flat ^ x) * y
            h ^= h >> np.uint64(32)
            least[:, i] = np.minimum.reduceat(h, begin)
        digest, step = xxhash.xxh3_64_intdigest, 8 * WIDTH
        for row, i in enumerate(full.tolist()):
            raw = least[row].tobytes()
            out[i] = [digest(raw[step * j : step * (j + 1)], j) - (1 << 63) for j in range(BANDS)]
    return out


def confirmed(pairs: DataFrame, rows: DataFrame, k: int, least: float, share: int = 200) -> DataFrame:
    """Those pairs a, b of rows whose sets have a similarity of at least `least`; pairs: a table, as it is read twice.

    The text of a goes to its partners, which are cut into shares of some `share` rows, so that no task gets all of a
    large group.
    """
    salt = F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / share)).cast("int").alias("salt")
    cut = pairs.join(pairs.groupBy("a").agg(F.count("*").alias("n")), "a").select("a", "b", salt)
    ends = cut.select("a", "salt", F.col("b").alias("row")).union(cut.select("a", "salt", F.col("a").alias("row")).distinct())
    sent = ends.join(rows.select("row", "text"), "row").select("a", "salt", "row", "text", (F.col("a") == F.col("row")).alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, held = None, None
        for batch in batches:
            for a, row, own, text in zip(batch.column("a").to_pylist(), batch.column("row").to_pylist(), batch.column("own").to_pylist(), texts(batch), strict=True):
                found = shingles(text, k)
                if own:
                    now, held = a, found
                elif a == now and similarity(held, found) >= least:
                    yield a, row

    order = sent.repartition("a", "salt").sortWithinPartitions("a", "salt", F.desc("own"))
    return map_rows(order, run, "a long, b long")


def shared(sets: list[np.ndarray], often: int = 32, width: int = 4096, most: int = 1 << 12) -> np.ndarray:
    """How many shingles each two of the sets share; shingles of more than `often` sets by rows of bits, some `width` shingles
    at a time, the others by their pairs, from some `most` shingles at a time."""
    n, sizes = len(sets), np.fromiter(map(len, sets), np.int64, len(sets))
    out = np.zeros((n, n), np.int32)
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    who = np.repeat(np.arange(n), sizes)
    many = count[token] > often
    if many.any():
        number = np.cumsum(count > often) - 1
        column, row = number[token[many]], who[many]
        by = np.argsort(column, kind="stable")
        column, row = column[by], row[by]
        total = int(column[-1]) + 1
        for a in range(0, total, width):
            i, j = np.searchsorted(column, (a, a + width))
            x = np.zeros((n, -(-min(width, total - a) // 64) * 64), bool)
            x[row[i:j], column[i:j] - a] = True
            bits = np.packbits(x, axis=1).view(np.uint64)
            for r in range(n):
                out[r] += np.bitwise_count(bits & bits[r]).sum(axis=1, dtype=np.int32)
    rest = ~many & (count[token] > 1)
    token, who = token[rest], who[rest]
    by = np.argsort(token, kind="stable")
    begin = np.searchsorted(token[by], token)
    size, listed = count[token], who[by]
    flat = out.reshape(-1)
    for i in range(0, len(token), most):
        w = size[i : i + most]
        place = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w) + np.repeat(begin[i : i + most], w)
        at, times = np.unique(np.repeat(who[i : i + most], w) * n + listed[place], return_counts=True)
        flat[at] += times.astype(np.int32)
    np.fill_diagonal(out, sizes)  # shingles of one set only are left out above
    return out


def alike(sets: list[np.ndarray], roots: np.ndarray, least: float, strip: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of different roots with a similarity of at least `least`; the sets have shingles."""
    sizes, both = np.fromiter(map(len, sets), np.int64, len(sets)), shared(sets)
    left, right = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for i in range(0, len(sets), strip):
        x = both[i : i + strip].astype(np.float64)
        a, b = np.nonzero((x / (sizes[i : i + strip, None] + sizes - x) >= least) & (roots[i : i + strip, None] != roots))
        left, right = forest(np.concatenate([left, a + i]), np.concatenate([right, b]))
    return left, right


def met(told: DataFrame, sizes: DataFrame, rows: DataFrame, k: int, least: float, share: int = 1024, volume: int = 1 << 19) -> DataFrame:
    """a, b: links that join the same rows as all pairs of a fingerprint in different components with a similarity of at least
    `least` do. told: see _told; sizes: node, size (shingles). A share has some `share` rows and `volume` shingles at most."""
    told = scratch.table(told.join(sizes, "node"), "sized")
    roots = told.groupBy("at", "band", "root").agg(F.count("*").alias("n"), F.sum("size").alias("v"))
    roots = roots.withColumn("parts", F.ceil(F.greatest(F.col("n") / share, F.col("v") / volume)).cast("long"))
    of = roots.groupBy("at", "band").agg(F.max_by(F.struct("root", "parts"), F.struct("n", "root")).alias("top"), F.sum("n").alias("n"), F.sum("v").alias("v"), F.max(F.struct("n", "v")).alias("own"))
    of = of.withColumns({"n": F.col("n") - F.col("own.n"), "v": F.col("v") - F.col("own.v"), "p": F.col("top.parts")})
    of = of.withColumn("q", F.ceil(F.greatest(F.col("n") / share, F.col("v") / volume)).cast("long")).select("at", "band", F.col("top.root").alias("top"), "p", "q")
    deal = lambda parts: F.pmod(F.xxhash64("node"), F.col(parts))
    dealt = told.join(of, ["at", "band"]).withColumn("own", F.when(F.col("root") == F.col("top"), deal("p")).otherwise(F.col("p") + deal("q")))
    one = F.lit(1).cast("long")
    others = F.when(F.col("own") < F.col("p"), F.sequence("p", F.col("p") + F.col("q") - one)).otherwise(F.filter(F.sequence(F.lit(0).cast("long"), F.col("p") + F.col("q") - one), lambda x: x != F.col("own")))
    cells = F.transform(others, lambda x: F.least("own", x) * (F.col("p") + F.col("q")) + F.greatest("own", x))
    sent = dealt.select("at", "band", F.col("node").alias("row"), "root", F.explode(cells).alias("cell")).join(rows.select("row", "text"), "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, nodes, roots, sets = None, [], [], []

        def done() -> Iterator[tuple]:
            if len(set(roots)) > 1:
                a, b = alike(sets, np.array(roots), least)
                yield from ((nodes[i], nodes[j]) for i, j in zip(a.tolist(), b.tolist(), strict=True))

        for batch in batches:
            for *cell, row, root, text in zip(*(batch.column(c).to_pylist() for c in ("at", "band", "cell", "row", "root")), texts(batch), strict=True):
                if cell != now:
                    yield from done()
                    now, nodes, roots, sets = cell, [], [], []
                nodes.append(row)
                roots.append(root)
                sets.append(shingles(text, k))
        yield from done()

    order = sent.repartition("at", "band", "cell").sortWithinPartitions("at", "band", "cell")
    return map_rows(order, run, "a long, b long")


def few(df: DataFrame, most: int = 500_000) -> DataFrame:
    """Broadcast after a count of its rows, which hold one number; beyond `most` the planner shuffles."""
    return F.broadcast(df) if scratch.small(df, most) else df


def _told(near: DataFrame, star: DataFrame) -> DataFrame:
    """at, band, node, root of the fingerprints whose rows are not all in one component."""
    told = near.select("at", "band", "node").join(star, "node", "left").select("at", "band", "node", F.coalesce("root", "node").alias("root"))
    mixed = told.groupBy("at", "band").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("at", "band")
    return scratch.table(told.join(mixed, ["at", "band"]), "mixed")


def _drawn(told: DataFrame, turn: int, tries: int) -> DataFrame:
    """For each row of told some `tries` others of its fingerprints in other components, drawn by hash: of each fingerprint
    one row and one of another component than that one stand for all."""
    by = F.xxhash64(F.lit(turn), "at", "node")
    who = F.struct("node", "root")
    one = told.groupBy("at", "band").agg(F.min_by(who, by).alias("one"))
    both = told.join(one, ["at", "band"])
    two = both.where("root <> one.root").groupBy("at", "band").agg(F.min_by("node", by).alias("two"))
    other = F.when(F.col("root") == F.col("one.root"), F.col("two")).otherwise(F.col("one.node"))
    pairs = both.join(two, ["at", "band"]).select("node", other.alias("other")).distinct()
    nth = F.row_number().over(W.partitionBy("node").orderBy(F.xxhash64(F.lit(turn), "node", "other")))
    return pairs.withColumn("nth", nth).where(F.col("nth") <= tries).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def _linked(own: DataFrame, threshold: int) -> DataFrame:
    """a, b: rows of one SimHash fingerprint with the first of them, and the first ones of fingerprints within the threshold."""
    leads = scratch.table(own.groupBy("fp").agg(F.min("node").alias("lead")), "leads")
    same = own.join(leads, "fp").where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    lead = lambda x: leads.select(F.col("fp").alias(x), F.col("lead").alias("lead_" + x))
    close = simhash_links(leads.select("fp"), threshold).join(lead("a"), "a").join(lead("b"), "b")
    return same.union(close.select(F.least("lead_a", "lead_b"), F.greatest("lead_a", "lead_b")))


def near_copies(docs: DataFrame, k: int = 5, least: float = 0.8, turns: int = 1, tries: int = 6, threshold: int = 4) -> DataFrame:
    """row, doc_id, component_id (the smallest doc_id reachable over links) and kept (the row that stands for the component:
    one of that id, or of null ids alone any) of every row; docs: row (distinct), doc_id, text."""
    rows = docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        ids, hashes, size = [], [], 0

        def done() -> Iterator[tuple]:
            sets = [_set(h) for h in hashes]
            yield from ((*x, xxhash.xxh3_128_digest(f.tobytes()), g, p, len(f)) for x, f, g, p in zip(ids, sets, bands(sets), simhash(hashes).view(np.int64).tolist(), strict=True))

        for b in batches:
            for row, i, t in zip(b.column("row").to_pylist(), b.column("doc_id").to_pylist(), texts(b), strict=True):
                ids.append((row, i))
                hashes.append(shingle_hashes(t, k))
                size += len(hashes[-1])
                if size > 100_000 or len(ids) > 5000:
                    yield from done()
                    ids, hashes, size = [], [], 0
        yield from done()

    prints = scratch.table(map_rows(rows, run, "row long, doc_id long, same binary, bands array<long>, fp long, size int"), "prints")
    own = prints.groupBy("same").agg(F.min("row").alias("node"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"), F.first("bands").alias("bands"), F.first("fp").alias("fp"), F.first("size").alias("size"))
    own = scratch.table(own, "distinct")
    sent = own.select("node", F.posexplode("bands").alias("at", "band"))
    hubs = sent.groupBy("at", "band").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    near = scratch.table(sent.join(hubs, ["at", "band"]), "near")
    first = near.where("hub <> node").groupBy(F.col("node").alias("b")).agg(F.min("hub").alias("a")).select("a", "b")
    pairs = scratch.table(first.union(_linked(own, threshold)).distinct(), "pairs")
    asked = scratch.table(near.select(F.col("node").alias("row")).union(pairs.select("a")).union(pairs.select("b")).distinct(), "asked")
    rows = scratch.table(rows.select("row", "text").join(few(asked), "row", "left_semi"), "texts")
    links = scratch.table(confirmed(pairs, rows, k, least), "links")
    star = scratch.table(components(links), "star")
    told = _told(near, star)
    for turn in range(turns + 1):
        if scratch.small(told, 0):
            break
        if turn < turns:
            more = confirmed(scratch.table(_drawn(told, turn, tries), "pairs"), rows, k, least)
        else:
            more = met(told, own.select("node", "size"), rows, k, least)
        links = scratch.table(links.union(more).distinct(), "links")
        star = scratch.table(components(links), "star")
        if turn < turns:
            told = _told(near, star)
    rooted = own.join(star, "node", "left").select("same", "first", F.coalesce("root", "node").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("first"))
    label = scratch.table(rooted.drop("first").join(named, "root").select("same", F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("kept")), "labels")
    return prints.join(label, "same").select("row", "doc_id", "component_id", "kept")
