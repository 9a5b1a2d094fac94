"""SimHash near-duplicates, linked by anchor points of a covering code.

The 64 bits are cut into threshold // 2 + 1 parts, so that two fingerprints within the threshold differ in at most one
bit of some part. Where there are many fingerprints, parts are wider: of threshold + m - 1 blocks, every m together are a
part, and again two fingerprints within the threshold differ in at most one bit of some part (at least m - 1 blocks are
equal, and one more has a single difference at most). m follows the number of fingerprints, so that an anchor's share of them
stays small: m = 1 has 2^17 anchors a part and sends 42 rows, 2 has 2^21 and 189, 3 has 2^27 and some 500. In each part the anchors are the words of a perfect Hamming code on up to 15 bits, with the part's
other bits as they are: covering radius 1. A fingerprint is at home at its nearest anchor and is sent to every anchor
within covering radius plus one; whatever is near it in that part is at home at one of those. Each anchor compares the
fingerprints at home there with all that were sent to it, whole distance, and passes on a spanning forest of the links
it finds, never all pairs. Equal fingerprints are one before that. Anchors with more than `block` rows are cut: those at
home are dealt to several shares, and those sent go to each share.

Defined results: null and empty texts, and texts of white space alone, have fingerprint 0 and link like any other; a
text of fewer words than a shingle is one shingle; repeated rows share a component; a null doc_id never names one
(a component of null ids alone has a null name). Texts are taken whole, one at a time, however long they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import scratch
from tessella.llm.arrow import map_rows, texts
from tessella.llm.components import components

SEED = 42


def shingle_hashes(text: bytes, k: int) -> list[int]:
    """XXH64 of each run of k words (ASCII white space, A-Z lower-cased), space-joined, repeats included."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return []
    line = b" ".join(words)
    if n <= k:
        return [xxhash.xxh64_intdigest(line, SEED)]
    ends = list(accumulate(map(len, words), lambda a, b: a + 1 + b))
    starts = [0, *(e + 1 for e in ends[: n - k])]
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip(starts, ends[k - 1 :], strict=True)]


def simhash(hashes: list[list[int]]) -> np.ndarray:
    """Fingerprints of many texts: a bit is 1 if over half of the hashes have it."""
    sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
    out = np.zeros(len(hashes), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        flat = np.fromiter((h for x in hashes for h in x), np.uint64, int(sizes.sum()))
        at = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
        bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * counts > sizes[full, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, k: int = 4) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of whole texts; one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        def done() -> Iterator[tuple]:
            yield from zip(ids, simhash(held).view(np.int64).tolist(), strict=True)

        for b in batches:
            ids, held, size = [], [], 0
            for i, t in zip(b.column("doc_id").to_pylist(), texts(b), strict=True):
                ids.append(i)
                held.append(shingle_hashes(t, k))
                size += len(held[-1])
                if size > 200_000:
                    yield from done()
                    ids, held, size = [], [], 0
            yield from done()

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, fp long")


class Anchors:
    """Anchors of the covering code for a threshold, over parts of `together` blocks; built from the Hamming code's rule."""

    def __init__(self, threshold: int, together: int = 1):
        self.threshold = threshold
        blocks = min(64, threshold // 2 + 1 if together == 1 else threshold + together - 1)
        cuts = [64 * i // blocks for i in range(blocks + 1)]
        self.parts = []
        for chosen in combinations(zip(cuts, cuts[1:], strict=False), min(together, blocks)):
            width = sum(b - a for a, b in chosen)
            self.parts.append((chosen, width, max((w for w in (15, 7, 3) if w <= width), default=0)))
        self.tables = {w: self._table(w) for _, _, w in self.parts if w}

    @classmethod
    def for_many(cls, threshold: int, n: int) -> Anchors:
        """Anchors for n fingerprints."""
        return cls(threshold, 1 if n <= 1 << 22 else 2 if n <= 1 << 27 else 3)

    @staticmethod
    def _table(w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word of w bits: its anchor; the anchors within distance 2, the doubles among them masked."""
        x = np.arange(1 << w, dtype=np.int64)
        syndrome = np.zeros_like(x)
        for i in range(w):
            syndrome ^= np.where(x >> i & 1, i + 1, 0)
        home = x ^ np.where(syndrome > 0, 1 << np.maximum(syndrome - 1, 0), 0)
        near = np.sort(np.stack([home, *(home[x ^ (1 << i)] for i in range(w))], axis=1), axis=1)
        fresh = np.ones(near.shape, bool)
        fresh[:, 1:] = near[:, 1:] != near[:, :-1]
        return home, near, fresh

    def deal(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """anchor key, fingerprint and whether it is at home there, for every anchor that it goes to."""
        keys, rows, homes = [], [], []
        for p, (chosen, width, w) in enumerate(self.parts):
            part, done = np.zeros(len(fps), np.int64), 0
            for a, b in chosen:
                part |= ((fps >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)).astype(np.int64) << done
                done += b - a
            low, high = part & ((1 << w) - 1), part >> w
            home, near, fresh = self.tables[w] if w else (np.zeros(1, np.int64), np.zeros((1, 1), np.int64), np.ones((1, 1), bool))
            tag = np.int64(p) << np.int64(56)
            own = home[low]
            some, col = np.nonzero(fresh[low])
            keys.append(tag | high[some] << w | near[low[some], col])
            rows.append(some)
            homes.append(near[low[some], col] == own[some])
            for i in range(width - w):
                keys.append(tag | (high ^ (1 << i)) << w | own)
                rows.append(np.arange(len(fps)))
                homes.append(np.zeros(len(fps), bool))
        return np.concatenate(keys), fps[np.concatenate(rows)], np.concatenate(homes)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links given: far fewer rows than links."""
    if not len(a):
        return a, b
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[own], nodes[label[own]]


def compare(key: np.ndarray, fp: np.ndarray, home: np.ndarray, threshold: int, pairs: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Links within whole anchors, whose rows stand together, those at home first; at most `pairs` are held at a time."""
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(start, len(key)))
    at_home = np.add.reduceat(home.astype(np.int64), start)
    use = (at_home > 0) & (size > 1)
    first = np.repeat(start[use], at_home[use]) + np.concatenate([np.arange(n) for n in at_home[use]] or [np.zeros(0, np.int64)])
    begin, width = np.repeat(start[use], at_home[use]), np.repeat(size[use], at_home[use])
    left, right = fp[:0], fp[:0]
    total = np.cumsum(width)
    i = 0
    while i < len(first):
        done = total[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(total, done + pairs, "right")))
        w = width[i:j]
        one = np.repeat(first[i:j], w)
        two = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w) + np.repeat(begin[i:j], w)
        a, b = fp[one], fp[two]
        ok = (np.bitwise_count(a ^ b) <= threshold) & (a != b)
        left, right = forest(np.concatenate([left, a[ok]]), np.concatenate([right, b[ok]]))
        i = j
    return left, right


def links(fps: DataFrame, threshold: int = 4, block: int = 1 << 15, anchors: Anchors | None = None) -> DataFrame:
    """a, b: links that join the same fingerprints as all links within the threshold do. fps: distinct fp."""
    anchors = anchors or Anchors.for_many(threshold, fps.count())
    dealt_kind = pa.schema([("key", pa.int64()), ("fp", pa.int64()), ("home", pa.bool_())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_ = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(all_), 2000):
                key, fp, home = anchors.deal(all_[i : i + 2000])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp.view(np.int64)), pa.array(home)], schema=dealt_kind)

    dealt = fps.select("fp").mapInArrow(deal, "key long, fp long, home boolean")
    shares = dealt.groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("shares"))
    shares = scratch.table(shares, "shares")
    if scratch.small(shares, 0):
        cut = dealt.withColumn("share", F.lit(0))
    else:
        cut = dealt.join(F.broadcast(shares) if scratch.small(shares, 1_000_000) else shares, "key", "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
        own = F.pmod(F.xxhash64("fp"), F.col("shares")).cast("int")
        cut = cut.select("key", "fp", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "home", own.alias("own")).select("key", "fp", (F.col("home") & (F.col("own") == F.col("share"))).alias("home"), "share")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held: list[tuple[np.ndarray, ...]] = []

        def done(last: bool) -> Iterator[tuple]:
            key, share, fp, home = (np.concatenate(c) for c in zip(*held, strict=True))
            fresh = (key[1:] != key[:-1]) | (share[1:] != share[:-1])
            cuts = np.flatnonzero(fresh)
            end = len(key) if last else (int(cuts[-1]) + 1 if len(cuts) else 0)
            held[:] = [] if last else [(key[end:], share[end:], fp[end:], home[end:])]
            if end:
                group = np.concatenate(([0], np.cumsum(fresh[: end - 1])))
                a, b = compare(group, fp[:end], home[:end], threshold)
                yield from zip(a.view(np.int64).tolist(), b.view(np.int64).tolist(), strict=True)

        rows = 0
        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            held.append((cols[0], cols[1], cols[2].view(np.uint64), cols[3]))
            rows += b.num_rows
            if rows >= 200_000:
                yield from done(False)
                rows = 0
        if held:
            yield from done(True)

    order = cut.repartition("key", "share").sortWithinPartitions("key", "share", F.col("home").desc())
    return map_rows(order.select("key", "share", "fp", "home"), linked, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 4, threshold: int = 4) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links) of every row."""
    rows = scratch.table(fingerprints(docs, k), "fingerprints")
    own = scratch.table(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    star = components(links(own, threshold))
    rooted = own.join(star.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    label = scratch.table(rooted.join(named, "root").select("fp", "component_id"), "labels")
    return rows.join(label, "fp").select("doc_id", "fp", "component_id")
