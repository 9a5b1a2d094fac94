"""Repeated passages across documents, byte for byte, by run-length indexes.

Every 50-byte string has a marker: the least hash of its 16-byte pieces. Neighbouring strings with one marker form a
stretch, so all occurrences of a string carry one marker. The corpus is kept in blocks of whole documents, and work goes
back and forth between blocks and buckets of markers:

1. Blocks send their distinct markers (46 bits each), buckets tell which of them stand in several documents. Stretches
   with any other marker hold no repeated string and go no further.
2. Blocks send their distinct remaining stretches, each with the smallest document of the block that holds it. A bucket
   builds one index over the distinct stretches of all blocks, streams every stretch through it, and tells the blocks
   for each string the smallest document of all that holds it.
3. Blocks cut from each document what a smaller document has.

The index is a Burrows-Wheeler transform in the order of the strings' 50 bytes, ties by document, kept by runs (same
string, same byte before it) with the smallest document sampled at each run's head. Reading goes backwards: a stretch's
last string is found by binary search over the sampled text, and from there each byte to the left is one step over the
runs (rank of the pair of string and byte among all with that byte). Every string reached matches 50 bytes at least; the
sample at its first run is the smallest document of the match.

A marker that stands in more than `hot` blocks is split: a string whose piece lies in its first half also holds the 17
bytes behind the piece, else the 17 bytes before it, so marker and those bytes make a finer key of the same kind.

Defined results: null text is empty; texts under the length lose nothing; a null doc_id comes after all others; rows
that share id and text are cut alike and never against each other; of rows that share an id but not the text, none is
smaller than the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import scratch
from tessella.llm.arrow import map_rows, pack, texts, unpack

LENGTH, PIECE = 50, 16
LAST_ID = (1 << 63) - 1
BLOCK, CHUNK = 4 << 20, 1 << 16
#: Bytes of text whose markers, and of stretches that, meet in one bucket.
MARKS, STRETCHES = 32 << 20, 2 << 20
_AVERAGE, _LONGEST = 68, 1024
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _words(raw: bytes, n: int, order: str = "<") -> np.ndarray:
    """The eight bytes from each of n positions on as a number."""
    return np.ndarray((n,), order + "u8", raw, 0, (1,)).astype(np.uint64)


def _markers(raw: bytes, n: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The least piece hash of the string from each of n positions on, and the place of the first such piece; by chunks that fit a cache.

    The lowest bits of a hash make way for the piece's place in the chunk, so that one minimum gives both.
    """
    width = length - PIECE + 1
    out, places = np.empty(n, np.uint64), np.empty(n, np.int32)
    raw += bytes(length + 16)
    bits = np.uint64((CHUNK + length).bit_length())
    index = np.arange(CHUNK + width, dtype=np.uint64)
    for at in range(0, n, CHUNK):
        m = min(CHUNK, n - at)
        a = _words(raw[at : at + m + width + 24], m + width + 7)
        h = (a[:-8] * _MIX[0]) ^ ((a[8:] ^ _MIX[2]) * _MIX[1])
        h ^= h >> np.uint64(29)
        h *= _MIX[2]
        h ^= h >> np.uint64(32)
        h >>= bits
        h <<= bits
        h |= index[: len(h)]
        size = 1
        while 2 * size <= width:
            h = np.minimum(h[:-size], h[size:])
            size *= 2
        h = (h if size == width else np.minimum(h[: len(h) - (width - size)], h[width - size :]))[:m]
        out[at : at + m] = h >> bits
        places[at : at + m] = (h & np.uint64((1 << int(bits)) - 1)).astype(np.int32) + at
    return out, places


def stretches(raw: bytes, sizes: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """start, number of strings, marker and document of each stretch of documents that stand one after another; and the place of every string's piece."""
    base = np.cumsum(sizes) - sizes
    long = np.flatnonzero(sizes >= length)
    n = len(raw)
    if not len(long):
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none, none
    mark, place = _markers(raw, n, length)
    fresh = np.empty(n, bool)
    fresh[0] = False
    np.not_equal(mark[1:], mark[:-1], out=fresh[1:])
    fresh[base[long]] = True
    whole = np.zeros(n + 1, np.int8)  # where strings may start
    whole[base[long]] += 1
    whole[base[long] + sizes[long] - length + 1] -= 1
    fresh &= np.cumsum(whole[:n], dtype=np.int8).view(bool)
    start = np.flatnonzero(fresh)
    many = np.diff(np.append(np.searchsorted(start, base[long]), len(start)))
    doc = np.repeat(long, many)
    end = np.minimum(np.append(start[1:], n), np.repeat(base[long] + sizes[long] - length + 1, many))
    return start, end - start, mark[start], doc, place


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of all ranges, one after another."""
    total = np.cumsum(sizes)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(starts - (total - sizes), sizes)


def _sorted(key: np.ndarray, least_bits: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers in order, where a new one begins, and their places, which decide ties."""
    n = len(key)
    bits = max(1, (n - 1).bit_length(), least_bits)
    if int(key.max(initial=0)).bit_length() + bits <= 64:
        both = np.sort(key << np.uint64(bits) | np.arange(n, dtype=np.uint64))
        order = (both & np.uint64((1 << bits) - 1)).astype(np.int64)
        both >>= np.uint64(bits)
    else:
        order = np.argsort(key, kind="stable")
        both = key[order]
    fresh = np.empty(n, bool)
    fresh[:1] = True
    np.not_equal(both[1:], both[:-1], out=fresh[1:])
    return both, fresh, order


def _ranked(fresh: np.ndarray, order: np.ndarray) -> np.ndarray:
    rank = np.empty(len(order), np.int32)
    rank[order] = np.cumsum(fresh, dtype=np.int32) - 1
    return rank


class RunIndex:
    """Run-length Burrows-Wheeler transform, to the depth of one string, of stretches that stand one after another by document.

    docs: the document of each stretch, ascending. What is kept beside the text is by runs, strings and their steps.
    """

    def __init__(self, raw: bytes, starts: np.ndarray, counts: np.ndarray, docs: np.ndarray, length: int):
        self.raw, self.length = raw + bytes(16), length
        text = np.frombuffer(raw, np.uint8)
        at = spread(starts, counts)
        use = np.zeros(len(text), bool)
        use[at] = True
        part, fresh, order = self._order(text, length)
        string = np.cumsum(fresh, dtype=np.int32)
        kept = use[order]
        order, string = order[kept], string[kept]
        head = np.empty(len(order), bool)
        head[:1] = True
        np.not_equal(string[1:], string[:-1], out=head[1:])
        node = np.cumsum(head, dtype=np.int64) - 1
        edge = np.zeros(len(text), bool)
        edge[starts[counts > 0]] = True
        before = np.where(edge[order], 0, text[order - 1].astype(np.int64) + 1)
        turn = head.copy()
        turn[1:] |= before[1:] != before[:-1]
        run = np.flatnonzero(turn)
        run_node, run_byte = node[run], before[run]  # the transform by runs
        stretch = np.empty(len(text), np.int32)
        stretch[at] = np.repeat(np.arange(len(starts), dtype=np.int32), counts)
        self.runs, self.run_doc = len(run), docs[stretch[order[run]]]  # the sample at each run's head
        self.node_run = np.flatnonzero(head[run])  # the first run of each string
        self.node_at = order[run[self.node_run]]  # a sampled place of each string
        # steps: the pairs of string and byte before it, by byte, are in the order of the strings that they lead to
        pairs, first, _ = _sorted((run_node * 257 + run_byte)[run_byte > 0].astype(np.uint64))
        pairs = pairs[first].astype(np.int64)
        self.step_byte = pairs % 257
        self.node_step = np.searchsorted(pairs // 257, np.arange(len(self.node_at) + 1))  # where each string's steps begin
        self.pairs = pairs
        by = np.argsort(self.step_byte.astype(np.uint16), kind="stable")
        place = self.node_at[pairs[by] // 257]
        # two pairs lead to one string if they agree in all but the last byte of theirs
        agree, close, byte = part[place], text[place + length - 2], self.step_byte[by]
        fresh = np.empty(len(by), bool)
        fresh[:1] = True
        fresh[1:] = (agree[1:] != agree[:-1]) | (close[1:] != close[:-1]) | (byte[1:] != byte[:-1])
        reached = np.zeros(len(self.node_at), bool)
        edge[:] = False
        edge[(starts + counts - 1)[counts > 0]] = True
        reached[node[~edge[order]]] = True
        self.target = np.empty(len(by), np.int64)
        self.target[by] = np.flatnonzero(reached)[np.cumsum(fresh) - 1]

    @staticmethod
    def _order(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ranks of the strings of two bytes less than `length` from each position on, by doubling; and the order of those of
        `length`, with where a new string begins in it."""
        n = len(text)
        used = np.flatnonzero(np.bincount(text, minlength=256))
        code = np.zeros(256, np.uint64)
        code[used] = np.arange(1, len(used) + 1)
        bits = len(used).bit_length()
        size = max(1, min(length - 2, (64 - max(1, (n - 1).bit_length())) // bits))
        wide = np.concatenate([code[text], np.zeros(length, np.uint64)])
        key = wide[:n].copy()
        for i in range(1, size):
            key <<= np.uint64(bits)
            key |= wide[i : i + n]
        del wide
        while True:
            _, fresh, order = _sorted(key)
            if size == length:
                return rank, fresh, order  # noqa: F821 (set in the round before)
            rank = _ranked(fresh, order)
            step = min(size, length - 2 - size) or 2
            key = rank.astype(np.uint64)
            key <<= np.uint64(max(1, n.bit_length()))
            key[: n - step] |= (rank[step:] + 1).astype(np.uint64)
            size += step

    def find(self, raw: bytes, at: np.ndarray) -> np.ndarray:
        """The string of the index that each string of raw at the places given equals; -1 where none does."""
        raw += bytes(16)
        n = len(raw) - 8
        own, other = (np.ndarray((len(x) - 8,), ">u8", x, 0, (1,)) for x in (self.raw, raw))
        offsets = [*range(0, self.length - 7, 8), *([self.length - 8] if self.length % 8 else [])]
        low, high = np.zeros(len(at), np.int64), np.full(len(at), len(self.node_at))
        assert n > 0

        def compare(node: np.ndarray, lanes: np.ndarray) -> np.ndarray:
            """-1, 0 or 1: the indexed string against the one sought."""
            out = np.zeros(len(lanes), np.int8)
            left = np.arange(len(lanes))
            for o in offsets:
                a, b = own[self.node_at[node[left]] + o], other[at[lanes[left]] + o]
                out[left[a < b]], out[left[a > b]] = -1, 1
                left = left[a == b]
                if not len(left):
                    break
            return out

        lanes = np.flatnonzero(low < high)
        while len(lanes):
            mid = (low[lanes] + high[lanes]) // 2
            less = compare(mid, lanes) < 0
            low[lanes[less]] = mid[less] + 1
            high[lanes[~less]] = mid[~less]
            lanes = lanes[low[lanes] < high[lanes]]
        found = np.where(low < len(self.node_at), low, 0)
        same = compare(found, np.arange(len(at))) == 0 if len(self.node_at) else np.zeros(len(at), bool)
        return np.where(same, found, -1)

    def stream(self, raw: bytes, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """For each string of the stretches given, in their order, the smallest document that holds it; LAST_ID: none.

        All stretches are read side by side from their ends; a string that no step leads to is sought anew.
        """
        text = np.frombuffer(raw, np.uint8)
        base = np.cumsum(counts) - counts
        out = np.full(int(counts.sum()), LAST_ID)
        lanes = np.argsort(-counts, kind="stable")
        on = np.searchsorted(-counts[lanes], -np.arange(int(counts.max(initial=0))), "left")
        node = self.find(raw, (starts + counts - 1)[lanes[: on[0]]]) if len(on) else None
        for t, n in enumerate(on):
            own = lanes[:n]
            place = starts[own] + counts[own] - 1 - t
            if t:
                node, byte = node[:n], text[place].astype(np.int64) + 1
                # most strings have one step
                at = self.node_step[node]
                met = (node >= 0) & (at < self.node_step[node + 1])
                at[~met] = 0
                met &= self.step_byte[at] == byte if len(self.pairs) else False
                rest = np.flatnonzero(~met & (node >= 0))
                if len(rest):
                    key = node[rest] * 257 + byte[rest]
                    other = np.minimum(np.searchsorted(self.pairs, key), max(0, len(self.pairs) - 1))
                    good = self.pairs[other] == key if len(self.pairs) else np.zeros(len(rest), bool)
                    at[rest[good]], met[rest[good]] = other[good], True
                node = np.where(met, self.target[at], -1) if len(self.pairs) else np.full(n, -1)
                if not met.all():
                    node[~met] = self.find(raw, place[~met])
            hit = node >= 0
            out[base[own[hit]] + counts[own[hit]] - 1 - t] = self.run_doc[self.node_run[node[hit]]]
        return out


def to_blocks(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """block, size (bytes of text), data: whole documents, in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        ids, parts, size = [], [], 0

        def done() -> tuple:
            none = np.array([i is None for i in ids], np.uint8)
            return size, pack(3, id=np.array([LAST_ID if i is None else i for i in ids], np.int64), none=none, size=np.fromiter(map(len, parts), np.int64, len(parts)), text=np.frombuffer(b"".join(parts), np.uint8))

        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), texts(b), strict=True):
                ids.append(i)
                parts.append(t)
                size += len(t)
                if size >= block or len(ids) >= 1 << 16:
                    yield done()
                    ids, parts, size = [], [], 0
        if ids:
            yield done()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = map_rows(rows, run, "size long, data binary", lambda r: len(r[1]))
    return scratch.table(made.withColumn("block", F.monotonically_increasing_id()), "blocks")


class Marks:
    """The stretches of a block with their markers, dealt to buckets."""

    def __init__(self, data: bytes, buckets: int, length: int):
        x = unpack(data)
        self.id, self.none, self.size, self.raw = x["id"], x["none"], x["size"], x["text"].tobytes()
        self.start, self.count, mark, self.doc, self.place = stretches(self.raw, self.size, length)
        self.mark = (mark * _MIX[0]) >> np.uint64(18)  # least hashes crowd near zero, so their bits are mixed anew
        ranked, fresh, self.by = _sorted(self.mark)
        self.distinct, self.first, self.inverse = ranked[fresh], np.flatnonzero(fresh), _ranked(fresh, self.by)
        bucket = (self.distinct % np.uint64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int64)
        self.order = np.argsort(bucket, kind="stable")
        self.edges = np.searchsorted(bucket[self.order], np.arange(buckets + 1))

    def several(self) -> np.ndarray:
        """Which markers stand in more than one document of the block."""
        doc = self.doc[self.by]
        return doc[self.first] != doc[np.append(self.first[1:], len(doc)) - 1] if len(doc) else np.zeros(0, bool)

    def bucket(self, i: int) -> np.ndarray:
        """The places of a bucket's markers among the distinct ones, ascending."""
        return self.order[self.edges[i] : self.edges[i + 1]]


def shared_markers(blocks: DataFrame, buckets: int, length: int, hot: int) -> DataFrame:
    """block, bucket, n, data: for each block's markers of a bucket 0, or 1 where several documents have it, or 2 where more than `hot` blocks have it."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for block, data in zip(b.column("block").to_pylist(), b.column("data"), strict=True):
                m = Marks(data.as_py(), buckets, length)
                several = m.several()
                for i in range(buckets):
                    own = m.bucket(i)
                    if len(own):
                        step = np.diff(m.distinct[own], prepend=np.uint64(0))
                        yield block, i, pack(1, step=step.view(np.uint8).reshape(-1, 8).T.ravel(), several=np.packbits(several[own]))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        def done() -> Iterator[tuple]:
            parts = [unpack(d) for _, d in held]
            marks = [np.cumsum(np.ascontiguousarray(p["step"].reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64) for p in parts]
            found, inverse, times = np.unique(np.concatenate(marks), return_inverse=True, return_counts=True)
            flag = (times > 1).astype(np.uint8)
            flag[inverse[np.concatenate([np.unpackbits(p["several"], count=len(m)) for p, m in zip(parts, marks, strict=True)]) > 0]] = 1
            flag[times > hot] = 2
            at = 0
            for (block, _), m in zip(held, marks, strict=True):
                own = flag[inverse[at : at + len(m)]]
                at += len(m)
                yield block, now, int((own > 0).sum()), pack(3, flag=own)

        now, held = None, []
        for b in batches:
            for block, bucket, data in zip(b.column("block").to_pylist(), b.column("bucket").to_pylist(), b.column("data"), strict=True):
                if bucket != now and held:
                    yield from done()
                    held = []
                now = bucket
                held.append((block, data.as_py()))
        if held:
            yield from done()

    weigh = lambda r: len(r[-1])
    sent = map_rows(blocks.select("block", "data"), send, "block long, bucket int, data binary", weigh)
    met = sent.repartition("bucket").sortWithinPartitions("bucket")
    return scratch.table(map_rows(met, meet, "block long, bucket int, n long, data binary", weigh), "flags")


class Plan:
    """A block's stretches that may repeat, by their distinct texts; the same whenever it is made anew."""

    def __init__(self, data: bytes, flags: list[tuple[int, bytes]], mark_buckets: int, buckets: int, length: int):
        m = self.marks = Marks(data, mark_buckets, length)
        flag = np.zeros(len(m.distinct), np.uint8)
        for i, f in flags:
            flag[m.bucket(i)] = unpack(f)["flag"]
        flag = flag[m.inverse]
        use = np.flatnonzero(flag > 0)
        start, count, key, doc = m.start[use], m.count[use], m.mark[use], m.doc[use]
        if (flag == 2).any():
            start, count, key, doc = self._split(m, start, count, key, doc, flag[use] == 2, length)
        if (count > _LONGEST).any():
            pieces = -(-count // _LONGEST)
            nth = spread(np.zeros(len(count), np.int64), pieces)
            start, key, doc, rest = np.repeat(start, pieces) + nth * _LONGEST, np.repeat(key, pieces), np.repeat(doc, pieces), np.repeat(count, pieces) - nth * _LONGEST
            count = np.minimum(rest, _LONGEST)
        self.start, self.count, self.doc = start, count, doc
        raw, met = m.raw, {}
        self.which = np.fromiter((met.setdefault(raw[a:b], len(met)) for a, b in zip(start.tolist(), (start + count + length - 1).tolist(), strict=True)), np.int64, len(start))
        self.distinct = list(met)
        by = np.argsort(self.which, kind="stable")
        first = np.flatnonzero(np.diff(self.which[by], prepend=-1))
        self.least = np.minimum.reduceat(m.id[doc][by], first) if len(first) else np.zeros(0, np.int64)
        self.strings = count[by][first]
        mixed = (key[by][first] * _MIX[1]) >> np.uint64(20)
        bucket, self.key = mixed % np.uint64(buckets), (mixed >> np.uint64(12)).astype(np.uint32)
        self.order = np.argsort(bucket, kind="stable")
        self.buckets, edges = np.unique(bucket[self.order], return_index=True)
        self.edges = np.append(edges, len(bucket))

    @staticmethod
    def _split(m: Marks, start: np.ndarray, count: np.ndarray, key: np.ndarray, doc: np.ndarray, hot: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
        """Hot stretches in two: strings that begin close to the piece, whose key takes in what follows it, and those that do not."""
        side = (length - PIECE) // 2
        text = np.concatenate([np.frombuffer(m.raw, np.uint8), np.zeros(length, np.uint8)])
        at = spread(start[hot], count[hot])
        owner = np.repeat(np.flatnonzero(hot), count[hot])
        place = m.place[at].astype(np.int64)
        far = place - at > side
        more = key[owner].copy()
        for i in range(side):
            more = (more ^ text[np.where(far, place - side, place + PIECE) + i]) * _MIX[1]
            more ^= more >> np.uint64(29)
        first = np.flatnonzero(np.concatenate(([True], (more[1:] != more[:-1]) | (far[1:] != far[:-1]) | (owner[1:] != owner[:-1])))[: len(at)])
        parts = ((start, at[first]), (count, np.diff(np.append(first, len(at)))), (key, more[first]), (doc, doc[owner[first]]))
        return tuple(np.concatenate([a[~hot], b]) for a, b in parts)

    def packets(self, length: int) -> Iterator[tuple[int, bytes]]:
        """Each bucket with its stretches, and last, under -1, what the block needs to know again when the answers come."""
        for i, bucket in enumerate(self.buckets.tolist()):
            own = self.order[self.edges[i] : self.edges[i + 1]]
            body = np.frombuffer(b"".join([self.distinct[j] for j in own]), np.uint8)
            yield bucket, pack(3, key=self.key[own], least=self.least[own], count=self.strings[own].astype(np.int32), text=body)
        small = lambda x: np.diff(x, prepend=0).astype(np.int32)
        yield -1, pack(3, start=small(self.start), doc=small(self.doc), which=self.which.astype(np.int32), order=self.order.astype(np.int32), buckets=self.buckets.astype(np.int64), edges=small(self.edges), least=self.least, strings=self.strings.astype(np.int32))


def _answer(parts: list[dict[str, np.ndarray]], length: int) -> Iterator[bytes]:
    """For each block's stretches of a bucket, what is the smallest document of each string: by segments of one document, none where it is the one told."""
    met: dict[bytes, int] = {}
    which, least, key = [], np.concatenate([p["least"] for p in parts]), np.concatenate([p["key"] for p in parts])
    for p in parts:
        raw = p["text"].tobytes()
        ends = np.cumsum(p["count"] + length - 1).tolist()
        which += [met.setdefault(raw[a:b], len(met)) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    which = np.array(which)
    low = np.full(len(met), LAST_ID)
    np.minimum.at(low, which, least)
    keys = np.empty(len(met), np.uint32)
    keys[which] = key
    # equal strings have equal keys, so the only text of a key shares its strings with no other
    _, group, size = np.unique(keys, return_inverse=True, return_counts=True)
    several = np.flatnonzero(size[group] > 1)
    order = several[np.argsort(low[several], kind="stable")]
    segments, offset, doc = np.ones(len(met), np.int64), np.zeros(len(met), np.int32), low
    begin = np.arange(len(met))
    if len(order):
        distinct = list(met)
        chosen = [distinct[i] for i in order]
        del distinct
        sizes = np.fromiter(map(len, chosen), np.int64, len(chosen))
        raw = b"".join(chosen)
        starts, counts = np.cumsum(sizes) - sizes, sizes - length + 1
        early = RunIndex(raw, starts, counts, low[order], length).stream(raw, starts, counts)
        first = np.cumsum(counts) - counts
        fresh = np.concatenate(([True], early[1:] != early[:-1]))
        fresh[first] = True
        at = np.flatnonzero(fresh)
        many = np.diff(np.append(np.searchsorted(at, first), len(at)))
        segments[order] = many
        begin[order] = len(met) + np.cumsum(many) - many
        offset = np.concatenate([offset, (at - np.repeat(first, many)).astype(np.int32)])
        doc = np.concatenate([doc, early[at]])
    del met
    done = 0
    for p in parts:
        own = which[done : done + len(p["count"])]
        done += len(p["count"])
        n = np.where((segments[own] == 1) & (doc[begin[own]] == p["least"]), 0, segments[own])
        take = spread(begin[own], n)
        yield pack(1, n=n.astype(np.int32), offset=offset[take], doc=doc[take])


def _removed(id_: np.ndarray, sizes: np.ndarray, answers: list[tuple[int, bytes]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """document (its place in the block), start and end of the maximal runs of bytes to be cut."""
    told = {bucket: unpack(data) for bucket, data in answers}
    none = np.zeros(0, np.int64)
    if -1 not in told:
        return none, none, none
    plan = told[-1]
    start, doc_of, which, strings, edges = np.cumsum(plan["start"], dtype=np.int64), np.cumsum(plan["doc"], dtype=np.int64), plan["which"].astype(np.int64), plan["strings"].astype(np.int64), np.cumsum(plan["edges"], dtype=np.int64)
    n = np.ones(len(strings), np.int64)
    parts = []
    for i, bucket in enumerate(plan["buckets"].tolist()):
        x, own = told[bucket], plan["order"][edges[i] : edges[i + 1]].astype(np.int64)
        n[own] = np.maximum(x["n"], 1)
        parts.append((own, x))
    begin = np.cumsum(n) - n
    offset, doc = np.zeros(int(n.sum()), np.int64), np.repeat(plan["least"], n)
    for own, x in parts:
        at = spread(begin[own], x["n"])
        offset[at], doc[at] = x["offset"], x["doc"]
    size = np.append(offset[1:], 0)
    size[begin + n - 1] = strings
    size -= offset
    mine = np.repeat(np.arange(len(which)), n[which])
    seg = spread(begin[which], n[which])
    hit = doc[seg] < id_[doc_of[mine]]
    mine, seg = mine[hit], seg[hit]
    owner = doc_of[mine]
    # documents are set one byte apart, so that runs of neighbours do not join
    a = start[mine] + offset[seg] + owner
    e = a + size[seg] + length - 1
    by = np.argsort(a, kind="stable")
    a, e, owner = a[by], np.maximum.accumulate(e[by]), owner[by]
    fresh = np.concatenate(([True], a[1:] > e[:-1]))[: len(a)]
    first = np.flatnonzero(fresh)
    owner = owner[first]
    base = (np.cumsum(sizes) - sizes)[owner] + owner
    return owner, a[first] - base, e[np.append(first[1:], len(a))[: len(first)] - 1] - base


def cut_repeats(docs: DataFrame, length: int = LENGTH, block: int = BLOCK, hot: int = 4096) -> DataFrame:
    """doc_id, n_bytes, removed (array of start, end in bytes) and kept (the remaining bytes) of every row."""
    if length < PIECE + 8:
        raise ValueError(f"length is {PIECE + 8} at least")
    blocks = to_blocks(docs, block)
    least = scratch.partitions(docs.sparkSession)
    total = blocks.agg(F.sum("size")).first()[0] or 0
    mark_buckets = max(least, -(-total // MARKS))
    flags = shared_markers(blocks, mark_buckets, length, hot)
    buckets = max(least, -(-(flags.agg(F.sum("n")).first()[0] or 0) * _AVERAGE // STRETCHES))
    told = flags.groupBy("block").agg(F.collect_list(F.struct("bucket", "data")).alias("flags"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for block_, data, f in zip(b.column("block").to_pylist(), b.column("data"), b.column("flags"), strict=True):
                plan = Plan(data.as_py(), [(x["bucket"], x["data"]) for x in f.as_py() or []], mark_buckets, buckets, length)
                if len(plan.which):
                    yield from ((block_, bucket, made) for bucket, made in plan.packets(length))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        def done() -> Iterator[tuple]:
            for (block_, _), made in zip(held, _answer([unpack(d) for _, d in held], length), strict=True):
                yield block_, now, made

        now, held = None, []
        for b in batches:
            for block_, bucket, data in zip(b.column("block").to_pylist(), b.column("bucket").to_pylist(), b.column("data"), strict=True):
                if bucket < 0:
                    yield block_, bucket, data.as_py()
                    continue
                if bucket != now and held:
                    yield from done()
                    held = []
                now = bucket
                held.append((block_, data.as_py()))
        if held:
            yield from done()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for data, found in zip(b.column("data"), b.column("answers"), strict=True):
                x = unpack(data.as_py())
                sizes, raw = x["size"], x["text"].tobytes()
                owner, start, end = _removed(x["id"], sizes, [(y["bucket"], y["data"]) for y in found.as_py() or []], length)
                base = np.cumsum(sizes) - sizes
                edges = np.searchsorted(owner, np.arange(len(sizes) + 1))
                for i, (doc_id, none, size) in enumerate(zip(x["id"].tolist(), x["none"].tolist(), sizes.tolist(), strict=True)):
                    own = slice(edges[i], edges[i + 1])
                    spans = list(zip(start[own].tolist(), end[own].tolist(), strict=True))
                    text = raw[base[i] : base[i] + size]
                    kept, at = [], 0
                    for a, e in spans:
                        kept.append(text[at:a])
                        at = e
                    kept.append(text[at:])
                    yield None if none else doc_id, size, [{"start": a, "end": e} for a, e in spans], b"".join(kept)

    weigh = lambda r: len(r[-1]) + 64
    whole = blocks.select("block", "data")
    salted = F.when(F.col("bucket") < 0, F.col("block")).otherwise(F.lit(0))  # what only passes through is spread by block
    sent = map_rows(whole.join(told, "block", "left"), send, "block long, bucket long, data binary", weigh)
    sent = sent.withColumn("salt", salted).repartition("bucket", "salt").sortWithinPartitions("bucket").drop("salt")
    answers = scratch.table(map_rows(sent, meet, "block long, bucket long, data binary", weigh), "answers")
    answers = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "data")).alias("answers"))
    return map_rows(whole.join(answers, "block", "left").select("data", "answers"), cut, "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary", weigh)


def repeat_digests(docs: DataFrame) -> DataFrame:
    out = cut_repeats(docs)
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
