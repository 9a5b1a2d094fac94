"""A hidden Markov language model, trained on the whole corpus and scored exactly.

A word is drawn in two steps: a latent state emits a word class (a hash of the word's beginning and ending, so that
their number is fixed), and the class emits the word by its smoothed count. So the part that Baum-Welch re-estimates
(states x classes) is small and fixed, while word counts, which grow with the corpus, stay distributed: text blocks are
encoded once, the distinct words of a block meet those of other blocks by hash, in buckets of bounded size, and the counts
go back to the block. Expected counts are summed in every partition, then across partitions. Scoring runs the scaled
forward recursion over whole documents. The probabilities of all texts sum to one: each class holds one unseen word.

E-steps are exact over whole documents, too. Long ones are taken in segments side by side: the product of a segment's steps,
a matrix of states, carries the forward and the backward messages over its edges, and transitions over an edge count like all
others. Training starts from clusters of the classes by what stands near them. That count, every pass and every other count
take in all training documents.

Defined results: null and empty texts are one end token; a null doc_id counts as training; repeated rows count as often
as they stand; without training documents all words are unseen.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import scratch
from tessella.llm.arrow import map_rows, pack, texts, unpack

STATES, CLASSES, BLOCK, SEGMENT, PASSES = 8, 1 << 12, 1 << 20, 512, 3
END = b""


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def word_class(word: bytes, classes: int = CLASSES) -> int:
    """0 for the end token, else by the first and last three bytes."""
    return 1 + xxhash.xxh32_intdigest(word[:3] + b"\0" + word[-3:]) % (classes - 1) if word else 0


def encode(docs: DataFrame, block: int = BLOCK, classes: int = CLASSES) -> DataFrame:
    """Blocks of the corpus, in the shared folder: documents as runs of word numbers, and the block's distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        ids: list = []
        known: dict[bytes, int] = {END: 0}
        words, sizes = array("i"), []

        def done() -> tuple:
            told = np.frombuffer(words, np.int32)
            size = np.array(sizes, np.int32)
            held = np.array([held_out(i) for i in ids], np.uint8)
            count = np.bincount(told[np.repeat(held == 0, size)], minlength=len(known)).astype(np.uint32)
            word = np.fromiter((xxhash.xxh64_intdigest(w) for w in known), np.uint64, len(known))
            kind = np.fromiter((word_class(w, classes) for w in known), np.uint16, len(known))
            none = np.array([i is None for i in ids], np.uint8)
            return len(told), len(known), pack(id=np.array([i or 0 for i in ids], np.int64), none=none, held=held, size=size, token=told, word=word, kind=kind, count=count)

        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), texts(b), strict=True):
                before = len(words)
                words.extend([known.setdefault(w, len(known)) for w in t.lower().split()])
                words.append(0)
                sizes.append(len(words) - before)
                ids.append(i)
                if len(words) >= block:
                    yield done()
                    ids, known, words, sizes = [], {END: 0}, array("i"), []
        if ids:
            yield done()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = map_rows(rows, run, "size long, words long, data binary", lambda r: len(r[2]))
    return scratch.table(made.withColumn("block", F.monotonically_increasing_id()), "blocks")


class Counts(NamedTuple):
    tokens: int
    words: int
    by_class: np.ndarray  # tokens
    of_class: np.ndarray  # distinct words


def _summed(parts: DataFrame, slices: int = 32) -> np.ndarray | None:
    """The sum of the arrays that the rows (slice, data: float64) of all tasks make up; slice by slice, the driver gets one of each."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, data in zip(b.column("slice").to_pylist(), b.column("data"), strict=True):
                x = np.frombuffer(data.as_py())
                sums[i] = sums[i] + x if i in sums else x
        for i, x in sums.items():
            yield i, x.tobytes()

    got = map_rows(parts.repartition(slices, "slice"), add, "slice int, data binary").collect()
    return np.concatenate([np.frombuffer(r.data) for r in sorted(got)]) if got else None


def _sliced(total: np.ndarray, slices: int = 32) -> Iterator[tuple]:
    for i, piece in enumerate(np.array_split(total.astype(np.float64), slices)):
        yield i, piece.tobytes()


def count_words(blocks: DataFrame, classes: int = CLASSES, most: int = 1 << 20) -> tuple[Counts, DataFrame]:
    """Sums over the corpus, and for each block and bucket the corpus counts of the block's words there.

    Words are dealt to buckets by hash; their number follows the blocks' distinct words, some `most` of which meet in one.
    """
    total = blocks.agg(F.sum("words")).first()[0] or 0
    buckets = max(scratch.partitions(blocks.sparkSession), -(-total // most))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for block, data in zip(b.column("block").to_pylist(), b.column("data"), strict=True):
                x = unpack(data.as_py())
                bucket = (x["word"] % np.uint64(buckets)).astype(np.int64)
                by = np.lexsort((x["word"], bucket))
                cuts = np.flatnonzero(np.diff(bucket[by], prepend=-1))
                for a, e in zip(cuts, [*cuts[1:], len(by)], strict=True):
                    own = by[a:e]
                    yield block, int(bucket[own[0]]), pack(place=own.astype(np.int32), word=x["word"][own], kind=x["kind"][own], count=x["count"][own])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, held, tokens, words = None, [], np.zeros(classes), np.zeros(classes)

        def done() -> Iterator[tuple]:
            parts = [unpack(d) for _, d in held]
            word, first, inverse = np.unique(np.concatenate([p["word"] for p in parts]), return_index=True, return_inverse=True)
            count = np.bincount(inverse, weights=np.concatenate([p["count"] for p in parts]), minlength=len(word)).astype(np.int64)
            kind = np.concatenate([p["kind"] for p in parts])[first]
            tokens[:] += np.bincount(kind, weights=count, minlength=classes)
            words[:] += np.bincount(kind, weights=count > 0, minlength=classes)
            at = 0
            for (block, _), p in zip(held, parts, strict=True):
                n = len(p["word"])
                yield block, None, pack(place=p["place"], count=count[inverse[at : at + n]])
                at += n

        for b in batches:
            for block, bucket, data in zip(b.column("block").to_pylist(), b.column("bucket").to_pylist(), b.column("data"), strict=True):
                if bucket != now and held:
                    yield from done()
                    held = []
                now = bucket
                held.append((block, data.as_py()))
        if held:
            yield from done()
            for i, data in _sliced(np.concatenate([tokens, words])):
                yield None, i, data

    weigh = lambda r: len(r[2])
    sent = map_rows(blocks.select("block", "data"), send, "block long, bucket long, data binary", weigh).repartition("bucket").sortWithinPartitions("bucket")
    met = scratch.table(map_rows(sent, meet, "block long, slice int, data binary", weigh), "counts")
    sums = _summed(met.where("slice is not null").select("slice", "data"))
    by_class, of_class = (np.zeros(classes, np.int64),) * 2 if sums is None else sums.astype(np.int64).reshape(2, classes)
    return Counts(int(by_class.sum()), int(of_class.sum()), by_class, of_class), met.where("slice is null").select("block", "data")


class Model(NamedTuple):
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # classes x states


class Expected(NamedTuple):
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def _steps(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences from long to short, and how many are still on at each step."""
    order = np.argsort(-sizes, kind="stable")
    return order, np.searchsorted(-sizes[order], -np.arange(int(sizes.max())), "left")


def _groups(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Neighbouring sequences of some `most` words together: from, to."""
    ends, i = np.cumsum(sizes), 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j


def _emitted(model: Model, kinds: np.ndarray) -> np.ndarray:
    e = model.emit[kinds]
    return e / e.max(axis=1, keepdims=True)


def _edges(model: Model, kinds: np.ndarray, sizes: np.ndarray, opens: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each sequence, where one that does not open a document goes on from the one before it: the normed forward message
    before its first step, the state probabilities at that step, and the backward message after its last one."""
    k, n = len(model.start), len(sizes)
    before, prior, behind = np.zeros((n, k)), np.repeat(model.start[None], n, axis=0), np.ones((n, k))
    part = np.flatnonzero(~opens | np.append(~opens[1:], False))
    if not len(part):
        return before, prior, behind
    whole, begin = np.zeros((n, k, k)), np.cumsum(sizes) - sizes
    for i, j in _groups(sizes[part], most):
        own = part[i:j]
        order, on = _steps(sizes[own])
        first = begin[own][order]
        product = np.zeros((len(own), k, k))
        product[:, np.arange(k), np.arange(k)] = _emitted(model, kinds[first])
        for t, m in enumerate(on):
            if t:
                x = (product[:m].reshape(-1, k) @ model.move).reshape(m, k, k) * _emitted(model, kinds[first[:m] + t])[:, None]
                product[:m] = x / x.max(axis=(1, 2), keepdims=True)
        whole[own[order]] = product
    # the nth segments of all documents side by side
    starts = np.flatnonzero(opens)
    nth = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    by = np.argsort(nth, kind="stable")
    waves = np.split(by, np.flatnonzero(np.diff(nth[by])) + 1)
    for own in waves[1:]:
        a = np.einsum("ni,nij->nj", prior[own - 1], whole[own - 1])
        before[own] = a / a.sum(axis=1, keepdims=True)
        prior[own] = before[own] @ model.move
    for own in reversed(waves[1:]):
        b = np.einsum("nij,nj->ni", whole[own], behind[own]) @ model.move.T
        behind[own - 1] = b / b.max(axis=1, keepdims=True)
    return before, prior, behind


def expect(model: Model, kinds: np.ndarray, sizes: np.ndarray, opens: np.ndarray, most: int = 1 << 18) -> Expected:
    """One exact E-step over sequences that stand one after another; those that do not open a document go on from the one before.

    Some `most` words are held at a time, however long a document is.
    """
    before, prior, behind = _edges(model, kinds, sizes, opens, most)
    ends, total = np.cumsum(sizes), None
    for i, j in _groups(sizes, most):
        x = _expect(model, kinds[ends[i] - sizes[i] : ends[j - 1]], sizes[i:j], opens[i:j], before[i:j], prior[i:j], behind[i:j])
        total = x if total is None else Expected(*(p + q for p, q in zip(total, x, strict=True)))
    return total


def _expect(model: Model, kinds: np.ndarray, sizes: np.ndarray, opens: np.ndarray, before: np.ndarray, prior: np.ndarray, behind: np.ndarray) -> Expected:
    k = len(model.start)
    order, on = _steps(sizes)
    first = (np.cumsum(sizes) - sizes)[order]
    e = _emitted(model, kinds)
    alpha, scale = np.empty((len(kinds), k)), np.empty(len(kinds))
    a = prior[order] * e[first]
    for t, n in enumerate(on):
        at = first[:n] + t
        if t:
            a = (a[:n] @ model.move) * e[at]
        s = a.sum(axis=1)
        a = a / s[:, None]
        alpha[at], scale[at] = a, s
    move = np.zeros((k, k))
    b = behind[order]
    b /= (b * alpha[first + sizes[order] - 1]).sum(axis=1, keepdims=True)
    for t in range(len(on) - 1, 0, -1):
        n = on[t]
        at = first[:n] + t
        came = e[at] * b[:n] / scale[at][:, None]
        move += alpha[at - 1].T @ came
        alpha[at] *= b[:n]
        b[:n] = came @ model.move.T
    on_ = ~opens[order]
    move += before[order][on_].T @ (e[first] * b / scale[first][:, None])[on_]
    alpha[first] *= b
    alpha /= alpha.sum(axis=1, keepdims=True)
    emit = np.stack([np.bincount(kinds, weights=alpha[:, i], minlength=len(model.emit)) for i in range(k)], axis=1)
    return Expected(alpha[first][opens[order]].sum(axis=0), move * model.move, emit)


def maximize(x: Expected, prior: np.ndarray, weight: float = 1000.0) -> Model:
    """The M-step; emissions are drawn to the classes' shares in the corpus by `weight` tokens."""
    start = x.start + 0.1
    move = x.move + 0.1 + np.eye(len(start))
    emit = (x.emit + weight * prior[:, None]) / (x.emit.sum(axis=0) + weight)
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit)


def _training(x: dict[str, np.ndarray], segment: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """The training documents of a block as class sequences in segments, and which of them open a document."""
    keep = np.repeat(x["held"] == 0, x["size"])
    kinds = x["kind"][x["token"][keep]]
    size = x["size"][x["held"] == 0].astype(np.int64)
    if not len(size):
        return None
    parts = -(-size // segment)
    cut = np.full(parts.sum(), segment)
    last = np.cumsum(parts) - 1
    cut[last] = size - segment * (parts - 1)
    opens = np.zeros(len(cut), bool)
    opens[last - parts + 1] = True
    return kinds, cut, opens


def contexts(blocks: DataFrame, classes: int, width: int = 64, reach: int = 8) -> np.ndarray | None:
    """For each class how often classes of each of `width` groups stand within `reach` tokens of it, in all training documents."""
    group = np.random.default_rng(5).permutation(classes) % width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        total = np.zeros(classes * width, np.int64)
        for b in batches:
            for data in b.column("data"):
                if (part := _training(unpack(data.as_py()), 1 << 30)) is not None:
                    kinds, sizes, _ = part
                    kinds, doc = kinds.astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)
                    for lag in range(1, reach + 1):
                        same = doc[lag:] == doc[:-lag]
                        x, y = kinds[:-lag][same], kinds[lag:][same]
                        total += np.bincount(x * width + group[y], minlength=len(total))
                        total += np.bincount(y * width + group[x], minlength=len(total))
        if total.any():
            yield from _sliced(total)

    flat = _summed(map_rows(blocks.select("data"), run, "slice int, data binary"))
    return None if flat is None else flat.reshape(classes, width)


def apart(model: Model) -> float:
    """How far the states' emissions are from their mean, on average (half the sum of absolute differences); 0 if all are equal."""
    return float(np.abs(model.emit - model.emit.mean(axis=1, keepdims=True)).sum(axis=0).mean() / 2)


def begin(near: np.ndarray | None, prior: np.ndarray, states: int, rounds: int = 50, pull: float = 50.0, other: float = 0.02) -> Model:
    """A starting point from the contexts of all classes: k-means of their shares (square roots, weighted by counts), a state for
    each cluster, which emits the classes of the others at `other` times their share."""
    rng = np.random.default_rng(7)
    like = rng.gamma(4.0, 0.25, (len(prior), states))
    if near is not None:
        size = near.sum(axis=1)
        x = np.sqrt((near + pull * near.sum(axis=0) / size.sum()) / (size + pull)[:, None])
        # drawn far apart; the mean stands in front of the first
        far, at = np.full(len(x), np.inf), np.repeat(np.average(x, axis=0, weights=size)[None], states + 1, axis=0)
        for i in range(states):
            far = np.minimum(far, ((x - at[i]) ** 2).sum(axis=1))
            if (p := size * far).any():
                at[i + 1] = x[rng.choice(len(x), p=p / p.sum())]
        at = at[1:]
        for _ in range(rounds):
            own = ((x[:, None] - at) ** 2).sum(axis=2).argmin(axis=1)
            for i in range(states):
                if size[own == i].any():
                    at[i] = np.average(x[own == i], axis=0, weights=size[own == i])
        like = np.where(own[:, None] == np.arange(states), 1.0, other) * (0.9 + 0.1 * like)
    emit = prior[:, None] * like
    stay = 0.98
    move = np.full((states, states), (1 - stay) / (states - 1)) + np.eye(states) * (stay - (1 - stay) / (states - 1))
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def train(blocks: DataFrame, counts: Counts, states: int = STATES, passes: int = PASSES, segment: int = SEGMENT) -> Model:
    """Baum-Welch over all training documents, from a start that all of them make."""
    classes = len(counts.by_class)
    prior = (counts.by_class + 0.5) / (counts.tokens + 0.5 * classes)
    if not counts.tokens:
        return Model(np.full(states, 1 / states), np.full((states, states), 1 / states), np.repeat(prior[:, None], states, axis=1))
    model = begin(contexts(blocks, classes), prior, states)
    for _ in range(passes):

        def run(batches: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[tuple]:
            total = None
            for b in batches:
                for data in b.column("data"):
                    if (part := _training(unpack(data.as_py()), segment)) is not None:
                        x = expect(model, *part)
                        total = x if total is None else Expected(*(p + q for p, q in zip(total, x, strict=True)))
            if total is not None:
                yield from _sliced(np.concatenate([total.start, total.move.ravel(), total.emit.ravel()]))

        flat = _summed(map_rows(blocks.select("data"), run, "slice int, data binary"))  # states x classes numbers
        if flat is None:
            break
        x = Expected(flat[:states], flat[states : states + states**2].reshape(states, states), flat[states + states**2 :].reshape(classes, states))
        model = maximize(x, prior)
    return model


def forward(model: Model, kinds: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 likelihood of each whole sequence by the scaled forward recursion."""
    order, on = _steps(sizes)
    first = (np.cumsum(sizes) - sizes)[order]
    total = np.zeros(len(sizes))
    a = model.start * model.emit[kinds[first]]
    for t, n in enumerate(on):
        if t:
            a = (a[:n] @ model.move) * model.emit[kinds[first[:n] + t]]
        s = a.sum(axis=1)
        a = a / s[:, None]
        total[:n] += np.log10(s)
    out = np.empty(len(sizes))
    out[order] = total
    return out


def language_model(docs: DataFrame, states: int = STATES, passes: int = PASSES, block: int = BLOCK, classes: int = CLASSES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    blocks = encode(docs, block, classes)
    counts, words = count_words(blocks, classes)
    model = train(blocks, counts, states, passes)
    both = blocks.select("block", "data").join(words.groupBy("block").agg(F.collect_list("data").alias("counts")), "block")
    within = np.log10(counts.by_class + 0.5 * (counts.of_class + 1))
    whole = np.log10(counts.tokens + 0.5 * (counts.words + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for data, told in zip(b.column("data"), b.column("counts"), strict=True):
                x = unpack(data.as_py())
                count = np.zeros(len(x["word"]), np.int64)
                for part in told:
                    p = unpack(part.as_py())
                    count[p["place"]] = p["count"]
                first = np.cumsum(x["size"], dtype=np.int64) - x["size"]
                kinds = x["kind"][x["token"]]
                mass = np.add.reduceat(np.log10(count + 0.5)[x["token"]], first)
                known = np.add.reduceat((count > 0).astype(np.int64)[x["token"]], first)
                score = mass - np.add.reduceat(within[kinds], first) + forward(model, kinds, x["size"].astype(np.int64))
                base = mass - whole * x["size"]
                ids = [None if z else i for i, z in zip(x["id"].tolist(), x["none"].tolist(), strict=True)]
                yield from zip(ids, (x["held"] > 0).tolist(), x["size"].tolist(), known.tolist(), [counts.tokens] * len(ids), base.tolist(), score.tolist(), strict=True)

    return map_rows(both.select("data", "counts"), run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
