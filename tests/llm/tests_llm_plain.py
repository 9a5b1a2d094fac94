"""Plain versions that tests share."""

import re

import xxhash


def fingerprint(text, k):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def windows_hit(text, bench, width=13):
    """Words of the text and how many of them stand in a window of the benchmark."""
    d = _WORD.findall((text or "").encode().lower())
    wins = set()
    for b in bench:
        w = _WORD.findall((b or "").encode().lower())
        wins |= {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    hit = set()
    for n in {len(w) for w in wins}:
        for i in range(len(d) - n + 1):
            if tuple(d[i : i + n]) in wins:
                hit |= set(range(i, i + n))
    return len(d), len(hit)


def plain_targets(sizes, weights, budget, most):
    """Fills all sources by weight, clamps those that are above their limit, and shares the rest anew until none is."""
    out, free = {}, set(sizes)
    while free:
        rest = budget - sum(out.values())
        total = sum(weights[s] for s in free)
        over = {s for s in free if rest * weights[s] / total >= most * sizes[s]}
        if not over:
            return out | {s: rest * weights[s] / total for s in free}
        out |= {s: most * sizes[s] for s in over}
        free -= over
    return out


def plain_segments(scores):
    """Scores of all maximal scoring segments: positive tokens join those before them while both sides gain by it."""
    found, total = [], 0.0
    for v in scores:
        before, total = total, total + v
        if v <= 0:
            continue
        new = (before, total)
        while True:
            j = max((j for j, x in enumerate(found) if x[0] < new[0]), default=None)
            if j is None or found[j][1] >= new[1]:
                break
            new = (found[j][0], new[1])
            del found[j:]
        found.append(new)
    return [y - x for x, y in found]


def joined(n, links):
    """For each of n nodes the smallest that links join it to."""
    up = list(range(n))
    for a, b in links:
        a, b = (next(x for x in _above(up, i) if up[x] == x) for i in (a, b))
        up[max(a, b)] = min(a, b)
    return [next(x for x in _above(up, i) if up[x] == x) for i in range(n)]


def _above(up, i):
    while True:
        yield i
        i = up[i]
