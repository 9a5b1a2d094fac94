"""Token counts by a finite-state transducer, compiled from a tokenizer's vocabulary and merges.

The last token of every prefix of a word decides how the word is cut: a token may follow another one if no merge of lower
rank would have joined them across their border, and of the tokens that end at a place exactly one may follow what stands
before it. So a state is what later bytes can still ask for: the longest tail that begins some token, with the last token
of the prefix up to each place in it, and how many tokens that prefix has less or more than the whole. A transition reads
one byte and is annotated with the tokens that it adds (below zero where a longer token takes up several); the last byte
of a word has transitions of its own, as word ends are symbols of their own in these vocabularies. States and transitions
are compiled from the tables when first met (the states are finite in number, most are never met), and are kept for the
life of the worker process.

White space ends every token, so white space leads back to the start. A chunk of a text that may be cut anywhere is a map
over states: the bytes up to its first white space run from whatever state it is entered in, the rest does not depend on
it. Maps compose associatively, so the chunks of a long text are put together pairwise, as in a parallel prefix scan.
Counts of whole units between white space are kept as composed transitions.

The words of a unit are found as the tokenizer's file says: its special strings first, then composition (NFC), lower case
by character, and its pattern of words. Only files of this kind (word ends, these steps) are taken; others raise.

Defined results: null and empty texts have no tokens.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessella.llm.arrow import map_rows, texts

CHUNK, ARCS, STATES = 1 << 16, 1 << 19, 1 << 19
_SPACE = frozenset(b" \t\n\r\x0b\x0c")
# What the tokenizer files' steps say, and their spaces beyond ASCII.
_STEPS = ["NFC", "Replace", "Lowercase"]
_CONTRACTED = "'s|'t|'re|'ve|'m|'ll|'d"
_PATTERN = _CONTRACTED + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WIDE_SPACE = "\\x09-\\x0D \\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
_WORD = regex.compile(_CONTRACTED + rf"|[\p{{L}}]+|[\p{{N}}]|[^{_WIDE_SPACE}\p{{L}}\p{{N}}]+")
_ASCII_WORD = re.compile((_CONTRACTED + r"|[a-z]+|[0-9]|[^\x09-\x0D a-z0-9]+").encode())


def _bytes_of() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Machine:
    """The transducer of words. Tokens are numbered by rank: single bytes first, then by the order of their merges."""

    def __init__(self, vocabulary: dict[str, int], merges: list, end: str):
        letter = _bytes_of()

        def spelled(token: str) -> tuple[bytes, bool]:
            last = token.endswith(end)
            return bytes(letter[c] for c in (token[: -len(end)] if last else token)), last

        single = {(bytes([b]), last) for b in range(256) for last in (False, True)}
        self.inner, self.final = {}, {}  # tokens within words, and at their ends
        self.half: list[tuple[int, int]] = []  # the two tokens that one was merged from, itself twice for a byte
        self.joined: dict[tuple[int, int], int] = {}
        for text, last in sorted(single):
            (self.final if last else self.inner)[text] = len(self.half)
            self.half.append((len(self.half),) * 2)
        known = {spelled(t) for t in vocabulary}
        for pair in merges:
            (a, ends_a), (b, ends_b) = (spelled(t) for t in (pair if isinstance(pair, list) else pair.split(" ")))
            table = self.final if ends_b else self.inner
            left, right = self.inner.get(a), table.get(b)
            if ends_a or left is None or right is None or a + b in table or (a + b, ends_b) not in known:
                raise ValueError(f"not a merge of tokens that came before: {pair}")
            self.joined[left, right] = table[a + b] = len(self.half)
            self.half.append((left, right))
        self.openings = {t[:i] for table in (self.inner, self.final) for t in table for i in range(1, len(t))}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.known: dict[tuple, int] = {}
        self.state: list[tuple[bytes, tuple[int, ...], tuple[int, ...]]] = []
        self.step: list[dict[int, tuple[int, int]]] = []
        self.last: list[dict[int, int]] = []
        self._intern(b"", (-1,), (0,))

    def _intern(self, tail: bytes, tokens: tuple[int, ...], counts: tuple[int, ...]) -> int:
        """The number of a state: its tail, and for each place in it from the left to the end the last token and the relative count."""
        key = tail, tokens, counts
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = len(self.state)
            self.state.append(key)
            self.step.append({})
            self.last.append({})
        return found

    def follows(self, a: int, b: int) -> bool:
        """Whether token b may stand behind token a: no merge over their border comes before those that made them."""
        if a < 0:
            return True
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) > 4 * STATES:
                self.pairs.clear()
            found = self.pairs[a, b] = self._apart(a, b)
        return found

    def _apart(self, a: int, b: int) -> bool:
        """Undoes the merges of both sides from the last to the first; the border must hold at every moment in between.

        At each moment the two tokens at the border are as they stood before some rank; a merge of them with a lower rank
        than the one that took either away from the border would have come first.
        """
        limit = len(self.half)
        while True:
            made = self.joined.get((a, b))
            if made is not None and made < limit:
                return False
            byte_a, byte_b = self.half[a][0] == a, self.half[b][0] == b
            if byte_a and byte_b:
                return True
            # the side that was merged later is undone first; of equal ranks the left pair is merged first, so the right is undone first
            if byte_b or (not byte_a and a > b):
                limit, a = a, self.half[a][1]
            else:
                limit, b = b + 1, self.half[b][0]

    def _token(self, state: int, byte: int, table: dict[bytes, int]) -> tuple[int, int]:
        """The token that ends with the byte, and the place in the state's tail where it begins."""
        tail, tokens, _ = self.state[state]
        text = tail + bytes([byte])
        for at in range(len(text)):
            if (t := table.get(text[at:])) is not None and self.follows(tokens[at], t) and self._whole(t):
                return t, at
        raise ValueError(f"no token ends at {text!r}")

    def _whole(self, t: int) -> bool:
        """Whether the token's own bytes come out as this token."""
        a, b = self.half[t]
        return a == t or self.follows_before(a, b, t)

    def follows_before(self, a: int, b: int, made: int) -> bool:
        """Whether both parts of a token come out whole and stay apart until their merge."""
        found = self.pairs.get((-2, made))
        if found is None:
            del self.joined[a, b]
            try:
                found = self._apart(a, b)
            finally:
                self.joined[a, b] = made
            found = self.pairs[-2, made] = found and self._whole(a) and self._whole(b)
        return found

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """Adds the transition by a byte within a word: the next state and the tokens added."""
        t, at = self._token(state, byte, self.inner)
        tail, tokens, counts = self.state[state]
        added = counts[at] + 1
        text = tail + bytes([byte])
        cut = next((i for i in range(len(text)) if text[i:] in self.openings), len(text))
        made = self._intern(text[cut:], (*tokens[cut:], t), tuple(c - added for c in (*counts[cut:], added)))
        self.step[state][byte] = made, added
        return made, added

    def compile_last(self, state: int, byte: int) -> int:
        """Adds the transition by the last byte of a word: the tokens added."""
        _, at = self._token(state, byte, self.final)
        added = self.last[state][byte] = self.state[state][2][at] + 1
        return added

    def count(self, word: bytes) -> int:
        if len(self.state) > STATES:
            self.clear()
        step, state, n = self.step, 0, 0
        for c in word[:-1]:
            try:
                state, added = step[state][c]
            except KeyError:
                state, added = self.compile(state, c)
            n += added
        added = self.last[state].get(word[-1])
        return n + (self.compile_last(state, word[-1]) if added is None else added)


class StateMap(NamedTuple):
    """What a chunk does. closed False: it has no white space, and runs from the state that it is entered in over all of head.
    Else: it runs over head, is then back at the start, adds count, and ends in the state after tail."""

    closed: bool
    head: bytes
    count: int
    tail: bytes


class Transducer:
    """Counts the tokens of units between ASCII white space. At most `arcs` composed transitions are held, then it starts anew."""

    def __init__(self, machine: Machine, special: list[str], arcs: int = ARCS):
        self.machine, self.limit, self.arcs = machine, arcs, {}
        self.special = re.compile(b"|".join(re.escape(s.encode()) for s in sorted(special, key=len, reverse=True))) if special else None

    @classmethod
    @lru_cache(maxsize=4)
    def load(cls, path: str) -> Transducer:
        """Reads a tokenizer file; once for each worker process."""
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        steps = told["normalizer"]["normalizers"]
        cuts = told["pre_tokenizer"]["pretokenizers"]
        model = told["model"]
        if [s["type"] for s in steps] != _STEPS or cuts[0]["pattern"] != {"Regex": _PATTERN} or cuts[1]["add_prefix_space"] or not model["end_of_word_suffix"] or model["continuing_subword_prefix"] or model["ignore_merges"] or any(t["normalized"] or t["single_word"] for t in told["added_tokens"]):
            raise ValueError(f"a tokenizer of another kind: {path}")
        return cls(Machine(model["vocab"], model["merges"], model["end_of_word_suffix"]), [t["content"] for t in told["added_tokens"]])

    def unit(self, unit: bytes) -> int:
        """Tokens of bytes without ASCII white space, by the machine."""
        if self.special is not None and b"<" in unit and (found := self.special.findall(unit)):
            return len(found) + sum(self.unit(x) for x in self.special.split(unit) if x)
        if unit.isascii():
            return sum(map(self.machine.count, _ASCII_WORD.findall(unit.lower())))
        text = unicodedata.normalize("NFC", unit.decode())
        text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()  # by character: no rule for a word's last letter
        return sum(self.machine.count(w.encode()) for w in _WORD.findall(text))

    def run(self, units: list[bytes]) -> int:
        try:
            return sum(map(self.arcs.__getitem__, units))
        except KeyError:
            if len(self.arcs) > self.limit:
                self.arcs.clear()
            self.arcs.update((u, self.unit(u)) for u in set(units).difference(self.arcs))
            return sum(map(self.arcs.__getitem__, units))

    def state_map(self, chunk: bytes) -> StateMap:
        units = chunk.split()
        if not units:
            return StateMap(bool(chunk), b"", 0, b"")
        head = b"" if chunk[0] in _SPACE else units[0]
        tail = b"" if chunk[-1] in _SPACE else units[-1]
        if len(units) == 1 and head and tail:
            return StateMap(False, head, 0, b"")
        return StateMap(True, head, self.run(units[bool(head) : len(units) - bool(tail)]), tail)

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        if not a.closed:
            return b._replace(head=a.head + b.head)
        if not b.closed:
            return a._replace(tail=a.tail + b.head)
        middle = a.tail + b.head
        return StateMap(True, a.head, a.count + b.count + (self.run([middle]) if middle else 0), b.tail)

    def count(self, text: bytes, chunk: int = CHUNK) -> int:
        """Tokens of a whole text; the maps of its chunks are composed pairwise."""
        if len(text) <= chunk:
            return self.run(text.split())
        maps = [self.state_map(text[i : i + chunk]) for i in range(0, len(text), chunk)]
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return self.run([u for u in (maps[0].head, maps[0].tail) if u]) + maps[0].count


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every text; one narrow pass.

    path: the tokenizer file, present on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        machine = Transducer.load(path)
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), texts(b), strict=True):
                n = machine.count(text)
                yield doc_id, len(text), n, n > limit

    return map_rows(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
