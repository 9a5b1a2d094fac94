"""Format-preserving pseudonyms for personal data and secrets.

A finding is validated (card check digits, IBAN remainder, real dates, octets, telephone rules) and then mapped by a
keyed permutation of the valid values of its own format: its characters are a number in mixed radix, a Feistel network
over the next even power of two permutes it, and the walk goes on until the number is in range and the value valid
again (cycle walking). So equal values get equal pseudonyms in all documents, however they are punctuated, different
values different ones, and who has the key can go back.

Defined results: null text stays null with no findings; an empty text stays empty; text outside findings is untouched;
long texts are searched whole, line by line, in time in proportion to their length.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import warnings
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessella.llm.arrow import map_rows

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ROUNDS = 8
#: Domains up to this size are permuted by one keyed cycle through all valid values, larger ones by the Feistel network.
TABLE = 1024
#: The setting that holds the secret key; without it a public one is used, which hides nothing from readers of this file.
KEY_SETTING, PUBLIC_KEY = "spark.tessella.pii.key", b"public"


def feistel(x: int, bits: int, key: bytes, tweak: bytes, back: bool = False) -> int:
    """Permutes the numbers of 2 * bits bits."""
    mask, size = (1 << bits) - 1, (bits + 7) // 8
    left, right = x >> bits, x & mask
    for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
        said = left if back else right
        f = int.from_bytes(hashlib.blake2b(bytes([r]) + tweak + b"\0" + said.to_bytes(size, "big"), key=key, digest_size=max(size, 8)).digest(), "big") & mask
        left, right = (right ^ f, left) if back else (right, left ^ f)
    return left << bits | right


def session_key(spark: SparkSession) -> bytes:
    """The key that the session's configuration holds."""
    found = spark.conf.get(KEY_SETTING, None)
    if not found:
        warnings.warn(f"{KEY_SETTING} is not set: pseudonyms are made with a public key and can be undone by anyone", stacklevel=2)
        return PUBLIC_KEY
    return hashlib.blake2b(found.encode()).digest()


@lru_cache(maxsize=4096)
def _cycle(values: tuple[int, ...], key: bytes, tweak: bytes) -> tuple[dict[int, int], dict[int, int]]:
    """One cycle through all values in an order of the key, so that none stays as it is; there and back."""
    size = max(1, (max(values).bit_length() + 1) // 2)
    order = sorted(values, key=lambda v: feistel(v, size, key, b"cycle:" + tweak))
    there = dict(zip(order, order[1:] + order[:1], strict=True))
    return there, {b: a for a, b in there.items()}


def permute(x: int, n: int, key: bytes, tweak: bytes, valid: Callable[[int], bool] = lambda _: True, back: bool = False) -> int:
    """Permutes the valid numbers below n.

    Up to TABLE of them none stays as it is, unless it is the only valid one; beyond that a value keeps its place with
    a chance of about one in the number of valid values.
    """
    if n <= TABLE:
        values = tuple(v for v in range(n) if valid(v))
        return _cycle(values, key, tweak)[back].get(x, x)
    bits = max(1, ((n - 1).bit_length() + 1) // 2)
    while True:
        x = feistel(x, bits, key, tweak, back)
        if x < n and valid(x):
            return x


def _radix(text: str) -> list[str]:
    """The alphabet of each character that is permuted; one-letter alphabets stay."""
    return [DIGITS if c in DIGITS else LOWER if c in LOWER else UPPER if c in UPPER else c for c in text]


def recode(text: str, kind: str, key: bytes, valid: Callable[[str], bool] = lambda _: True, alphabets: list[str] | None = None, back: bool = False) -> str:
    """The pseudonym of text among all texts with the same alphabets that are valid."""
    sets = alphabets or _radix(text)
    n = x = 0
    n = 1
    for c, s in zip(text, sets, strict=True):
        n, x = n * len(s), x * len(s) + s.index(c)

    def spell(v: int) -> str:
        out = []
        for s in reversed(sets):
            v, r = divmod(v, len(s))
            out.append(s[r])
        return "".join(reversed(out))

    return spell(permute(x, n, key, f"{kind}:{len(text)}".encode(), lambda v: valid(spell(v)), back))


def _refill(found: str, chars: str, alphabet: str) -> str:
    """Puts chars back over the characters of found that are in the alphabet."""
    it = iter(chars)
    return "".join(next(it) if c in alphabet else c for c in found)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _card(m: str, key: bytes, back: bool = False) -> str | None:
    d = re.sub(r"\D", "", m)
    if not 13 <= len(d) <= 19 or not luhn(d) or len(set(d)) == 1:
        return None
    body = recode(d[1:-1], "card" + d[0], key, back=back)
    check = next(c for c in DIGITS if luhn(d[0] + body + c))
    return _refill(m, d[0] + body + check, DIGITS)


def _iban_ok(s: str) -> bool:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _iban(m: str, key: bytes, back: bool = False) -> str | None:
    s = m.replace(" ", "")
    if not 15 <= len(s) <= 34 or not _iban_ok(s):
        return None
    body = recode(s[4:], "iban" + s[:2], key, back=back)
    made = next(s[:2] + f"{c:02d}" + body for c in range(2, 99) if _iban_ok(s[:2] + f"{c:02d}" + body))
    return _refill(m, made, DIGITS + UPPER)


_FIRST_DAY, _DAYS = datetime.date(1900, 1, 1), (datetime.date(2100, 1, 1) - datetime.date(1900, 1, 1)).days


def _date(m: str, key: bytes, back: bool = False) -> str | None:
    """Days of 1900 to 2099, permuted among themselves; the field order and the separators stay."""
    a, b, c = re.split(r"[-/.]", m)
    orders = [(0, 1, 2)] if len(a) == 4 else [(2, 1, 0), (2, 0, 1)]
    for y, mo, d in orders:
        try:
            day = datetime.date(int((a, b, c)[y]), int((a, b, c)[mo]), int((a, b, c)[d]))
        except ValueError:
            continue
        at = (day - _FIRST_DAY).days
        if not 0 <= at < _DAYS:
            continue

        # a date that reads day first must not turn into one whose fields would be read the other way on the way back
        def made(v: int, y=y, mo=mo, d=d) -> str:
            new = _FIRST_DAY + datetime.timedelta(v)
            parts = [""] * 3
            parts[y], parts[mo], parts[d] = f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}"
            return "".join(parts)

        def same_order(v: int, y=y, mo=mo) -> bool:
            new = _FIRST_DAY + datetime.timedelta(v)
            return (y, mo) != (2, 0) or new.day > 12

        return _refill(re.sub(r"\d+", lambda g: "00" if len(g[0]) < 3 else "0000", m), made(permute(at, _DAYS, key, b"date" if (y, mo) != (2, 0) else b"date-us", same_order, back)), DIGITS)
    return None


def _ip(m: str, key: bytes, back: bool = False) -> str | None:
    parts = [int(x) for x in m.split(".")]
    if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in m.split(".")):
        return None
    v = permute(int.from_bytes(bytes(parts), "big"), 1 << 32, key, b"ip", lambda v: v >> 24 not in (0, 127, 255), back) if parts[0] not in (0, 127, 255) else None
    return None if v is None else ".".join(map(str, v.to_bytes(4, "big")))


def _phone(m: str, key: bytes, back: bool = False) -> str | None:
    """The last ten digits of a number with area and exchange codes from 2 on; of others, the last nine at most."""
    d = re.sub(r"\D", "", m)
    if not 7 <= len(d) <= 15:
        return None
    keep = len(d) - (10 if len(d) in (10, 11) else min(9, len(d) - 1))
    tail = d[keep:]
    ok = (lambda s: s[0] > "1" and s[3] > "1") if len(tail) == 10 and tail[0] > "1" and tail[3] > "1" else (lambda _: True)
    return _refill(m, d[:keep] + recode(tail, "phone", key, ok, back=back), DIGITS)


def _national(m: str, key: bytes, back: bool = False) -> str | None:
    d = m.replace("-", "")
    ok = lambda s: s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"
    return _refill(m, recode(d, "national", key, ok, back=back), DIGITS) if ok(d) else None


def _email(m: str, key: bytes, back: bool = False) -> str | None:
    local, _, domain = m.rpartition("@")
    return recode(local, "email", key, back=back) + "@" + domain


def _hex_sets(s: str) -> list[str] | None:
    if re.fullmatch(r"[0-9a-f]+", s):
        return [DIGITS + "abcdef"] * len(s)
    return None


def _cloud(m: str, key: bytes, back: bool = False) -> str | None:
    return m[:4] + recode(m[4:], "cloud", key, alphabets=[DIGITS + UPPER] * (len(m) - 4), back=back)


def _secret(m: str, key: bytes, back: bool = False) -> str | None:
    head = re.match(_SECRET_HEAD, m, re.IGNORECASE)[0]
    value = m[len(head) :]
    return head + recode(value, "secret", key, alphabets=_hex_sets(value), back=back)


_SECRET_HEAD = r"(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?"
KINDS: dict[str, tuple[str, Callable[..., str | None]]] = {
    "email": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}", _email),
    "secret": (rf"\b(?i:{_SECRET_HEAD})[A-Za-z0-9+/_.~-]{{8,}}", _secret),
    "cloud": (r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", _cloud),
    "iban": (r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", _iban),
    "date": (r"(?<![\w.-])(?:\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}-\d{1,2}-\d{4})(?![\w-])", _date),
    "national": (r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", _national),
    "card": (r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])", _card),
    "ip": (r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)", _ip),
    "phone": (r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?![\w-])|(?<!\w)\+\d{8,15}(?!\w)", _phone),
}
_ANY = re.compile("|".join(f"(?P<{k}>{p})" for k, (p, _) in KINDS.items()))
# a line without any of these has no finding
_HINT = re.compile(r"[0-9@=:]")


_PLAIN_CARD = re.compile(r"(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5})(?![\w-])")
IBAN_LENGTHS = {
    k: int(n)
    for k, n in (
        x.split(":")
        for x in "AD:24 AE:23 AT:20 BA:20 BE:16 BG:22 BH:22 BR:29 CH:21 CR:22 CY:28 CZ:24 DE:22 DK:18 DO:28 EE:20 ES:24 FI:18 FO:18 FR:27 GB:22 GE:22 GI:23 GL:18 GR:27 HR:21 HU:28 IE:22 IL:23 IS:26 IT:27 JO:30 KW:30 KZ:20 LB:28 LI:21 LT:20 LU:20 LV:21 MC:27 MD:24 ME:22 MK:19 MR:27 MT:31 MU:30 NL:18 NO:15 PK:24 PL:28 PS:29 PT:25 QA:29 RO:24 RS:22 SA:24 SE:24 SI:19 SK:24 SM:27 TN:24 TR:26 UA:29 VG:24 XK:20".split()
    )
}


def _spans(kind: str, line: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Where the value of a match may stand: in its usual form first, which does not depend on what follows it."""
    ends = [i for i in range(end - 1, start, -1) if line[i] == " "]
    if kind == "card":
        for a in (start, *(i + 1 for i in reversed(ends))):
            if (m := _PLAIN_CARD.match(line, a)) and m.end() <= end:
                yield a, m.end()
    if kind == "iban":
        told = IBAN_LENGTHS.get(line[start : start + 2])
        yield from ((start, i) for i in ends if i - start - line.count(" ", start, i) == told)
    yield start, end
    if kind == "card":  # groups of one or two digits are rather a list of numbers, of which one in ten passes by chance
        yield from ((start, i) for i in ends if not re.search(r"\b\d{1,2}\b", line[start:i]))


def pseudonymize(text: str, key: bytes = PUBLIC_KEY, back: bool = False) -> tuple[str, dict[str, int]]:
    """The text with every finding replaced, and how many of each kind; back undoes it for the same key."""
    counts: dict[str, int] = {}

    def put(kind: str, found: str, whole: bool) -> str | None:
        new = KINDS[kind][1](found, key, back)
        if new is None and whole and kind in ("card", "date", "iban", "national"):
            # not valid as such, yet it may hold another kind (an address, a telephone number)
            for other in ("ip", "phone"):
                if re.fullmatch(KINDS[other][0], found) and (new := KINDS[other][1](found, key, back)) is not None:
                    kind = other
                    break
        if new is not None:
            counts[kind] = counts.get(kind, 0) + 1
        return new

    def scan(line: str) -> str:
        out, done, at, failed = [], 0, 0, 0
        while m := _ANY.search(line, at):
            kind, start, end = m.lastgroup, *m.span()
            at = end
            if kind in ("card", "iban"):
                spans = _spans(kind, line, start, end)
            elif start < failed:  # of a number that is no card or IBAN, no part is anything else
                spans, at = (), start + 1
            else:
                spans = ((start, end),)
            for a, b in spans:
                if (new := put(kind, line[a:b], (a, b) == (start, end) and start >= failed)) is not None:
                    out += line[done:a], new
                    done = at = b
                    break
            else:
                if kind in ("card", "iban"):
                    failed = max(failed, end)
                    at = line.find(" ", start, end) + 1 or end
        if not out:
            return line
        out.append(line[done:])
        return "".join(out)

    if not _HINT.search(text):
        return text, counts
    return "\n".join([scan(x) if _HINT.search(x) else x for x in text.split("\n")]), counts


def add_pseudonyms(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """docs with text replaced and pii_count (long) and pii_kinds (kind:count, by name, comma-joined) added; one narrow pass.

    key: the secret key; None: the one of the session's setting KEY_SETTING.
    """
    key = session_key(docs.sparkSession) if key is None else key
    names = [c for c in docs.columns if c not in ("pii_count", "pii_kinds")]
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                made = [(None, {}) if t is None else pseudonymize(t, key) for t in part.column(at).to_pylist()]
                cols = list(part.columns)
                cols[at] = pa.array([t for t, _ in made], part.schema.field(at).type)
                counts = pa.array([sum(c.values()) for _, c in made], pa.int64())
                kinds = pa.array([",".join(f"{k}:{n}" for k, n in sorted(c.items())) for _, c in made], pa.string())
                yield pa.RecordBatch.from_arrays([*cols, counts, kinds], names=[*part.schema.names, "pii_count", "pii_kinds"])

    kept = docs.select(*[docs[f"`{c}`"].cast("string").alias("text") if c == "text" else docs[f"`{c}`"] for c in names])
    from pyspark.sql.types import LongType, StringType, StructType

    schema = StructType(list(kept.schema.fields)).add("pii_count", LongType()).add("pii_kinds", StringType())
    return kept.mapInArrow(run, schema)
