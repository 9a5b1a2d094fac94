"""Long lines, keys and values that may not stay as they are."""

import random
import string
import time

import pytest

from tessella.llm import pii


@pytest.mark.parametrize("kind", ["plain", "base64", "digits", "spaced", "at", "dots", "equals"])
def test_long_lines_take_linear_time(kind):
    r = random.Random(5)
    n = 1_000_000
    line = {
        "plain": lambda: "x" * n + "1",
        "base64": lambda: "".join(r.choices(string.ascii_letters + string.digits + "+/", k=n)),
        "digits": lambda: "".join(r.choices(string.digits, k=n)),
        "spaced": lambda: " ".join(r.choices(string.digits, k=n // 2)),
        "at": lambda: "a@" * (n // 2),
        "dots": lambda: "a." * (n // 2) + "@",
        "equals": lambda: "token=" * (n // 6),
    }[kind]()
    began = time.perf_counter()
    pii.pseudonymize(line)
    assert time.perf_counter() - began < 60


def test_lines_are_apart_and_kept():
    text = "a 17.57.238.115\r\n\nb\n\nmail me@mail.example.com\n"
    out, counts = pii.pseudonymize(text)
    assert counts == {"ip": 1, "email": 1} and out.count("\n") == text.count("\n") and out.startswith("a ") and "\r\n\nb\n\nmail " in out
    assert pii.pseudonymize(out, back=True)[0] == text


def test_no_value_of_a_small_format_stays():
    for c in string.ascii_lowercase:
        new = pii.pseudonymize(f"{c}@mail.example.com")[0]
        assert new[0] != c and new[1:] == "@mail.example.com"
        assert pii.pseudonymize(new, back=True)[0][0] == c
    for n in (2, 3, 50, 1024):
        made = [pii.permute(x, n, b"k", b"t") for x in range(n)]
        assert sorted(made) == list(range(n)) and all(a != b for a, b in enumerate(made))
        assert [pii.permute(y, n, b"k", b"t", back=True) for y in made] == list(range(n))


def test_keys_come_from_the_session(spark):
    rows = spark.createDataFrame([(1, "call 17.57.238.115")], "doc_id long, text string")
    with pytest.warns(UserWarning, match="public key"):
        public = pii.add_pseudonyms(rows).first().text
    spark.conf.set(pii.KEY_SETTING, "one")
    try:
        one = pii.add_pseudonyms(rows).first().text
        spark.conf.set(pii.KEY_SETTING, "two")
        two = pii.add_pseudonyms(rows).first().text
    finally:
        spark.conf.unset(pii.KEY_SETTING)
    assert len({public, one, two, "call 17.57.238.115"}) == 4
