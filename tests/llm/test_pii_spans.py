"""Numbers beside other numbers and capitals."""

import pytest

from tessella.llm import pii

CARD, ES, BE = "4111111111111111", "ES9121000418450200051332", "BE68539007547034"


@pytest.mark.parametrize(
    "text, value, kind",
    [
        (f"{CARD} 12 items", CARD, "card"),
        ("4111 1111 1111 1111 123", "4111 1111 1111 1111", "card"),
        ("12 4111 1111 1111 1111 on", "4111 1111 1111 1111", "card"),
        ("1234 4111 1111 1111 1111 on", "4111 1111 1111 1111", "card"),
        (f"{ES} 2024", ES, "iban"),
        (f"{BE} AND so on", BE, "iban"),
        ("AB13 CDEF 4111 1111 1111 1111", "4111 1111 1111 1111", "card"),
    ],
)
def test_values_beside_others(text, value, kind):
    out, counts = pii.pseudonymize(text)
    assert counts == {kind: 1} and value not in out
    alone = pii.pseudonymize(value)[0]
    assert out == text.replace(value, alone)
    assert pii.pseudonymize(out, back=True)[0] == text


def test_two_cards_and_what_stays():
    out, counts = pii.pseudonymize(f"{CARD} 5500005555555559 7 {CARD}")
    assert counts == {"card": 3} and CARD not in out and "5500005555555559" not in out
    for text in ("4111 1111 1111 1112 12", "4111111111111112", "1 2 3 4 5 6 7 8 9 10 11 12 14"):
        assert pii.pseudonymize(text) == (text, {})
