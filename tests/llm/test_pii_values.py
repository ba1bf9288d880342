"""Values that a greedy match takes in together with what stands beside them."""

import pytest
from llm import pii

KEY = b"0123456789abcdef"
CARD, IBAN = "4111 1111 1111 1111", "ES91 2100 0418 4502 0005 1332"


@pytest.mark.parametrize(
    "text, values",
    [
        (f"pay {CARD} 12/27", [("card", CARD)]),
        ("4111111111111111 123", [("card", "4111111111111111")]),
        ("4111-1111-1111-1111 737 paid", [("card", "4111-1111-1111-1111")]),
        (f"12 {CARD}", [("card", CARD)]),
        (f"{CARD} {CARD}", [("card", CARD), ("card", CARD)]),
        (f"{IBAN} THIS", [("iban", IBAN)]),
        ("ES9121000418450200051332 OK", [("iban", "ES9121000418450200051332")]),
        ("DE89370400440532013000 GB82WEST12345698765432", [("iban", "DE89370400440532013000"), ("iban", "GB82WEST12345698765432")]),
        ("GB82 WEST 1234 5698 7654 32 AND", [("iban", "GB82 WEST 1234 5698 7654 32")]),
        ("1234 5678 9012 3456 and 999.1.2.3 and 2020-13-45", []),
    ],
)
def test_values_beside_others(text, values):
    new, spans = pii.pseudonymise(text, KEY)
    expected, at = text, 0
    for kind, value in values:
        change = pii._card(value, KEY) if kind == "card" else pii._iban(value, KEY)
        at = expected.index(value, at)
        expected = expected[:at] + change + expected[at + len(value) :]
        at += len(change)
    assert new == expected
    assert [(x["kind"], x["end"] - x["start"]) for x in spans] == [(k, len(v)) for k, v in values]
