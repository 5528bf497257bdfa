"""Literals are read, never evaluated, within limits; and which of them are old wallets."""

import ast

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwell.functions import literals

LEAF = st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text()
VALUE = st.recursive(LEAF, lambda x: st.lists(x) | st.tuples(x, x) | st.dictionaries(st.text() | st.integers(2), x), max_leaves=20)


@settings(max_examples=150, deadline=None)
@given(VALUE)
def test_reads_what_the_language_reads(value):
    assert literals.Reader(repr(value)).whole() == ast.literal_eval(repr(value))


def test_older_forms():
    assert literals.Reader("{u'a': 12L, 'b': (1,), \"c\": [1, 2,], 'd': '\\x41\\u00e9\\101\\q', 'e': -1.5e3}").whole() == {"a": 12, "b": (1,), "c": [1, 2], "d": "A\u00e9A\\q", "e": -1500.0}


@pytest.mark.parametrize(
    "text, why",
    [
        ("", literals.SYNTAX), ("{'a' 1}", literals.SYNTAX), ("[1 2]", literals.SYNTAX), ("__import__('os')", literals.SYNTAX), ("{'a': 1}x", literals.SYNTAX), ("'a\nb'", literals.SYNTAX), ("[", literals.SYNTAX), ("1.5L", literals.SYNTAX),
        ("{[]: 1}", literals.UNHASHABLE), ("{'a': 1, 'a': 2}", literals.REPEATED), ("[" * 70 + "]" * 70, literals.TOO_DEEP), ("9" * 5000, literals.TOO_LONG), ("12abc", literals.SYNTAX),
    ],
)
def test_refused(text, why):
    with pytest.raises(literals.Refused, match=why):
        literals.Reader(text).whole()


def test_limits(monkeypatch):
    monkeypatch.setattr(literals, "MOST", 5)
    with pytest.raises(literals.Refused, match=literals.TOO_MANY):
        literals.Reader("[1, 2, 3, 4, 5]").whole()
    monkeypatch.setattr(literals, "LONGEST", 5)
    with pytest.raises(literals.Refused, match=literals.TOO_LONG):
        literals.Reader("[1, 2]")


MASTER = "ab" * 64


@pytest.mark.parametrize(
    "change, want",
    [
        ({}, ("ELECTRUM_1_X_LITERAL_STORAGE", "PLAINTEXT_STRUCTURE", 4, True, False, False, 1, "ACCOUNTS")), ({"use_encryption": True, "seed": "s"}, ("ELECTRUM_1_X_LITERAL_STORAGE", "FIELD_LEVEL_ENCRYPTED", 4, False, False, True, 1, "ACCOUNTS")),
        ({"seed_version": 11, "wallet_type": "2of3", "master_public_key": None, "master_public_keys": {"x1": "xpub661"}}, ("ELECTRUM_2_0_TO_2_7_TRANSITIONAL_STORAGE", "PLAINTEXT_STRUCTURE", 11, True, False, False, 1, "ACCOUNTS")),
        ({"seed_version": 0}, None), ({"seed_version": 14}, None), ({"seed_version": True}, None), ({"keystore": {}}, None), ({"x1/": {}}, None), ({"wallet_type": "odd"}, None), ({"accounts": None}, None), ({"use_encryption": 1}, None),
        ({"master_public_key": "ab"}, None), ({"accounts": None, "addresses": ["1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa"], "change_addresses": []}, ("ELECTRUM_1_X_LITERAL_STORAGE", "PLAINTEXT_STRUCTURE", 4, True, False, False, 0, "ADDRESS_LISTS")),
        ({"imported_keys": {"1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNb": "k"}}, None),
    ],
)
def test_legacy(change, want):
    w = {"seed_version": 4, "accounts": {0: {}}, "master_public_key": MASTER} | change
    assert literals.legacy({k: v for k, v in w.items() if v is not None}) == want
