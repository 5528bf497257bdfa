"""Old wallets that were stored as literals of a programming language: a bounded reader, and what such a wallet is.

Literals are read, never evaluated: dicts, lists, tuples, texts, whole and broken numbers, True, False and None. What leaves the
kernel says which fields there are and how they relate, never what they hold.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .addresses import base58check

#: Limits of a literal: characters, depth, values. Beyond them it is refused by its code.
LONGEST, DEEPEST, MOST = 32 << 20, 64, 1_000_000
TOO_LONG, TOO_DEEP, TOO_MANY, SYNTAX, UNHASHABLE, REPEATED = "literal_too_long", "literal_too_deep", "literal_too_many_values", "literal_syntax", "literal_key_invalid", "literal_key_repeated"
ENCODINGS = ("utf-8", "cp1252", "cp1250", "latin-1")
#: Types of wallets before keystores. Fixed values.
WALLET_TYPES = ("old", "standard", "xpub", "imported", "bip44", "2fa", "trezor", "keepkey", "ledger", "btchip")
LATEST_VERSION, MASTER_KEY = 13, re.compile(r"[0-9a-fA-F]{128}")
LEGACY = "source_id string, offset long, state string, encoding string, generation string, encryption string, seed_version int, watch_only boolean, imported boolean, has_seed boolean, accounts int, layout string, failure string"

_TOKEN = re.compile(
    r"""\s*(?:(?P<text>[uUbB]?(?:'(?:[^'\\\n]|\\.)*'|"(?:[^"\\\n]|\\.)*"))|(?P<number>[+-]?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)(?P<long>[lL]?)(?![\w.])|(?P<name>True|False|None)\b|(?P<mark>[\[\](){},:]))""", re.S
)
_ESCAPE = re.compile(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|([0-7]{1,3})|(.))", re.S)
_SIMPLE = {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v", "\n": ""}
_CLOSES = {"[": "]", "(": ")", "{": "}"}


class Refused(ValueError):
    """Why a text is no literal; the text is a fixed code."""


def _plain(m: re.Match) -> str:
    code = m[1] or m[2] or m[3]
    if code:
        n = int(code, 16)
        if n > 0x10FFFF:
            raise Refused(SYNTAX)
        return chr(n)
    return chr(int(m[4], 8)) if m[4] else _SIMPLE.get(m[5], m[5] if m[5] in "\\'\"" else "\\" + m[5])


class Reader:
    """One value of ``text``, by descent."""

    def __init__(self, text: str) -> None:
        if len(text) > LONGEST:
            raise Refused(TOO_LONG)
        self.text, self.at, self.values = text, 0, 0

    def whole(self) -> object:
        value = self.value(0)
        if self.text[self.at :].strip():
            raise Refused(SYNTAX)
        return value

    def next(self) -> re.Match:
        m = _TOKEN.match(self.text, self.at)
        if not m:
            raise Refused(SYNTAX)
        self.at = m.end()
        return m

    def peek(self, mark: str) -> bool:
        """Whether ``mark`` is next; it is taken if so."""
        m = _TOKEN.match(self.text, self.at)
        if m and m["mark"] == mark:
            self.at = m.end()
            return True
        return False

    def value(self, depth: int) -> object:
        self.values += 1
        if depth > DEEPEST:
            raise Refused(TOO_DEEP)
        if self.values > MOST:
            raise Refused(TOO_MANY)
        m = self.next()
        if m["text"] is not None:
            return _ESCAPE.sub(_plain, m["text"].lstrip("uUbB")[1:-1])
        if m["number"] is not None:
            return self.number(m)
        if m["name"]:
            return {"True": True, "False": False, "None": None}[m["name"]]
        if m["mark"] not in _CLOSES:
            raise Refused(SYNTAX)
        return self.mapping(depth) if m["mark"] == "{" else self.sequence(m["mark"], depth)

    @staticmethod
    def number(m: re.Match) -> int | float:
        text = m["number"]
        if not re.fullmatch(r"[+-]?\d+", text):
            if m["long"]:
                raise Refused(SYNTAX)
            return float(text)
        if len(text) > 4000:
            raise Refused(TOO_LONG)
        return int(text)

    def sequence(self, opened: str, depth: int) -> object:
        out, comma = [], False
        while not self.peek(_CLOSES[opened]):
            if out and not comma:
                raise Refused(SYNTAX)
            out.append(self.value(depth + 1))
            comma = self.peek(",")
        if opened == "(":
            return out[0] if len(out) == 1 and not comma else tuple(out)
        return out

    def mapping(self, depth: int) -> dict:
        out, comma = {}, True
        while not self.peek("}"):
            if not comma:
                raise Refused(SYNTAX)
            key = self.value(depth + 1)
            if not isinstance(key, (str, int, float, type(None))):
                raise Refused(UNHASHABLE)
            if key in out:
                raise Refused(REPEATED)
            if not self.peek(":"):
                raise Refused(SYNTAX)
            out[key] = self.value(depth + 1)
            comma = self.peek(",")
        return out


def _address(x: object) -> bool:
    raw = base58check(x) if isinstance(x, str) and 26 <= len(x) <= 35 else None
    return raw is not None and len(raw) == 21 and raw[0] in (0x00, 0x6F)


def _public(x: object) -> bool:
    if isinstance(x, str):
        return bool(MASTER_KEY.fullmatch(x)) or x.startswith("xpub")
    return isinstance(x, (list, tuple)) and 2 <= len(x) <= 4 and all(isinstance(y, str) for y in x)


def legacy(w: object) -> tuple | None:
    """(generation, encryption, seed version, watch only, imported, has a seed, accounts, layout) of a wallet from before keystores; None if it is none."""
    if not isinstance(w, dict) or not all(isinstance(k, (str, int)) for k in w) or "keystore" in w or any(re.fullmatch(r"x\d+/", str(k)) for k in w):
        return None
    version, accounts = w.get("seed_version"), w.get("accounts")
    lists = [w.get(k) for k in ("addresses", "change_addresses")]
    by_accounts, by_lists = isinstance(accounts, dict), all(isinstance(x, (list, tuple)) and all(map(_address, x)) for x in lists)
    kind, own, many = w.get("wallet_type"), w.get("master_public_key"), w.get("master_public_keys")
    if type(version) is not int or not 1 <= version <= LATEST_VERSION or not (by_accounts or by_lists):
        return None
    if kind is not None and not (isinstance(kind, str) and (kind in WALLET_TYPES or re.fullmatch(r"[1-9]\d?of[1-9]\d?", kind))):
        return None
    private, given, encrypted = w.get("master_private_keys", {}), w.get("imported_keys", {}), w.get("use_encryption", False)
    if not isinstance(private, dict) or not isinstance(given, dict) or type(encrypted) is not bool or not all(_address(a) and isinstance(k, str) and k for a, k in given.items()):
        return None
    master = (isinstance(own, str) and bool(MASTER_KEY.fullmatch(own))) or (isinstance(many, dict) and bool(many) and all(isinstance(k, str) and _public(v) for k, v in many.items()))
    imported = "imported" in (kind, w.get("key_type")) or (isinstance(w.get("keypairs"), dict) and bool(w["keypairs"]))
    imported = imported or (by_accounts and any(isinstance(a, dict) and isinstance(a.get("imported"), dict) for a in accounts.values()))
    if not master and (not imported or version <= 6):
        return None
    seed = isinstance(w.get("seed"), str) and bool(w["seed"])
    secret = seed or bool(private) or bool(given)
    generation = "ELECTRUM_1_X_LITERAL_STORAGE" if kind is None else "ELECTRUM_2_0_TO_2_7_TRANSITIONAL_STORAGE"
    encryption = "FIELD_LEVEL_ENCRYPTED" if encrypted and secret else "PLAINTEXT_STRUCTURE"
    return generation, encryption, version, not secret, bool(imported), seed, len(accounts) if by_accounts else 0, "ACCOUNTS" if by_accounts else "ADDRESS_LISTS"


def judged(raw: bytes) -> tuple:
    """The columns of LEGACY from state on: legacy with the first encoding under which it is one, else other, or refused with the first reason."""
    why, read, seen = None, False, set()
    for encoding in ENCODINGS:
        try:
            text = raw.decode(encoding)
        except UnicodeDecodeError:
            continue
        if text in seen:
            continue
        seen.add(text)
        try:
            found = legacy(Reader(text).whole())
        except (Refused, OverflowError, ValueError) as e:
            why = why or (str(e) if isinstance(e, Refused) else SYNTAX)
            continue
        read = True
        if found:
            return "legacy", encoding.upper().replace("-", "_"), *found[:2], *found[2:], None
    return ("other" if read else "refused", *[None] * 9, None if read else why)


def legacy_wallets(blobs: DataFrame) -> DataFrame:
    """LEGACY of ``blobs(source_id, offset, data)``, one row each; null data is empty and so refused."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(s, o, *judged(bytes(d or b""))) for s, o, d in zip(batch["source_id"], batch["offset"], batch["data"], strict=True)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in LEGACY.split(", ")], dtype=object)

    return blobs.select("source_id", "offset", "data").mapInPandas(run, LEGACY)
