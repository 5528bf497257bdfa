"""Small per-row helpers that SQL has no words for, applied in Arrow batches. Only places, states and fingerprints leave them."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .addresses import base58check, on_curve, places

#: Fixed by the formats: the order of the group, the version byte of a private key, and the shape of its text.
ORDER = 0xFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFEBAAEDCE6AF48A03BBFD25E8CD0364141
PRIVATE = 0x80
WIF = r"(?<![1-9A-HJ-NP-Za-km-z])[5KL][1-9A-HJ-NP-Za-km-z]{50,51}(?![1-9A-HJ-NP-Za-km-z])"


def wif_state(text: str) -> str:
    """What a text of the shape is: a key for an uncompressed or compressed address, or why it is none."""
    raw = base58check(text)
    if raw is None:
        return "CHECKSUM_INVALID"
    if raw[0] != PRIVATE or len(raw) not in (33, 34) or (len(raw) == 34 and raw[-1] != 1):
        return "REJECTED"
    if not 0 < int.from_bytes(raw[1:33], "big") < ORDER:
        return "PRIVATE_SCALAR_INVALID"
    return "VALID_COMPRESSED" if len(raw) == 34 else "VALID_UNCOMPRESSED"


@F.pandas_udf(StringType())
def _wif(found: pd.Series) -> pd.Series:
    return found.map(wif_state)


def private_keys(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """key, start, end, state and fingerprint of private key shapes; places count characters, and no key leaves the row."""
    pattern = F.lit(WIF)
    found = rows.where(text.rlike(WIF)).select(key, F.regexp_extract_all(text, pattern, F.lit(0)).alias("found"), F.transform(F.split(text, WIF, -1), lambda g: F.length(g)).alias("gaps"))
    starts = places("gaps", F.transform("found", lambda x: F.length(x)))
    placed = found.select(key, F.explode(F.arrays_zip("found", starts.alias("start"))).alias("x")).select(key, "x.*")
    out = placed.select(key, "start", (F.col("start") + F.length("found")).alias("end"), _wif("found").alias("state"), F.sha2(F.concat(F.lit("private:"), "found").cast("binary"), 256).alias("_print"))
    return out.select(key, "start", "end", "state", F.when(F.col("state").startswith("VALID"), F.col("_print")).alias("fingerprint"))


def public_keys(data: bytes) -> Iterator[tuple[int, int]]:
    """Start and end of every encoding of a point of the curve, at whatever offset it begins."""
    for at, first in enumerate(data):
        size = 33 if first in (2, 3) else 65 if first == 4 else 0
        if size and at + size <= len(data) and on_curve(data[at : at + size]):
            yield at, at + size


def binary_keys(blobs: DataFrame, key: str) -> DataFrame:
    """key, start, end and fingerprint of the public keys in bounded ``blobs(key, data)``."""
    schema = blobs.select(key, F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("fingerprint")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, a, b, hashlib.sha256(b"public:" + d[a:b]).hexdigest()) for k, d in zip(batch[key], batch["data"], strict=True) if d is not None for a, b in public_keys(d)]
            yield pd.DataFrame(rows, columns=schema.names)

    return blobs.select(key, "data").mapInPandas(run, schema)


def objects(data: bytes, anchor: int) -> list[tuple[int, int]]:
    """Start and end of all JSON objects in ``data`` that hold the byte at ``anchor``, the outermost first.

    Every brace outside of strings is matched once, by a stack. Whether the data begin within a string is not
    known, so both are tried.
    """
    spans = set()
    for inside in (False, True):
        stack: list[int] = []
        for m in re.finditer(rb'\\.|["{}]', data, re.S):
            c = m.group()
            if c == b'"':
                inside = not inside
            elif inside or c[:1] == b"\\":
                continue
            elif c == b"{":
                stack.append(m.start())
            elif stack and (start := stack.pop()) <= anchor < m.end():
                spans.add((start, m.end()))
    out = []
    for a, b in sorted(spans):
        try:
            if isinstance(json.loads(data[a:b]), dict):
                out.append((a, b))
        except ValueError:
            continue
    return out


def object_spans(rows: DataFrame, key: str) -> DataFrame:
    """key, start and end of the JSON objects around the anchors of ``rows(key, data, anchor)``."""
    schema = rows.select(key, F.lit(0).alias("start"), F.lit(0).alias("end")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(k, a, b) for k, d, at in zip(batch[key], batch["data"], batch["anchor"], strict=True) if d is not None and 0 <= at < len(d) for a, b in objects(d, int(at))]
            yield pd.DataFrame(out, columns=schema.names)

    return rows.select(key, "data", "anchor").mapInPandas(run, schema)


def plain(text: str) -> str:
    """Compatibility form, lower case, without combining marks, single spaces, none of them between two CJK characters."""
    folded = unicodedata.normalize("NFKD", text).lower()
    words = "".join(c for c in folded if not unicodedata.combining(c)).split()
    if not words:
        return ""
    out = [words[0]]
    for before, word in zip(words, words[1:], strict=False):
        out += [word] if _cjk(before[-1]) and _cjk(word[0]) else [" ", word]
    return "".join(out)


def _cjk(c: str) -> bool:
    # Ideographs and their extension, kana, hangul and its letters, full-width forms
    return any(a <= ord(c) <= b for a, b in ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x3040, 0x30FF), (0xAC00, 0xD7AF), (0x1100, 0x11FF), (0xFF00, 0xFFEF)))


@F.pandas_udf(StringType())
def normalized(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else plain(t))


def mnemonic_status(indices: list[int], bits: int = 11) -> str:
    """Whether a phrase, given by its words' places in a list of 2^``bits``, has a valid length and checksum; -1 is a word that is not there."""
    n = len(indices) * bits
    if len(indices) not in (12, 15, 18, 21, 24):
        return "BIP39_WORD_COUNT_INVALID"
    if min(indices) < 0:
        return "BIP39_WORD_INVALID"
    value = 0
    for i in indices:
        value = value << bits | i
    check = n // 33
    entropy = (value >> check).to_bytes((n - check) // 8, "big")
    return "BIP39_VALID" if hashlib.sha256(entropy).digest()[0] >> 8 - check == value & ((1 << check) - 1) else "BIP39_CHECKSUM_INVALID"


@F.pandas_udf(StringType())
def mnemonic_statuses(indices: pd.Series) -> pd.Series:
    return indices.map(lambda x: mnemonic_status([int(i) for i in x]))
