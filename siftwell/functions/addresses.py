"""Address and public key shapes in text: found by SQL, confirmed by checksums in an Arrow UDF.

Rows carry places, states and one-way fingerprints; what was found is not repeated.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

#: Fixed by the formats.
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
BECH32_STEPS = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)
P = 2**256 - 2**32 - 977
#: What is proposed; a checksum or the curve decides. Lengths are the formats' own: 25 bytes in Base58 with four more at most, 6 to 87 characters after the separator, 33 or 65 bytes in hexadecimal.
SHAPES = {
    "base58": f"(?<![{BASE58}])[13][{BASE58}]{{25,34}}(?![{BASE58}])",
    "bech32": f"(?<![0-9A-Za-z])[bB][cC]1[{BECH32}{BECH32.upper()}]{{6,87}}(?![0-9A-Za-z])",
    "sec_hex": r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{130}|[0-9A-Fa-f]{66})(?![0-9A-Fa-f])",
}


def base58check(text: str) -> bytes | None:
    """The payload of a Base58Check string, without its checksum; None if it doesn't hold."""
    n = 0
    for c in text:
        at = BASE58.find(c)
        if at < 0:
            return None
        n = n * 58 + at
    raw = b"\0" * (len(text) - len(text.lstrip("1"))) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    whole, check = raw[:-4], raw[-4:]
    return whole if len(raw) > 4 and hashlib.sha256(hashlib.sha256(whole).digest()).digest()[:4] == check else None


def bech32(text: str) -> str:
    """bech32 or bech32m by the checksum's constant, or invalid; one case throughout, lower or upper."""
    if text not in (text.lower(), text.upper()) or len(text) < 14:
        return "invalid"
    text = text.lower()
    values = [BECH32.find(c) for c in text[3:]]
    if min(values) < 0:
        return "invalid"
    check = 1
    for v in [*(ord(c) >> 5 for c in "bc"), 0, *(ord(c) & 31 for c in "bc"), *values]:
        top, check = check >> 25, (check & 0x1FFFFFF) << 5 ^ v
        for i, step in enumerate(BECH32_STEPS):
            check ^= step if top >> i & 1 else 0
    kind = {1: "bech32", 0x2BC830A3: "bech32m"}.get(check)
    bits = (len(values) - 7) * 5
    fits = 0 <= values[0] <= 16 and 2 <= bits // 8 <= 40 and bits % 8 < 5 and not values[-7] & ((1 << bits % 8) - 1)
    right = kind == ("bech32" if values[0] == 0 else "bech32m") and (values[0] or bits // 8 in (20, 32))
    return kind if kind and fits and right else "invalid"


def on_curve(key: bytes) -> bool:
    """Whether an encoded public key is a point of secp256k1."""
    x = int.from_bytes(key[1:33], "big")
    square = (pow(x, 3, P) + 7) % P
    if x >= P:
        return False
    if len(key) == 33 and key[0] in (2, 3):
        return pow(square, (P - 1) // 2, P) == 1
    return len(key) == 65 and key[0] == 4 and pow(int.from_bytes(key[33:], "big"), 2, P) == square and int.from_bytes(key[33:], "big") < P


def confirmed(kind: str, found: str) -> str:
    """What a found shape is, or invalid."""
    if kind == "base58":
        raw = base58check(found)
        return {0: "p2pkh", 5: "p2sh"}.get(raw[0], "invalid") if raw and len(raw) == 21 else "invalid"
    if kind == "bech32":
        return bech32(found)
    return "public_key" if on_curve(bytes.fromhex(found)) else "invalid"


@F.pandas_udf(ArrayType(IntegerType()))
def places(gaps: pd.Series, sizes: pd.Series) -> pd.Series:
    """Where matches begin, from the lengths of the gaps before them and their own; there is a gap more, after the last."""
    out = []
    for g, s in zip(gaps, sizes, strict=True):
        s = np.asarray(s, np.int64)
        out.append(np.cumsum(np.asarray(g, np.int64)[: len(s)]) + np.cumsum(s) - s)
    return pd.Series(out, dtype=object)


@F.pandas_udf(StringType())
def _confirmed(kind: pd.Series, found: pd.Series) -> pd.Series:
    return pd.Series([confirmed(k, x) for k, x in zip(kind, found, strict=True)], dtype=object)


def find(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """Shapes in ``rows``: key, kind, start, end, state, fingerprint; places count bytes. Texts without a shape never reach Python."""
    def tagged(kind: str) -> Column:
        pattern = SHAPES[kind]
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.octet_length(g))
        return F.when(text.rlike(pattern), F.struct(F.lit(kind).alias("kind"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), gaps.alias("gaps")))

    shapes = rows.select(key, F.explode(F.array_compact(F.array(*map(tagged, SHAPES)))).alias("x")).select(key, "x.*")
    starts = places("gaps", F.transform("found", lambda x: F.octet_length(x)))
    each = shapes.select(key, "kind", F.explode(F.arrays_zip("found", starts.alias("start"))).alias("x")).select(key, "kind", "x.*")
    found = each.select(key, "kind", "start", (F.col("start") + F.octet_length("found")).alias("end"), "found")
    # one address has one fingerprint, whatever its case where case says nothing
    one = F.when(F.col("kind") == "base58", F.col("found")).otherwise(F.lower("found"))
    return found.select(key, "kind", "start", "end", _confirmed("kind", "found").alias("state"), F.sha2(F.concat(F.lit("shape:"), one).cast("binary"), 256).alias("fingerprint"))
