"""Deterministic partner-scoped tokens: HMAC-SHA256 and base32 from built-in functions."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = "abcdefghijklmnopqrstuvwxyz234567"
RADIX_32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def hmac_sha256_hex(key: bytes, message: Column) -> Column:
    key = (sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in key).hex()))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), message.cast("binary")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def base32(hex_digits: Column, n: int) -> Column:
    """n base32 letters (lower case) of a hexadecimal string, padded with zero bits: fifteen digits make twelve letters at once."""
    groups = -(-n // 12)
    padded = F.rpad(hex_digits, 15 * groups, "0")
    letters = F.concat(*(F.lpad(F.conv(F.substring(padded, 15 * i + 1, 15), 16, 32), 12, "0") for i in range(groups)))
    return F.translate(F.substring(letters, 1, n), RADIX_32, ALPHABET)


def tokenize(key: bytes, partner: Column, field: str, value: Column) -> Column:
    """tok_ and 26 letters; null or empty values stay null."""
    # nulls run through instead of a CASE, inside which common parts would be computed again for each use
    digest = hmac_sha256_hex(key, F.concat(F.coalesce(partner, F.lit("")), F.lit(f"|{field}|"), F.nullif(value, F.lit(""))))
    return F.concat(F.lit("tok_"), base32(F.substring(digest, 1, 32), 26))


def cross_reference(key: bytes, field: str, value: Column) -> Column:
    """A token without the partner in it, under a key of its own: equal values of all partners meet, for matching only."""
    return tokenize(key + b"|xref", F.lit("*"), field, value)
