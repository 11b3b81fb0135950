"""SHA-256 and keyed SHA-256 as native expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, functions as F

BLOCK = 64  # bytes in one SHA-256 block


def sha256_text(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def hmac_sha256(secret: str, message: Column) -> Column:
    """RFC 2104: H(outer pad || H(inner pad || message)).  The pads depend on the secret only."""
    key = secret.encode("utf-8")
    if len(key) > BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(BLOCK, b"\0")
    inner = F.unhex(F.lit(bytes(b ^ 0x36 for b in key).hex()))
    outer = F.unhex(F.lit(bytes(b ^ 0x5C for b in key).hex()))
    first = F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(outer, first), 256)
