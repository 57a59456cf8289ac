"""Digest columns that the queries derive from operators' outputs."""

from __future__ import annotations

import hashlib

import numpy as np

from pairwell.llm.bpe import Coded


def ids_sha256(coded: Coded) -> list[str]:
    """Of each text, lower-case hex SHA-256 of its ids as little-endian unsigned 32-bit integers."""
    raw = memoryview(np.ascontiguousarray(coded.ids.astype("<u4"))).cast("B")
    at = coded.offsets.tolist()
    return [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]


def decoded_sha256(coded: Coded) -> list[str]:
    """Of each text, lower-case hex SHA-256 of what its ids decode to, in UTF-8."""
    return [hashlib.sha256(x.encode()).hexdigest() for x in coded.texts()]
