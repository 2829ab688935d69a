"""Helpers for code that runs in Python workers on Arrow batches."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash

#: A term or word: a longest run of Unicode letters and digits, matched on lower-cased text.
WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class Hashes(dict):
    """token -> 64-bit hash, remembered; emptied when it has grown past its bound."""

    def __init__(self, bound: int = 50_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, token: str) -> int:
        if len(self) > self.bound:
            self.clear()
        value = self[token] = xxhash.xxh3_64_intdigest(token)
        return value


def hash_tokens(tokens: list[str], cache: Hashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingle_hashes(tokens: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of width tokens, of token hashes."""
    n = len(tokens) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, dtype=np.uint64)
        for k in range(width):
            out = (out ^ (out >> np.uint64(31))) * _MIX[k % len(_MIX)] + tokens[k : k + n] * _MIX[(k + 1) % len(_MIX)]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)
