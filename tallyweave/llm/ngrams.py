"""Hashed character n-grams of whole texts, in numpy."""

from __future__ import annotations

import numpy as np

_A, _B, _C = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)


def code_points(text: str) -> np.ndarray:
    """Lower-cased code points; digits count as one sign and runs of white space stay as they are."""
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def char_ngrams(text: str, bits: int) -> np.ndarray:
    """Bucket of every 1-, 2- and 3-gram of the blank-padded text, in no particular order."""
    c = np.concatenate(([np.uint32(32)], code_points(text), [np.uint32(32)])).astype(np.uint32)
    shift = np.uint32(32 - bits)
    one = c * _A
    two = (one[:-1] ^ (c[1:] * _B)) * _C
    three = (two[:-1] ^ (c[2:] * _A + _B)) * _C
    return np.concatenate(((one * _C) >> shift, two >> shift, three >> shift)).astype(np.int64)
