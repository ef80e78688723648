"""128-bit floats (IEEE 754 binary128) as the nearest doubles."""

from __future__ import annotations

import numpy as np

#: Bytes of a number; bits of its fraction above and below the upper 64-bit half's end, and what its exponent exceeds a double's by.
SIZE = 16
HIGH, SHIFT, BIAS = 48, 60, 16383 - 1023
LARGEST = 0x7FFF


def _u(x: int) -> np.uint64:
    return np.uint64(x)


def doubles(raw: bytes, big_endian: bool) -> np.ndarray:
    """The nearest double of each number, ties to even: beyond the largest an infinity, below the least normal one a subnormal or zero, NaN for NaN."""
    halves = np.frombuffer(raw, ">u8" if big_endian else "<u8").astype(np.uint64).reshape(-1, 2)
    high, low = (halves[:, 0], halves[:, 1]) if big_endian else (halves[:, 1], halves[:, 0])
    sign = high & _u(1 << 63)
    exponent = ((high >> _u(HIGH)) & _u(LARGEST)).astype(np.int64)
    upper = high & _u((1 << HIGH) - 1)
    # the 52 bits that a double keeps, and the 60 below them
    kept = (upper << _u(4)) | (low >> _u(SHIFT))
    rest = low & _u((1 << SHIFT) - 1)
    to = exponent - BIAS
    half = _u(1 << (SHIFT - 1))
    up = (rest > half) | ((rest == half) & ((kept & _u(1)) == 1))
    # a carry out of the fraction raises the exponent, and from the largest makes an infinity
    normal = (np.clip(to, 1, 2046).astype(np.uint64) << _u(52)) + kept + up.astype(np.uint64)
    shift = np.clip(1 - to, 1, 60).astype(np.uint64)
    whole = kept | _u(1 << 52)
    small = whole >> shift
    dropped, middle = whole & ((_u(1) << shift) - _u(1)), _u(1) << (shift - _u(1))
    small += ((dropped > middle) | ((dropped == middle) & ((rest != 0) | ((small & _u(1)) == 1)))).astype(np.uint64)
    infinite = _u(0x7FF << 52)
    bits = np.where(to >= 2047, infinite, np.where(to >= 1, normal, np.where(exponent == 0, _u(0), small)))
    bits = np.where((exponent == LARGEST) & ((upper | low) != 0), infinite | _u(1 << 51), bits)
    return (bits | sign).view(np.float64)
