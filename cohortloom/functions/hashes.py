"""The hashes behind ``unit_hash`` for many texts at once, in numpy."""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Sequence

import numpy as np
from pyspark import cloudpickle

# Executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Texts of at most so many bytes are one block; longer ones are hashed one by one.
ONE_BLOCK = 55
#: Texts worked on at once, few enough for the processor's cache.
TOGETHER = 8192


def first_words(words: np.ndarray) -> np.ndarray:
    """The first four bytes of the MD5 of one-block messages, as a big-endian number; ``words`` are their 16 words (16, texts)."""
    a, b, c, d = (np.full(words.shape[1], v, np.uint32) for v in START)
    f, g = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        turn = i // 16
        if turn == 0:
            place = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif turn == 1:
            place = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif turn == 2:
            place = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            place = (7 * i) % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += words[place]
        f += np.uint32(SINES[i])
        s = SHIFTS[turn][i % 4]
        np.right_shift(f, np.uint32(32 - s), out=g)
        f <<= np.uint32(s)
        f |= g
        f += b
        # The array that held ``a`` takes the next result.
        a, b, c, d, f = d, f, b, c, a
    a += np.uint32(START[0])
    return a.astype("<u4").view(np.uint8).reshape(-1, 4).view(">u4")[:, 0]


def unit_numbers(starts: Sequence[bytes], middles: Sequence[bytes], ends: Sequence[bytes] = (b"",)) -> np.ndarray:
    """Numbers in [0, 1) as ``unit_hash`` has them of the texts start + middle + end: an array (starts, middles, ends)."""
    out = np.empty((len(starts), len(middles), len(ends)))
    size = np.array([len(m) for m in middles], np.int64)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        for begin in range(0, len(at), TOGETHER):
            some = at[begin : begin + TOGETHER]
            texts = np.frombuffer(b"".join([middles[i] for i in some.tolist()]), np.uint8).reshape(len(some), n)
            for i, start in enumerate(starts):
                for j, end in enumerate(ends):
                    out[i, some, j] = _units(start, texts, end)
    return out


def _units(start: bytes, texts: np.ndarray, end: bytes) -> np.ndarray:
    n = len(start) + texts.shape[1] + len(end)
    if n > ONE_BLOCK:
        digests = b"".join([hashlib.md5(start + t.tobytes() + end, usedforsecurity=False).digest()[:4] for t in texts])
        return np.frombuffer(digests, ">u4") / 4294967296.0
    block = np.zeros((len(texts), 64), np.uint8)
    block[:, : len(start)] = np.frombuffer(start, np.uint8)
    block[:, len(start) : n - len(end)] = texts
    block[:, n - len(end) : n] = np.frombuffer(end, np.uint8)
    block[:, n] = 0x80
    block[:, 56:58] = (8 * n % 256, 8 * n // 256)
    words = np.ascontiguousarray(block.view("<u4").T)
    return first_words(words) / 4294967296.0
