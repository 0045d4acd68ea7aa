"""Hashes of many rows in many redraws at once, as matrices; equal to those that Spark and SQL compute one by one."""

from __future__ import annotations

import hashlib
import math

import numpy as np

#: Hashes worked out at once: what stays in a core's cache.
AT_ONCE = 16_384

_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_ADD = [np.uint32(int(abs(math.sin(i + 1)) * (1 << 32))) for i in range(64)]
_TURN = [s for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in row * 4]
_WORD = [(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16 for i in range(64)]
#: Longest message of one block of 64 bytes.
_ONE_BLOCK = 55


def _md5_block(words: list[np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """First eight bytes of the digests of messages of one block, as unsigned numbers."""
    a, b, c, d = (np.full(shape, x, dtype=np.uint32) for x in _START)
    f, t = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += _ADD[i]
        f += words[_WORD[i]]
        np.left_shift(f, np.uint32(_TURN[i]), out=t)
        f >>= np.uint32(32 - _TURN[i])
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    first, second = ((x + np.uint32(s)).byteswap().astype(np.uint64) for x, s in zip((a, b), _START))
    return (first << np.uint64(32)) | second


def md5_heads(texts: list[bytes], ends: list[bytes]) -> np.ndarray:
    """First 64 bits of the MD5 of every text with every end (rows and columns), as unsigned numbers."""
    out = np.empty((len(texts), len(ends)), dtype=np.uint64)
    lengths = np.array([len(x) for x in texts], dtype=np.int64)
    longest = max((len(e) for e in ends), default=0)
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        if length + longest > _ONE_BLOCK:
            for i in rows:
                out[i] = [int.from_bytes(hashlib.md5(texts[i] + e).digest()[:8], "big") for e in ends]
            continue
        tail = np.zeros((len(ends), 64), dtype=np.uint8)
        for row, e in zip(tail, ends):
            stop = length + len(e)
            row[length:stop] = np.frombuffer(e, dtype=np.uint8)
            row[stop] = 0x80
            row[56:58] = (8 * stop) & 255, (8 * stop) >> 8
        tail = np.ascontiguousarray(tail.view("<u4").T)[:, None, :]
        head = np.zeros((len(rows), 64), dtype=np.uint8)
        head[:, :length] = np.frombuffer(b"".join(texts[i] for i in rows), dtype=np.uint8).reshape(len(rows), length)
        head = head.view("<u4")
        step = max(AT_ONCE // max(len(ends), 1), 1)
        for s in range(0, len(rows), step):
            some = head[s : s + step]
            # a word of the text alone, of the end alone, or of both
            words = [some[:, k, None] if 4 * k + 4 <= length else tail[k] if 4 * k >= length else some[:, k, None] | tail[k] for k in range(16)]
            out[rows[s : s + step]] = _md5_block(words, (len(some), len(ends)))
    return out


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def xxhash64_on(hashes: np.ndarray, numbers: np.ndarray, wide: bool = False) -> np.ndarray:
    """Spark's ``xxhash64`` carried on by one more column, of ints or (``wide``) of longs."""
    x = numbers.astype(np.int64).astype(np.uint64)
    if wide:
        h = (hashes + _P5 + np.uint64(8)) ^ (_turned(x * _P2, 31) * _P1)
        h = _turned(h, 27) * _P1 + _P4
    else:
        h = (hashes + _P5 + np.uint64(4)) ^ ((x & np.uint64(0xFFFFFFFF)) * _P1)
        h = _turned(h, 23) * _P2 + _P3
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))
