"""Poisson counts by MD5 digests, for many texts at once: inside of tasks, on arrays.

``hashlib`` and the engine's function take one text at a time, which is most of the time of a bootstrap.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa

#: Fixed values of the digest: rotations, constants, start.
_TURNS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_ADD = [np.uint32(math.floor(abs(math.sin(i + 1)) * (1 << 32))) for i in range(64)]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
#: What a digest takes at once, besides the byte and the length that end it.
_SHORT = 55
#: Digests in one go of array operations.
_AT_ONCE = 1 << 17


def poisson_limits() -> list[float]:
    """Where a uniform number goes from one Poisson(1) count to the next."""
    out, p = [math.exp(-1)], math.exp(-1)
    for k in range(1, 11):
        p /= k
        out.append(out[-1] + p)
    return out


def _digests(prefixes: list[bytes], data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Four rows of 32-bit numbers, in the order of the digest's digits, for all texts after each prefix; of up to 55 bytes with it."""
    n = len(sizes)
    text = np.zeros((len(prefixes), n, 64), np.uint8)
    for own, prefix in zip(text, prefixes):
        p = len(prefix)
        own[:, :p] = np.frombuffer(prefix, np.uint8)
        for k in range(int(sizes.max(initial=0))):
            more = sizes > k
            own[more, p + k] = data[starts[more] + k]
        own[np.arange(n), p + sizes] = 0x80
        own.view("<u4")[:, 14] = (p + sizes) * 8
    words = np.ascontiguousarray(text.reshape(-1, 64).view("<u4").T)
    n = words.shape[1]
    a, b, c, d = (np.full(n, x) for x in _START)
    f, turned = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i, s in enumerate(_TURNS):
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
            np.bitwise_not(d, out=f)
            f |= b
            f ^= c
        f += a
        f += words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16]
        f += _ADD[i]
        np.right_shift(f, np.uint32(32 - s), out=turned)
        f <<= np.uint32(s)
        f |= turned
        f += b
        #: the old ``a`` is what the next round overwrites
        a, b, c, d, f = d, f, b, c, a
    return np.stack([x + y for x, y in zip((a, b, c, d), _START)]).byteswap()


def poisson_counts(keys: pa.Array, reps: int, seed: str) -> np.ndarray:
    """``reps`` rows of a count for each key (text without nulls): those of :func:`tracelake.operators.score.replicated`."""
    keys = keys.cast(pa.large_binary())
    ends = np.frombuffer(keys.buffers()[1], np.int64)[keys.offset : keys.offset + len(keys) + 1] if len(keys) else np.zeros(1, np.int64)
    data, sizes = np.frombuffer(keys.buffers()[2] or b"", np.uint8), np.diff(ends)
    blocks = (reps - 1) // 4 + 1
    prefixes = [f"{seed}:{b}:".encode() for b in range(blocks)]
    short = sizes + len(prefixes[-1]) <= _SHORT
    drawn = np.zeros((blocks, 4, len(keys)), np.uint32)
    at_once = max(1, _AT_ONCE // max(1, len(keys)))
    for b in range(0, blocks, at_once) if short.any() else ():
        some = prefixes[b : b + at_once]
        got = _digests(some, data, ends[:-1][short], sizes[short])
        drawn[b : b + at_once, :, short] = got.reshape(4, len(some), -1).transpose(1, 0, 2)
    for k in np.flatnonzero(~short):
        text = data[ends[k] : ends[k + 1]].tobytes()
        for b, prefix in enumerate(prefixes):
            drawn[b, :, k] = np.frombuffer(hashlib.md5(prefix + text, usedforsecurity=False).digest(), ">u4")
    drawn = drawn.reshape(4 * blocks, -1)[:reps]
    out = np.zeros(drawn.shape, np.uint8)
    for x in poisson_limits():
        out += drawn >= np.uint32(math.ceil(x * (1 << 32)))
    return out
