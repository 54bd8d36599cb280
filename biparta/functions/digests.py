"""The draws of ``hashing.draw_int`` for many texts at once: md5 on columns of words."""

from __future__ import annotations

from hashlib import md5
from math import sin

import numpy as np

# Texts that are hashed at once: their words stay in a core's cache.
TEXTS = 1 << 16
# Bytes of a text that fit in one block of md5.
BLOCK_BYTES = 55
# Fixed values of md5: additions, shifts, start, and the word that each step takes.
_ADD = [int(abs(sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_SHIFT = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_WORD = [*range(16), *[(5 * i + 1) % 16 for i in range(16)], *[(3 * i + 5) % 16 for i in range(16)], *[7 * i % 16 for i in range(16)]]


def _digests(words: list[np.ndarray | int], n: int) -> np.ndarray:
    """First 60 bits of the digests of n blocks, given as 16 columns (or one number for all)."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
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
        a += f
        word = words[_WORD[i]]
        if isinstance(word, np.ndarray):
            a += word
            word = 0
        a += np.uint32((_ADD[i] + word) & 0xFFFFFFFF)
        np.left_shift(a, np.uint32(_SHIFT[i]), out=t)
        a >>= np.uint32(32 - _SHIFT[i])
        a |= t
        a += b
        a, b, c, d = d, a, b, c
    first, second = (x.byteswap().astype(np.int64) for x in (a + np.uint32(_START[0]), b + np.uint32(_START[1])))
    return (first << 28) | (second >> 4)


def _by_size(texts: list[bytes]) -> dict[int, np.ndarray]:
    sizes = np.array([len(x) for x in texts], np.int64)
    return {int(k): np.flatnonzero(sizes == k) for k in np.unique(sizes)}


def _words(texts: list[bytes], places: np.ndarray, begin: int, size: int, tail: bool) -> np.ndarray:
    """Blocks with the texts of one size from byte ``begin``, as 16 columns of words; a tail ends the text."""
    rows = np.zeros((len(places), 64), np.uint8)
    rows[:, begin : begin + size] = np.frombuffer(b"".join([texts[i] for i in places]), np.uint8).reshape(len(places), size)
    if tail:
        rows[:, begin + size] = 0x80
        rows[:, 56:58] = np.frombuffer((8 * (begin + size)).to_bytes(2, "little"), np.uint8)
    return np.ascontiguousarray(rows.view("<u4").T)


def draws(heads: list[bytes], tails: list[bytes]) -> np.ndarray:
    """The draw of each head followed by each tail: one row per head, one column per tail."""
    out = np.empty((len(heads), len(tails)), np.int64)
    tails_by = _by_size(tails)
    for h, these in _by_size(heads).items():
        for t, those in tails_by.items():
            if h + t > BLOCK_BYTES:
                for i in these:
                    digests = b"".join([md5(heads[i] + tails[j], usedforsecurity=False).digest() for j in those])
                    out[i, those] = (np.frombuffer(digests, ">u8")[::2] >> 4).astype(np.int64)
                continue
            first, second = _words(heads, these, 0, h, False), _words(tails, those, h, t, True)
            for lo in range(0, len(those), TEXTS):
                some = second[:, lo : lo + TEXTS]
                step = max(1, TEXTS // some.shape[1])
                for at in range(0, len(these), step):
                    rows = first[:, at : at + step]
                    n = rows.shape[1] * some.shape[1]
                    # a word that is the same in all texts is a number
                    words = [int(x[0] | y[0]) if (x == x[0]).all() and (y == y[0]).all() else (x[:, None] | y).reshape(-1) for x, y in zip(rows, some, strict=True)]
                    out[np.ix_(these[at : at + step], those[lo : lo + TEXTS])] = _digests(words, n).reshape(rows.shape[1], -1)
    return out
