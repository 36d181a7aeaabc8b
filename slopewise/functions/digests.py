"""`hash_word` for many consecutive numbers at once, in a task that has them as an array."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

_MASK = 0xFFFFFFFF
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_ADDED = [int(abs(math.sin(i + 1)) * 4294967296.0) & _MASK for i in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_PICKS = [lambda i: i, lambda i: (5 * i + 1) % 16, lambda i: (3 * i + 5) % 16, lambda i: 7 * i % 16]


def hash_words(before: str, count: int, after: str, most: int) -> Iterator[np.ndarray]:
    """First 32-bit word of md5 over `before`, a number and `after`, for the numbers 1..count in order, at most `most` at a time.

    `hash_word` of columns gives the same words; md5 of neighbouring numbers is arithmetic on arrays here.
    """
    lead, tail = before.encode(), after.encode()
    lo = 1
    while lo <= count:
        digits = len(str(lo))
        hi = min(count + 1, 10 ** digits, lo + most)
        yield _first_words(lead, np.arange(lo, hi, dtype=np.int64), digits, tail)
        lo = hi


def _first_words(lead: bytes, numbers: np.ndarray, digits: int, tail: bytes) -> np.ndarray:
    length = len(lead) + digits + len(tail)
    blocks = (length + 8) // 64 + 1
    fixed = bytearray(lead + bytes(digits) + tail + b"\x80")
    fixed += bytes(64 * blocks - 8 - len(fixed)) + (8 * length).to_bytes(8, "little")
    words: list = [int.from_bytes(fixed[4 * i:4 * i + 4], "little") for i in range(16 * blocks)]
    for k in range(digits):
        at, digit = len(lead) + k, (numbers // 10 ** (digits - 1 - k) % 10 + 48).astype(np.uint32)
        words[at // 4] = words[at // 4] + (digit << np.uint32(8 * (at % 4)))
    words = [w if isinstance(w, int) else w.astype(np.uint32) for w in words]
    state = [np.full(len(numbers), x, np.uint32) for x in _START]
    for i in range(blocks):
        state = _mixed(state, words[16 * i:16 * i + 16])
    return state[0].byteswap()


def _mixed(state: list[np.ndarray], words: list) -> list[np.ndarray]:
    a, b, c, d = (x.copy() for x in state)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        turn = i // 16
        if turn == 0:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif turn == 1:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif turn == 2:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.bitwise_not(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        word = words[_PICKS[turn](i)]
        np.add(f, a, out=f)
        if isinstance(word, int):
            np.add(f, np.uint32((word + _ADDED[i]) & _MASK), out=f)
        else:
            np.add(f, np.uint32(_ADDED[i]), out=f)
            np.add(f, word, out=f)
        by = _TURNS[turn][i % 4]
        np.left_shift(f, np.uint32(by), out=t)
        np.right_shift(f, np.uint32(32 - by), out=f)
        np.bitwise_or(f, t, out=f)
        np.add(f, b, out=f)
        # The old `a` is free now and takes the next round's `f`.
        a, b, c, d, f = d, f, b, c, a
    return [x + y for x, y in zip(state, (a, b, c, d), strict=True)]
