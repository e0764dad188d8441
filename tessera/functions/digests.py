"""MD5 of many short messages at once, for seeded draws: a digest for each letter of a text, where a call for each would be most of
the work. A message is 64 characters in ASCII, which all letters of a row share, a colon and a number."""

from __future__ import annotations

import math

import numpy as np

# RFC 1321.
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
SINES = [np.uint32(int(abs(math.sin(k + 1)) * 2**32)) for k in range(64)]
#: Bytes of the part that messages share: one block.
SHARED = 64
#: Digits of a number at most, with which it takes three words.
MOST_DIGITS = 10


def compressed(state: list[np.ndarray], words: dict[int, np.ndarray]) -> list[np.ndarray]:
    """The state after a block, for each message; words that are not given are zero."""
    a, b, c, d = (x.copy() for x in state)
    f, t = np.empty_like(a), np.empty_like(a)
    for k in range(64):
        turn = k // 16
        if turn == 0:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif turn == 1:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif turn == 2:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += SINES[k]
        word = words.get((k, 5 * k + 1, 3 * k + 5, 7 * k)[turn] % 16)
        if word is not None:
            f += word
        shift = SHIFTS[turn][k % 4]
        np.right_shift(f, np.uint32(32 - shift), out=t)
        f <<= np.uint32(shift)
        f |= t
        f += b
        a, d, c, b, f = d, c, b, f, a
    return [x + y for x, y in zip(state, (a, b, c, d), strict=True)]


def begun(shared: list[str]) -> list[np.ndarray]:
    """The states after the shared parts of messages, of 64 characters each."""
    if any(len(x) != SHARED for x in shared):
        raise ValueError(f"a shared part has other than {SHARED} characters")
    words = np.frombuffer("".join(shared).encode("ascii"), "<u4").reshape(len(shared), 16)
    return compressed([np.full(len(shared), s, np.uint32) for s in START], {k: words[:, k].copy() for k in range(16)})


def ended(states: list[np.ndarray], numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The digests of messages from the states after their shared parts and their numbers, as two halves that are read as
    hexadecimal digits are."""
    if len(numbers) and not 0 <= numbers.min() <= numbers.max() < 10**MOST_DIGITS:
        raise ValueError(f"a number has more than {MOST_DIGITS} digits")
    # a colon, the digits, and the bit that ends a message
    block, digits = np.zeros((len(numbers), 12), np.uint8), np.ones(len(numbers), np.int64)
    block[:, 0] = ord(":")
    for k in range(1, len(str(numbers.max(initial=0)))):
        digits += numbers >= 10**k
    rest = numbers.astype(np.uint64)
    for k in range(int(digits.max(initial=0))):
        rows = np.flatnonzero(digits > k)
        tens = rest // np.uint64(10)
        block[rows, digits[rows] - k] = (rest - tens * np.uint64(10))[rows] + ord("0")
        rest = tens
    block[np.arange(len(numbers)), digits + 1] = 0x80
    words = block.view("<u4")
    a, b, c, d = (x.byteswap().astype(np.uint64) for x in compressed(states, {**{k: words[:, k].copy() for k in range(3)}, 14: ((SHARED + 1 + digits) * 8).astype(np.uint32)}))
    return a << np.uint64(32) | b, c << np.uint64(32) | d
