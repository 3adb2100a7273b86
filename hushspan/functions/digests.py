"""The first four bytes of the MD5 of many short texts at once, by whole columns."""

from __future__ import annotations

import hashlib
import math

import numpy as np

#: Texts hashed together; their columns stay in a core's cache.
_SIDE = 1 << 14
#: Numbers below it have seven digits at most, so that each and a mark behind it fill eight bytes.
_TOP = 10_000_000
_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [int(abs(math.sin(n + 1)) * 2 ** 32) for n in range(64)]
#: Four digits of each number below 10,000, the first in the lowest byte.
_DIGITS = np.frombuffer("".join(f"{n:04d}" for n in range(10_000)).encode(), "<u4").astype(np.uint64)
_PIPE, _END = ord("|"), 0x80


def _numbers(values: np.ndarray, mark: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal numbers with a mark behind them as eight bytes, first in the lowest, and the bytes that each takes."""
    high = values // np.uint32(10_000)
    size = np.ones(len(values), np.uint8)
    for power in range(1, 7):
        size += values >= np.uint32(10 ** power)
    bits = size.astype(np.uint64) << np.uint64(3)
    text = (_DIGITS[high] | (_DIGITS[values - high * np.uint32(10_000)] << np.uint64(32))) >> (np.uint64(64) - bits)
    return text | (np.uint64(mark) << bits), bits + np.uint64(8)


def _first_word(message: list[np.ndarray | int]) -> np.ndarray:
    """The first of the four words of the MD5 of one block; `message` holds its 16 words, 0 where none has any."""
    size = len(message[0])
    a, b, c, d = (np.full(size, word, np.uint32) for word in (0x67452301, 0xefcdab89, 0x98badcfe, 0x10325476))
    f, g = np.empty(size, np.uint32), np.empty(size, np.uint32)
    # What the last three steps change are the other words.
    for n in range(61):
        kind, place = n >> 4, (n, 5 * n + 1, 3 * n + 5, 7 * n)[n >> 4] & 15
        if kind == 0:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif kind == 1:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif kind == 2:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        np.add(f, np.uint32(_SINES[n]), out=f)
        if not isinstance(message[place], int):
            np.add(f, message[place], out=f)
        by = _SHIFTS[kind][n & 3]
        np.left_shift(f, np.uint32(by), out=g)
        np.right_shift(f, np.uint32(32 - by), out=f)
        np.bitwise_or(f, g, out=f)
        np.add(f, b, out=f)
        # The old first word's column takes the next result.
        a, d, c, b, f = d, c, b, f, a
    return b + np.uint32(0x67452301)


def md5_heads(*numbers: np.ndarray) -> np.ndarray:
    """The first eight hexadecimal digits, as a number, of the MD5 of `a|b|c` for each three numbers from 0 on.

    What stands before the third number is made once where the first two stay the same.
    """
    out = np.empty(len(numbers[0]), np.uint32)
    word = np.uint64(64)
    for at in range(0, len(out), _SIDE):
        some = [n[at:at + _SIDE] for n in numbers]
        if min(n.min() for n in some) < 0 or max(n.max() for n in some) >= _TOP:
            out[at:at + _SIDE] = [int(hashlib.md5("|".join(map(str, row)).encode()).hexdigest()[:8], 16) for row in zip(*map(np.ndarray.tolist, some))]
            continue
        one, two, three = (n.astype(np.uint32) for n in some)
        fresh = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]))
        (one, by), (two, more), (three, last) = _numbers(one[fresh], _PIPE), _numbers(two[fresh], _PIPE), _numbers(three, _END)
        # A shift by 64 bits or more leaves nothing, nor does one by less than none, which wraps to a large number.
        front = (one | (two << by), two >> (word - by), by + more)
        first, second, by = (np.repeat(column, np.diff(fresh, append=len(three))) for column in front)
        columns = (first | (three << by), second | (three << (by - word)) | (three >> (word - by)), three >> (np.uint64(128) - by))
        message: list[np.ndarray | int] = [half for column in columns for half in np.ascontiguousarray(column.view("<u4").reshape(-1, 2).T)] + [0] * 10
        message[14] = (by + last - np.uint64(8)).astype(np.uint32)
        out[at:at + _SIDE] = _first_word(message).byteswap()
    return out
