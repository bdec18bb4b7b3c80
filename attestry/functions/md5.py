"""The first 32 bits of MD5 for whole arrays of short texts: Spark's md5 takes one text at a time."""

from __future__ import annotations

from math import sin

import numpy as np

STARTS = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
ADDED = [int(abs(sin(i + 1)) * 2**32) for i in range(64)]
TURNS = [turns[i % 4] for turns in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for i in range(16)]
LEFT, RIGHT = [np.uint32(t) for t in TURNS], [np.uint32(32 - t) for t in TURNS]
#: Bytes of a text that fit one block, and hashes that are made at a time.
MOST_BYTES, TILE = 55, 16_384


def first_word(words: list[np.ndarray | int], size: int) -> np.ndarray:
    """The first eight hex digits as numbers, for `size` blocks given by their 16 little-endian words, each an array or one number for all."""
    a, b, c, d = (np.full(size, s, np.uint32) for s in STARTS)
    t, u = np.empty_like(a), np.empty_like(a)
    for i in range(61):  # the first word is settled three steps before the end
        if i < 16:
            np.bitwise_xor(c, d, out=t)
            t &= b
            t ^= d
            w = words[i]
        elif i < 32:
            np.bitwise_xor(b, c, out=t)
            t &= d
            t ^= c
            w = words[(5 * i + 1) % 16]
        elif i < 48:
            np.bitwise_xor(b, c, out=t)
            t ^= d
            w = words[(3 * i + 5) % 16]
        else:
            np.invert(d, out=t)
            t |= b
            t ^= c
            w = words[7 * i % 16]
        t += a
        if isinstance(w, int):
            t += np.uint32((ADDED[i] + w) % 2**32)
        else:
            t += w
            t += np.uint32(ADDED[i])
        np.left_shift(t, LEFT[i], out=u)
        np.right_shift(t, RIGHT[i], out=t)
        t |= u
        t += b
        a, b, c, d, t = d, t, b, c, a
    b += np.uint32(STARTS[0])
    return b.byteswap()


def drawn_means(xs: np.ndarray, begin: int, end: int, seed: int) -> np.ndarray:
    """For each draw b in begin..end: the mean of xs at md5("seed:b:i") mod n, over the places i in 0..n."""
    n, sums = len(xs), np.zeros(end - begin)
    for digits_b, b_from, b_to in of_one_length(begin, end):
        for digits_i, i_from, i_to in of_one_length(0, n):
            head = len(str(seed)) + digits_b + 2
            length = head + digits_i
            if length > MOST_BYTES:
                raise ValueError("the seed is too long")
            for at in range(i_from, i_to, TILE):
                places = np.arange(at, min(at + TILE, i_to))
                tail = digit_words(places, digits_i, head)
                tail[length // 4] = tail[length // 4] + np.uint32(0x80 << 8 * (length % 4))
                several = max(1, TILE // len(places))
                for b in range(b_from, b_to, several):
                    draws = np.arange(b, min(b + several, b_to))
                    first = digit_words(draws, digits_b, head - digits_b - 1)
                    for k, x in [*enumerate(f"{seed}:".encode()), (head - 1, ord(":"))]:
                        first[k // 4] = first[k // 4] + np.uint32(x << 8 * (k % 4))
                    words: list = [0] * 16
                    for k in range(length // 4 + 1):
                        words[k] = np.add.outer(first[k], tail[k]).ravel() if len(draws) > 1 or 4 * k + 4 > head else int(first[k][0])
                    words[14] = 8 * length
                    word = first_word(words, len(draws) * len(places))
                    word -= word // np.uint32(n) * np.uint32(n)
                    sums[b - begin : b - begin + len(draws)] += xs.take(word).reshape(len(draws), -1).sum(axis=1)
    return sums / n


def of_one_length(begin: int, end: int) -> list[tuple[int, int, int]]:
    """(digits, from, to): begin..end cut where numbers get longer."""
    edges = [(k, 0 if k == 1 else 10 ** (k - 1), 10**k) for k in range(1, len(str(end)) + 1)]
    return [(k, max(begin, lo), min(end, hi)) for k, lo, hi in edges if max(begin, lo) < min(end, hi)]


def digit_words(numbers: np.ndarray, digits: int, at: int) -> list[np.ndarray]:
    """The 16 words of a block that holds nothing but the decimal digits of each number, from byte `at` on."""
    words = [np.zeros(len(numbers), np.uint32) for _ in range(16)]
    for k in range(digits):
        digit = (numbers // 10 ** (digits - 1 - k) % 10 + ord("0")).astype(np.uint32)
        words[(at + k) // 4] += digit << np.uint32(8 * ((at + k) % 4))
    return words
