"""Seeded hashes that any engine with MD5 can reproduce."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, functions as F

HASH_BITS = 60
# Hashes made side by side, so that the arrays stay in the cache.
_AT_ONCE = 1 << 15
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_STEPS = [(int(abs(math.sin(i + 1)) * 2**32), turn) for i, turn in enumerate(
    turn for turns in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for turn in turns * 4)]


def seeded_hash(seed: int | str, *ids: Column) -> Column:
    """Uniform 60-bit hash of ``seed|id`` as a bigint (first fifteen hex digits of MD5)."""
    text = F.concat_ws("|", F.lit(str(seed)), *[i.cast("string") for i in ids])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def _md5_head(words: list, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of the MD5 state after one block of sixteen ``words``: numbers, or
    arrays that spread over ``shape``."""
    a, b, c, d = (np.full(shape, x, np.uint32) for x in _START)
    f, high = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i, (constant, turn) in enumerate(_STEPS):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
            k = i
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
            k = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
            k = (3 * i + 5) % 16
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
            k = 7 * i % 16
        if isinstance(words[k], int):
            constant = (constant + words[k]) & 0xFFFFFFFF
        else:
            f += words[k]
        f += np.uint32(constant)
        f += a
        np.left_shift(f, np.uint32(turn), out=high)
        f >>= np.uint32(32 - turn)
        f |= high
        f += b
        a, b, c, d, f = d, f, b, c, a
    a += np.uint32(_START[0])
    b += np.uint32(_START[1])
    return a, b


def _block_words(texts: list[bytes], before: int) -> np.ndarray:
    """Texts of one length as sixteen words each, ``before`` bytes into an MD5 block."""
    block = np.zeros((len(texts), 64), np.uint8)
    size = len(texts[0])
    block[:, before:before + size] = np.frombuffer(b"".join(texts), np.uint8).reshape(len(texts), size)
    return block.view("<u4").astype(np.uint32)


def _of_one_length(leads: list[bytes], tails: list[bytes]) -> np.ndarray:
    """``seeded_hashes`` of leads of one length and tails of one length, in one MD5 block."""
    size = len(leads[0]) + len(tails[0]) + 1
    head, rest = _block_words(leads, 0), _block_words([t + b"\x80" for t in tails], len(leads[0]))
    out = np.empty((len(leads), len(tails)), np.uint64)
    step = max(1, _AT_ONCE // len(tails))
    for start in range(0, len(leads), step):
        own, words = head[start:start + step], []
        for k in range(16):
            in_lead, in_tail = 4 * k < len(leads[0]), len(leads[0]) < 4 * k + 4 and 4 * k < size
            if in_lead and in_tail:
                words.append(own[:, k, None] | rest[None, :, k])
            elif in_lead or in_tail:
                words.append(own[:, k, None] if in_lead else rest[None, :, k])
            else:
                words.append(8 * (size - 1) if k == 14 else 0)
        a, b = _md5_head(words, (len(own), len(tails)))
        part = out[start:start + step]
        part[:] = a.byteswap()
        part <<= np.uint64(32)
        part |= b.byteswap()
    return out >> np.uint64(64 - HASH_BITS)


def seeded_hashes(leads: list[bytes], tails: list[bytes]) -> np.ndarray:
    """Leads x tails of the hash that ``seeded_hash`` gives the text lead + tail, as uint64.

    The texts of one length go through the steps of MD5 together."""
    out = np.empty((len(leads), len(tails)), np.uint64)
    ranks = lambda texts: {n: np.array([i for i, t in enumerate(texts) if len(t) == n]) for n in {len(t) for t in texts}}
    for n, rows in ranks(leads).items():
        for m, columns in ranks(tails).items():
            own, others = [leads[i] for i in rows], [tails[i] for i in columns]
            if n + m <= 55:
                found = _of_one_length(own, others)
            else:  # more than one block
                digests = b"".join(hashlib.md5(a + b).digest() for a in own for b in others)
                found = np.frombuffer(digests, ">u8")[::2].reshape(len(own), -1).astype(np.uint64) >> np.uint64(64 - HASH_BITS)
            out[np.ix_(rows, columns)] = found
    return out
