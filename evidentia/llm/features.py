"""Hashed word and character n-gram features of whole texts, in numpy."""

from __future__ import annotations

import functools

import numpy as np

from evidentia.llm.common import mixed

BASE = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.uint32(32)


@functools.cache
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)


def letters_only(text: str) -> np.ndarray:
    """Lower-case code points; every run of other characters is one space, as are the ends."""
    points = code_points(f" {text.lower()} ")
    is_letter = letters()[points]
    points = np.where(is_letter, points, SPACE)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    keep[0] = True
    return points[keep]


def char_ngrams(points: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Hashes (``bits`` wide) of all runs of ``n`` code points."""
    if len(points) < n:
        return np.empty(0, dtype=np.int64)
    wide = points.astype(np.uint64)
    h = np.full(len(points) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        h = h * BASE + wide[i : len(points) - n + 1 + i]
    return (mixed(h) >> np.uint64(64 - bits)).astype(np.int64)


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse modulo 2**64, to the powers 0 to n."""
    up = np.full(n + 1, BASE, dtype=np.uint64)
    down = np.full(n + 1, np.uint64(pow(int(BASE), -1, 1 << 64)), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_hashes(points: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word (run without ASCII white space), in order."""
    space = (points == 32) | ((points >= 9) & (points <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([1], space.view(np.int8), [1]))))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    # powers for a rounded-up length, so that few tables are ever made
    up, down = _powers(1 << int(len(points)).bit_length())
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[: len(points)])))
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def counted(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and their counts."""
    counts = np.bincount(ids, minlength=size)
    found = np.flatnonzero(counts)
    return found.astype(np.int32), counts[found].astype(np.float32)
