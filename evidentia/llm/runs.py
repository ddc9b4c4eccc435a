"""Sorted runs of byte strings: front coding, and merging by a loser tree that knows common prefixes."""

from __future__ import annotations

import struct
from collections.abc import Iterator


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes need no look."""
    low, high = known, min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def front_code(strings: list[bytes]) -> bytes:
    """Sorted strings, each as the length it shares with the one before, the length of its rest, and the rest."""
    out, last = [], b""
    for s in strings:
        shared = common(last, s)
        out.append(struct.pack("<II", shared, len(s) - shared) + s[shared:])
        last = s
    return b"".join(out)


def front_decode(data: bytes) -> Iterator[tuple[bytes, int]]:
    """The strings of a run, each with the length it shares with the one before."""
    at, last = 0, b""
    while at < len(data):
        shared, rest = struct.unpack_from("<II", data, at)
        last = last[:shared] + data[at + 8 : at + 8 + rest]
        at += 8 + rest
        yield last, shared


def merge(runs: list[bytes]) -> Iterator[tuple[int, bytes, int]]:
    """All strings of front-coded runs in order: (run, string, length shared with the string before).

    Each inner node of the tree keeps the loser of its match and what the loser shares with the winner. The string that
    shares more with the last output is the smaller one, unseen; only strings that share equally much are compared, and
    from there on, so no byte of a known prefix is looked at again. Equal strings come in order of their runs.
    """
    streams = [front_decode(r) for r in runs]
    heads: list[tuple[bytes, int] | None] = [next(s, None) for s in streams]
    size = 1
    while size < max(len(runs), 1):
        size *= 2
    heads += [None] * (size - len(heads))
    losers = [-1] * size

    def match(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two runs' heads; what the loser shares is brought up to date."""
        x, y = heads[a], heads[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if x[1] != y[1]:
            return (a, b) if x[1] > y[1] else (b, a)
        shared = common(x[0], y[0], x[1])
        if (x[0][shared:], a) < (y[0][shared:], b):
            heads[b] = (y[0], shared)
            return a, b
        heads[a] = (x[0], shared)
        return b, a

    def first(node: int) -> int:
        if node >= size:
            return node - size
        winner, losers[node] = match(first(2 * node), first(2 * node + 1))
        return winner

    winner = first(1)
    while heads[winner] is not None:
        string, shared = heads[winner]
        yield winner, string, shared
        heads[winner] = next(streams[winner], None) if winner < len(streams) else None
        node = (winner + size) // 2
        while node:
            winner, losers[node] = match(winner, losers[node])
            node //= 2
