"""Front-coded sorted runs of byte strings, and a loser tree that merges them without comparing known prefixes again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import zstandard

Item = tuple[int, bytes]  #: length of the prefix shared with the string before, string


def shared_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    n = min(len(a), len(b))
    while start < n and a[start] == b[start]:
        start += 1
    return start


def front_code(strings: list[bytes]) -> bytes:
    """A sorted run as shared prefix lengths, lengths of the rest, and the rests."""
    before, shared, rests = b"", [], []
    for s in strings:
        h = shared_prefix(before, s)
        shared.append(h)
        rests.append(s[h:])
        before = s
    head = np.array([shared, list(map(len, rests))], "<u4").tobytes()
    return zstandard.compress(len(strings).to_bytes(4, "little") + head + b"".join(rests), 3)


def front_decode(run: bytes) -> Iterator[Item]:
    raw = zstandard.decompress(run)
    n = int.from_bytes(raw[:4], "little")
    shared, sizes = np.frombuffer(raw, "<u4", 2 * n, 4).reshape(2, n).tolist()
    at, s = 4 + 8 * n, b""
    for h, size in zip(shared, sizes, strict=True):
        s = s[:h] + raw[at : at + size]
        at += size
        yield h, s


class LoserTree:
    """Merges sorted runs. ``lcp[i]`` is the length of the prefix that run i's string shares with the string given out
    last. Of two runs the one that shares more with it is the smaller; only where both share equally much are strings
    compared, from that place on, and what the comparison finds becomes the loser's ``lcp``."""

    def __init__(self, runs: list[Iterator[Item]]):
        self.runs, self.size = runs, 1 << max(0, len(runs) - 1).bit_length()
        self.text: list[bytes | None] = [None] * self.size
        self.lcp = [0] * self.size
        for i, run in enumerate(runs):
            if (first := next(run, None)) is not None:
                self.text[i] = first[1]
        self.loser = [0] * self.size
        won = [*([0] * self.size), *range(self.size)]
        for node in range(self.size - 1, 0, -1):
            won[node], self.loser[node] = self._play(won[2 * node], won[2 * node + 1])
        self.winner = won[1]

    def _play(self, a: int, b: int) -> tuple[int, int]:
        x, y = self.text[a], self.text[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        la, lb = self.lcp[a], self.lcp[b]
        if la != lb:
            return (a, b) if la > lb else (b, a)
        if x == y:
            self.lcp[max(a, b)] = len(x)
            return min(a, b), max(a, b)
        h = shared_prefix(x, y, la)
        if h == len(x) or h < len(y) and x[h] < y[h]:
            self.lcp[b] = h
            return a, b
        self.lcp[a] = h
        return b, a

    def __iter__(self) -> Iterator[tuple[int, bytes, int]]:
        """(length of the prefix shared with the string before, string, run), in order; equal strings by run."""
        text, lcp, loser, runs, size, play = self.text, self.lcp, self.loser, self.runs, self.size, self._play
        w = self.winner
        while (s := text[w]) is not None:
            yield lcp[w], s, w
            lcp[w], text[w] = next(runs[w], (0, None))
            node = (w + size) >> 1
            while node:
                w, loser[node] = play(w, loser[node])
                node >>= 1
