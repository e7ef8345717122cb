"""Where a sequence of symbols can be cut because no vocabulary entry reaches across."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Entries (arrays of symbols) by length, as hashes.

    Hashes that clash only make a boundary look crossed that is not, so what
    is cut is always right to cut.
    """

    def __init__(self, entries: list[np.ndarray]):
        by_length: dict[int, list[np.ndarray]] = {}
        for x in entries:
            by_length.setdefault(len(x), []).append(x)
        self.known = {}
        for n in sorted(n for n in by_length if n > 1):
            hashed = np.zeros(len(by_length[n]), dtype=np.uint64)
            stacked = np.stack(by_length[n]).astype(np.uint64)
            for j in range(n):
                hashed = hashed * BASE + stacked[:, j] + np.uint64(1)
            self.known[n] = np.unique(hashed)

    def cuts(self, symbols: np.ndarray) -> np.ndarray:
        """Positions i so that no entry holds symbols i - 1 and i together."""
        n = len(symbols)
        open_at = np.ones(n + 1, dtype=bool)  # the boundary before each symbol, not crossed so far
        open_at[[0, n]] = False
        hashed, s, length = np.zeros(n, dtype=np.uint64), symbols.astype(np.uint64) + np.uint64(1), 0
        for size, known in self.known.items():
            while length < size:  # the hash of the ``length`` symbols from each position on
                hashed = hashed[: n - length] * BASE + s[length:]
                length += 1
                if length > n:
                    return np.flatnonzero(open_at)
            left = np.cumsum(open_at)
            at = np.flatnonzero(left[size - 1 : n] > left[: n - size + 1])  # a boundary inside is open
            if not len(at):
                if not left[-1]:
                    break
                continue
            want = hashed[at]
            at = at[known[np.minimum(np.searchsorted(known, want), len(known) - 1)] == want]
            change = np.bincount(at + 1, minlength=n + 2) - np.bincount(at + size, minlength=n + 2)
            open_at &= np.cumsum(change)[: n + 1] == 0
        return np.flatnonzero(open_at)

    def parts(self, word: bytes) -> list[bytes]:
        edges = [0, *self.cuts(np.frombuffer(word, dtype=np.uint8)).tolist(), len(word)]
        return [word[a:b] for a, b in zip(edges, edges[1:], strict=False)]
