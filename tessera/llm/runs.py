"""Numbered runs of token ids, and numbers for strings as they come."""

from __future__ import annotations

import numpy as np


class Runs:
    """Numbered runs of ids, in one array."""

    def __init__(self):
        self.ids, self.start = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(counts)])
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])

    def take(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs' ids in a row, and each run's length."""
        first = self.start[codes]
        n = self.start[codes + 1] - first
        shift = first - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else first
        return self.ids[np.repeat(shift, n) + np.arange(int(n.sum()))], n


class Codes(dict):
    """Numbers keys as they come; ``new`` lists those that have come since it was emptied."""

    def __init__(self):
        self.new: list = []

    def __missing__(self, key):
        code = self[key] = len(self)
        self.new.append(key)
        return code


def run_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs of ``sizes`` values."""
    total = np.concatenate([[0], np.cumsum(values)])
    return np.diff(np.concatenate([[0], total[np.cumsum(sizes)]])).astype(np.int64)
