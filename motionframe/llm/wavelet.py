"""A wavelet tree over a permutation of ranks, in its level-wise layout, queried for many rectangles at once.

The tree answers which places of a range hold a value of another range: two-dimensional range reporting.  A level keeps one bit of
every value and the number of zeros before each place; below a node whose values all lie in the range, or of which none does,
nothing more is compared.
"""

from __future__ import annotations

import numpy as np


class WaveletTree:
    def __init__(self, values: np.ndarray) -> None:
        """``values``: whole numbers from 0."""
        self.depth = max(int(values.max(initial=0)).bit_length(), 1)
        self.zeros: list[np.ndarray] = []
        now = values.astype(np.int64)
        for level in range(self.depth):
            bit = (now >> (self.depth - 1 - level)) & 1
            self.zeros.append(np.concatenate([[0], np.cumsum(bit == 0)]))
            now = np.concatenate([now[bit == 0], now[bit == 1]])

    def report(self, low: np.ndarray, high: np.ndarray, least: np.ndarray, beyond: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rectangle, value) of every value in [least, beyond) at a place in [low, high); the arguments have one item a rectangle."""
        which = np.arange(len(low))
        value = np.zeros(len(low), dtype=np.int64)
        for level, zeros in enumerate(self.zeros):
            span = 1 << (self.depth - 1 - level)
            # the nodes below one with values from ``value`` on hold ``span`` values each; zeros stand before ones
            left_low, left_high = zeros[low], zeros[high]
            right_low, right_high = zeros[-1] + low - left_low, zeros[-1] + high - left_high
            left = (left_low < left_high) & (least[which] < value + span) & (beyond[which] > value)
            right = (right_low < right_high) & (least[which] < value + 2 * span) & (beyond[which] > value + span)
            low, high = np.concatenate([left_low[left], right_low[right]]), np.concatenate([left_high[left], right_high[right]])
            value = np.concatenate([value[left], value[right] + span])
            which = np.concatenate([which[left], which[right]])
        again = high - low  # more than one only where a value stands at several places
        return np.repeat(which, again), np.repeat(value, again)
