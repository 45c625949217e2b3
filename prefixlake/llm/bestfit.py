"""Best-fit-decreasing packing with a segment tree over remaining capacities."""

from __future__ import annotations

import numpy as np


class CapacityTree:
    """Open windows by remaining capacity; finds the tightest that still has ``need`` room.

    Leaf ``c`` counts the open windows with exactly ``c`` tokens left and every inner node
    those below it, so the smallest sufficient capacity is one descent of the tree.
    """

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.width)
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _change(self, left: int, by: int) -> None:
        node = left + self.width
        while node:
            self.count[node] += by
            node >>= 1

    def add(self, left: int, window: int) -> None:
        if left > 0:
            self.windows[left].append(window)
            self._change(left, 1)

    def tightest(self, need: int) -> int | None:
        """Smallest capacity of at least ``need`` that some open window has left."""
        node = need + self.width
        if self.count[node]:
            return need
        while node > 1:  # the nearest subtree to the right that holds a window
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.width:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.width
            node >>= 1
        return None

    def take(self, left: int) -> int:
        self._change(left, -1)
        return self.windows[left].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The window of each piece and its offset there. Pieces are 1 to ``capacity`` long.

    Longer pieces come first and equal ones in the given order, so a rerun agrees.
    """
    window = np.zeros(len(lengths), dtype=np.int64)
    offset = np.zeros(len(lengths), dtype=np.int64)
    tree, opened = CapacityTree(capacity), 0
    for k in np.argsort(-np.asarray(lengths, dtype=np.int64), kind="stable").tolist():
        need = int(lengths[k])
        left = tree.tightest(need)
        if left is None:
            window[k], left = opened, capacity
            opened += 1
        else:
            window[k] = tree.take(left)
        offset[k] = capacity - left
        tree.add(left - need, int(window[k]))
    return window, offset
