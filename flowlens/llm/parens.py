"""Balanced parentheses with excess blocks: a tree as bits, in which subtrees are ranges."""

from __future__ import annotations

import numpy as np


class Parens:
    """The bits of a forest in preorder (True opens a node, False closes it), and a range min-max tree over their excess.

    Excess is opened minus closed nodes up to a place. Blocks of `block` places know their smallest excess, blocks of
    blocks theirs, and so on; findclose() looks only into blocks that hold a smaller excess than the node's.
    """

    def __init__(self, bits: np.ndarray, block: int = 64):
        self.bits, self.block = bits, block
        self.excess = np.cumsum(np.where(bits, 1, -1))
        self.levels = [self._whole(self.excess)]
        while len(self.levels[-1]) > block:
            self.levels.append(self._whole(self.levels[-1].reshape(-1, block).min(1)))
        self.opens = np.flatnonzero(bits)
        pair = np.zeros(len(bits) + 1, np.int64)
        if len(bits) > 1:
            pair[1:-1] = np.cumsum(bits[:-1] & ~bits[1:])
        pair[-1] = pair[-2] if len(bits) else 0
        self.pairs = pair  # pairs "()" that open before each place

    def _whole(self, values: np.ndarray) -> np.ndarray:
        room = -len(values) % self.block
        return np.concatenate([values, np.full(room, np.iinfo(np.int64).max)])

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """Where the nodes that open at these places close: the first place after each with a smaller excess."""
        below = self.excess[at]
        level, place, out = np.zeros(len(at), np.int64), at.copy(), np.full(len(at), -1)
        # Up: right siblings within the block of each level.
        todo = np.arange(len(at))
        for k, values in enumerate(self.levels):
            inner = np.arange(self.block)
            own = place[todo] // self.block
            smaller = (values.reshape(-1, self.block)[own] < below[todo, None]) & (inner > (place[todo] % self.block)[:, None])
            hit = smaller.any(1)
            found = todo[hit]
            level[found], place[found] = k, own[hit] * self.block + smaller[hit].argmax(1)
            todo = todo[~hit]
            place[todo] //= self.block
            if not len(todo):
                break
        # Down: the first child of each block that holds a smaller excess.
        for k in range(len(self.levels) - 1, 0, -1):
            lower = np.flatnonzero(level == k)
            if len(lower):
                smaller = self.levels[k - 1].reshape(-1, self.block)[place[lower]] < below[lower, None]
                place[lower] = place[lower] * self.block + smaller.argmax(1)
                level[lower] = k - 1
        out[:] = place
        return out

    def leaves(self, at: np.ndarray, close: np.ndarray) -> np.ndarray:
        """Childless nodes in each subtree: pairs "()" that open from `at` to `close`."""
        return self.pairs[close] - self.pairs[at]

    def rank(self, place: np.ndarray) -> np.ndarray:
        """Nodes that open before each place."""
        return np.searchsorted(self.opens, place)
