"""Double-array tries over sequences of dense symbol numbers, built and walked level by level."""

from __future__ import annotations

import numpy as np

FREE = -2
ROOT = 0
# A group of up to so many children is fitted into so many of the first holes.
GROUP, HOLES = 64, 256


def dense(symbols: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Numbers from 0 for the symbols, by their first appearance in ``order``. Children that were not
    seen before so get numbers side by side."""
    _, first, inverse = np.unique(symbols[order], return_index=True, return_inverse=True)
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first, kind="stable")] = np.arange(len(first))
    numbers = np.empty(len(symbols), np.int64)
    numbers[order] = rank[inverse.ravel()]
    return numbers


class DoubleArray:
    """The child of slot s by symbol c is slot BASE[s] + c if CHECK[that slot] is s. A base may be
    negative, so that a lone child fits any free slot."""

    def __init__(self) -> None:
        self.base = np.zeros(1024, np.int64)
        self.check = np.full(1024, FREE, np.int64)
        self.check[ROOT] = -1
        self.top = 1

    def _grow(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, FREE, np.int64)])

    def _place(self, parent: int, codes: np.ndarray, holes: np.ndarray) -> None:
        """The children of one slot, where the first of the holes takes all of them."""
        offsets = codes - codes[0]
        start = self.top
        if len(codes) <= GROUP and len(holes):
            self._grow(int(holes[-1] + offsets[-1]) + 1)
            fits = (self.check[holes[:, None] + offsets] == FREE).all(axis=1)
            if fits.any():
                start = int(holes[np.argmax(fits)])
        self._grow(start + int(offsets[-1]) + 1)
        self.check[start + offsets] = parent
        self.base[parent] = start - codes[0]
        self.top = max(self.top, start + int(offsets[-1]) + 1)

    def _place_lone(self, parents: np.ndarray, codes: np.ndarray) -> None:
        """One child for each of the slots: the holes first, then new slots."""
        holes = np.flatnonzero(self.check[: self.top] == FREE)[: len(parents)]
        slots = np.concatenate([holes, self.top + np.arange(len(parents) - len(holes))])
        self._grow(int(slots[-1]) + 1)
        self.check[slots] = parents
        self.base[parents] = slots - codes
        self.top = max(self.top, int(slots[-1]) + 1)

    def add_level(self, at: np.ndarray, codes: np.ndarray) -> None:
        """The children ``codes`` of the slots ``at``. Rows come sorted as sequences, so equal slots
        are side by side, and so are equal children of a slot."""
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (codes[1:] != codes[:-1])
        parents, children = at[new], codes[new]
        starts = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1]]))
        sizes = np.diff(np.append(starts, len(parents)))
        for first, size in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            holes = np.flatnonzero(self.check[: self.top] == FREE)[:HOLES] if size <= GROUP else starts[:0]
            self._place(int(parents[first]), np.sort(children[first : first + size]), holes)
        lone = starts[sizes == 1]
        if len(lone):
            self._place_lone(parents[lone], children[lone])

    def step(self, at: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The slots that the symbols lead to; -1 where there is no such child."""
        slots = self.base[at] + codes
        inside = (slots >= 0) & (slots < self.top)
        return np.where(inside & (self.check[np.where(inside, slots, 0)] == at), slots, -1)

    def add(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Packs sorted sequences, given one after the other, and returns the slot of each symbol."""
        starts = np.cumsum(lengths) - lengths
        slots = np.empty(len(codes), np.int64)
        at = np.full(len(lengths), ROOT, np.int64)
        rows = np.arange(len(lengths))
        for depth in range(int(lengths.max(initial=0))):
            going = lengths[rows] > depth
            rows, at = rows[going], at[going]
            symbols = codes[starts[rows] + depth]
            self.add_level(at, symbols)
            at = self.step(at, symbols)
            slots[starts[rows] + depth] = at
        return slots
