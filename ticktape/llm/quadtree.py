"""A K-squared quadtree (K = 2) over a sparse matrix, and the joint walk of two of its rows over all columns.

The matrix is padded to a square whose side is a power of two.  A quadrant without a nonzero cell is not stored; one of
``LEAF`` cells a side is a leaf and holds its cells; any other has four quadrants.  Level by level the tree is one sorted array of the
Morton codes of the quadrants that are there, so a child is found by binary search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LEAF = 64


class Quadtree:
    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, n_rows: int, n_columns: int, leaf: int = LEAF):
        self.leaf, self.n_rows, self.n_columns = leaf, n_rows, n_columns
        self.height = max(0, -(-max(n_rows, n_columns, 1) // leaf) - 1).bit_length()
        code = _morton(row // leaf, column // leaf)
        order = np.argsort(code, kind="stable")
        self.row, self.column, self.value = row[order] % leaf, column[order] % leaf, value[order]
        leaves, self.begins = np.unique(code[order], return_index=True)
        self.begins = np.append(self.begins, len(order))
        self.levels = [leaves]
        for _ in range(self.height):
            self.levels.append(np.unique(self.levels[-1] >> 2))

    def has(self, level: int, r: int, c: int) -> bool:
        """Whether the quadrant at ``r``, ``c`` of ``level`` (0: leaves) has a nonzero cell."""
        return self._place(level, r, c) is not None

    def _place(self, level: int, r: int, c: int) -> int | None:
        codes, code = self.levels[level], int(_morton(np.int64(r), np.int64(c)))
        at = int(np.searchsorted(codes, code))
        return at if at < len(codes) and codes[at] == code else None

    def cells(self, r: int, c: int) -> np.ndarray:
        """The values of a leaf's place as a square, zeros included."""
        square = np.zeros((self.leaf, self.leaf), self.value.dtype)
        at = self._place(0, r, c)
        if at is not None:
            span = slice(self.begins[at], self.begins[at + 1])
            square[self.row[span], self.column[span]] = self.value[span]
        return square

    def pairs(self, first: range, second: range) -> Iterator[tuple[int, int, int, int, bool]]:
        """Walks two rows of quadrants at once: ``level, a, b, column, zero`` of quadrants that cover, once each, every column and every
        pair of a row of ``first`` and a row of ``second`` that is not above it.  ``zero``: both quadrants are all zero; they come as
        large as they are, and others as leaves.
        """
        waiting = [(self.height, 0, 0, 0)]
        while waiting:
            level, a, b, c = waiting.pop()
            side = self.leaf << level
            if a * side >= first.stop or (a + 1) * side <= first.start or b * side >= second.stop or (b + 1) * side <= second.start:
                continue
            if c * side >= self.n_columns:
                continue
            zero = not self.has(level, a, c) and not self.has(level, b, c)
            if zero or not level:
                yield level, a, b, c, zero
                continue
            rows = [(2 * a + i, 2 * b + j) for i in (0, 1) for j in (0, 1) if 2 * a + i <= 2 * b + j]
            waiting += [(level - 1, i, j, 2 * c + k) for i, j in rows for k in (0, 1)]


def _morton(r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Bits of row and column in turn, the row's first."""
    return (_spread(r) << 1) | _spread(c)


def _spread(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.int64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << shift)) & mask
    return x
