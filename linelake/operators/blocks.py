"""Distances between two blocks of vectors, within a task.

A product of both blocks in single precision tells which pairs may count: its error is bounded by the vectors' lengths,
and whatever the bound leaves open counts as well. Only these pairs' squared distances are worked out, in double
precision and in the order of the dimensions, so that every engine gets the same numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows of either block that are multiplied at once, pairs that are worked out at once.
ROWS, COLUMNS, PAIRS = 256, 4096, 1 << 16


def matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    """A list column as rows of `dim` numbers; what is missing is NaN."""
    lengths = np.asarray(column.value_lengths().fill_null(0))
    values = column.flatten()
    if not values.null_count and (lengths == dim).all():
        return np.asarray(values).reshape(-1, dim)
    out = np.full((len(column), dim), np.nan, values.to_numpy(zero_copy_only=False).dtype)
    for i, x in enumerate(column):
        if x.is_valid:
            out[i, : len(x)] = x.values.to_numpy(zero_copy_only=False)[:dim]
    return out


class Block:
    """Vectors as they came, in single precision, and half their squared lengths."""

    def __init__(self, v: np.ndarray):
        with np.errstate(all="ignore"):
            self.v, self.single = v, v.astype(np.float32, copy=False)
            self.half = np.einsum("ij,ij->i", v, v, dtype=np.float64) / 2
        self.half_single = self.half.astype(np.float32)

    def rows(self, lo: int, hi: int) -> Block:
        out = object.__new__(Block)
        out.v, out.single, out.half, out.half_single = (x[lo:hi] for x in (self.v, self.single, self.half, self.half_single))
        return out

    def __len__(self) -> int:
        return len(self.v)


def squared(a: Block, b: Block, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Squared distances of the given pairs, exactly as added up in double precision."""
    out = np.zeros(len(rows))
    for lo in range(0, len(rows), PAIRS):
        x, y, d = a.v[rows[lo : lo + PAIRS]], b.v[cols[lo : lo + PAIRS]], out[lo : lo + PAIRS]
        for j in range(x.shape[1]):
            d += (x[:, j].astype(np.float64) - y[:, j]) ** 2
    return out


def _scores(a: Block, b: Block) -> tuple[np.ndarray, np.ndarray]:
    """(|a|^2 - d2) / 2 of all pairs, about, and for each row of a by how much that may be off."""
    s = a.single @ b.single.T
    s -= b.half_single
    far = b.half.max(initial=0.0)
    return s, (a.v.shape[1] + 16) * 2.0**-22 * (a.half + far) + 1e-30


def _may(s: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose score is not below their row's bound; what can't be told is among them."""
    at = np.flatnonzero(~(s < bound.astype(np.float32)[:, None]))
    return np.divmod(at, s.shape[1])


def within(a: Block, b: Block, squared_radius: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of a, rows of b and squared distances, of the pairs that may lie within a radius: all that do, and few others."""
    with np.errstate(all="ignore"):
        for lo in range(0, len(a), ROWS):
            x = a.rows(lo, lo + ROWS)
            for at in range(0, len(b), COLUMNS):
                y = b.rows(at, at + COLUMNS)
                s, off = _scores(x, y)
                rows, cols = _may(s, x.half - squared_radius / 2 - off)
                if len(rows):
                    yield rows + lo, cols + at, squared(x, y, rows, cols)


def nearest(a: Block, b: Block, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a, rows of b, squared distances: the `most` nearest of b for each row of a, of equally near ones those of
    smaller id; NaN is furthest."""
    found = [_nearest(a.rows(lo, lo + ROWS), b, ids, most, lo) for lo in range(0, len(a), ROWS)]
    return tuple(np.concatenate(x) for x in zip(*found))


def _nearest(a: Block, b: Block, ids: np.ndarray, most: int, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    none = (len(a), most)
    col, d2, id2 = np.full(none, -1, np.int64), np.full(none, np.nan), np.full(none, np.iinfo(np.int64).max, np.int64)
    with np.errstate(all="ignore"):
        for at in range(0, len(b), COLUMNS):
            part = b.rows(at, at + COLUMNS)
            s, off = _scores(a, part)
            if not at and most < len(part):  # so many are at least about as near
                bound = np.partition(s, len(part) - most, axis=1)[:, len(part) - most] - 2 * off
            else:
                bound = a.half - d2[:, -1] / 2 - off
            rows, cols = _may(s, bound)
            if not len(rows):
                continue
            every = np.concatenate((np.repeat(np.arange(len(a)), most), rows))
            c, d, i = (np.concatenate((x.ravel(), y)) for x, y in ((col, cols + at), (d2, squared(a, part, rows, cols)), (id2, ids[cols + at])))
            order = np.lexsort((c < 0, i, d, every))
            every = every[order]
            place = np.arange(len(every)) - np.searchsorted(every, every)
            order, every, place = (x[place < most] for x in (order, every, place))
            col[every, place], d2[every, place], id2[every, place] = c[order], d[order], i[order]
    rows, places = np.nonzero(col >= 0)
    return rows + first, col[rows, places], d2[rows, places]
