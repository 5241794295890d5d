"""Rows of two frames that are equal but for a tolerance, matched one to one without keys.

Rows stand as ``h1, h2`` (two 64-bit hashes of what has to be equal), ``values``
(their finite floating values), ``side`` (0 or 1) and ``n`` (how often the row
occurs). Equal rows of the two sides cancel before anything is matched.

The rest meet on a grid. ``u(x) = sign(x) log(1 + |x| rtol / atol) / rtol`` bends
the axis so that values within the tolerance of each other are less than two
apart, wherever they lie. Up to GRID of the floating columns, those with the most
values, are cut into cells of ``WIDTH`` times the number of rounds; every round
moves the grid by another share of a cell. Two close values have a cell border
between them in one round at most, so with one round more than grid columns every close
pair shares a whole cell in some round: no row is copied to neighbouring cells,
and a group with a third of all rows is as many keys as it has cells.

Within a cell rows come in order, and each takes the nearest row of the other side
that is close in every column and still free. A cell falls into clusters where
neighbours in a column are further apart than the tolerance. Clusters of one side pass,
and clusters of two rows are compared, for a whole batch at once; only in larger ones
rows come one by one and find each other in an index of small cells. A
round passes on what it left. At the end no two free rows are close to each other.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.lineage import cut_lineage

#: Columns that make up the grid, at most.
GRID = 3
#: Width of a cell and round, in units of the bent axis; close values are less than NEAR apart.
WIDTH = 64.0
NEAR = 2.0
#: Neighbours part two clusters when they are further apart than this many times the tolerance: more than rounding can make up.
APART = 1.001
COLUMNS = ["h1", "h2", "side", "n", "values"]


def _units(rtol: float, atol: float) -> tuple[float, float]:
    # Smaller tolerances than a double can tell apart would only cost precision of the axis.
    return max(rtol, 1e-13), max(atol, 1e-300)


def bent(x: Column, rtol: float, atol: float) -> Column:
    r, a = _units(rtol, atol)
    return F.signum(x) * F.log1p(F.abs(x) * (r / a)) / r


def _bent(x: float, r: float, a: float) -> float:
    return math.copysign(math.log1p(abs(x) * (r / a)) / r, x)


class _Free:
    """The free rows of one cell, by side and small cell."""

    def __init__(self, dims: Sequence[int], rtol: float, atol: float):
        self.dims, self.rtol, self.atol = dims, rtol, atol
        self.units = _units(rtol, atol)
        self.rows: list[dict[tuple, list[list]]] = [{}, {}]
        self.steps = list(itertools.product((-1, 0, 1), repeat=len(dims)))

    def place(self, values: list[float]) -> tuple:
        return tuple(math.floor(_bent(values[d], *self.units) / NEAR) for d in self.dims)

    def distance(self, e: list[float], g: list[float]) -> "float | None":
        """How far two rows are apart, as a share of the tolerance; None beyond it."""
        worst = 0.0
        for x, y in zip(e, g):
            gap, most = abs(x - y), self.atol + self.rtol * abs(y)
            if gap > most:
                return None
            worst = max(worst, gap / most if most else 0.0)
        return worst

    def take(self, side: int, n: int, values: list[float]) -> None:
        """Match ``n`` copies of a row; those without a partner stay free."""
        place, other = self.place(values), self.rows[1 - side]
        near = []
        for step in self.steps:
            for row in other.get(tuple(p + s for p, s in zip(place, step)), ()):
                far = self.distance(row[1], values) if side else self.distance(values, row[1])
                if far is not None and row[0]:
                    near.append((far, row[1], row))
        for _, _, row in sorted(near, key=lambda x: x[:2]):
            used = min(n, row[0])
            row[0] -= used
            n -= used
            if not n:
                return
        self.rows[side].setdefault(place, []).append([n, values])

    def left(self) -> Iterator[tuple[int, int, list[float]]]:
        for side, places in enumerate(self.rows):
            for rows in places.values():
                yield from ((side, n, values) for n, values in rows if n)


def _match(dims: Sequence[int], rtol: float, atol: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
        plain = [batch.column(c).to_numpy() for c in ("h1", "h2", "cell", "side", "n")]
        return [*plain, batch.column("values").flatten().to_numpy().reshape(batch.num_rows, -1)]

    def out(h1: np.ndarray, h2: np.ndarray, side: np.ndarray, n: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        ends = pa.array(np.arange(len(n) + 1, dtype=np.int32) * np.int32(values.shape[1]))
        lists = pa.ListArray.from_arrays(ends, pa.array(values.reshape(-1)))
        return pa.RecordBatch.from_arrays([*map(pa.array, (h1, h2, side, n)), lists], names=COLUMNS)

    def apart(x: np.ndarray) -> np.ndarray:
        """Which ascending values lie beyond the tolerance of the one before: then so do all after it of all before it."""
        return np.diff(x) > APART * (atol + rtol * np.maximum(np.abs(x[1:]), np.abs(x[:-1])))

    def clusters(rows: list[np.ndarray]) -> np.ndarray:
        h1, h2, cell, _, _, values = rows
        return np.flatnonzero(np.r_[True, (np.diff(h1) != 0) | (np.diff(h2) != 0) | (np.diff(cell) != 0) | apart(values[:, 0])])

    def split(rows: list[np.ndarray], label: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Clusters parted along the other columns too; their rows keep their order."""
        for d in range(1, rows[5].shape[1]):
            order = np.lexsort((rows[5][:, d], label))
            label[order] = np.cumsum(np.r_[True, (np.diff(label[order]) != 0) | apart(rows[5][order, d])])
        order = np.argsort(label, kind="stable")
        return [c[order] for c in rows], np.flatnonzero(np.r_[True, np.diff(label[order]) != 0])

    def feed(free: _Free, rows: list[np.ndarray]) -> None:
        for row in zip(*(c.tolist() for c in rows[3:])):
            free.take(*row)

    def rest(free: _Free, h1: int, h2: int) -> Iterator[pa.RecordBatch]:
        if left := list(free.left()):
            side, n, values = zip(*left)
            yield out(np.full(len(n), h1), np.full(len(n), h2), np.array(side, np.int32), np.array(n), np.array(values))

    def settled(rows: list[np.ndarray], starts: np.ndarray, parted: bool = False) -> Iterator[pa.RecordBatch]:
        """What whole clusters leave."""
        h1, h2, _, side, n, values = rows
        size = np.diff(np.r_[starts, len(n)])
        ones = np.add.reduceat(side, starts)
        mixed, n = (ones > 0) & (ones < size), n.copy()
        first = starts[mixed & (size == 2)]
        e, g = first + side[first], first + 1 - side[first]
        gaps = np.abs(values[e] - values[g])
        met = (gaps <= atol + rtol * np.abs(values[g])).all(axis=1)
        e, g = e[met], g[met]
        used = np.minimum(n[e], n[g])
        n[e] -= used
        n[g] -= used
        crowds = mixed & (size > 2)
        if parted:
            for start, stop in zip(starts[crowds], (starts + size)[crowds]):
                feed(free := _Free(dims, rtol, atol), [c[start:stop] for c in rows])
                yield from rest(free, h1[start], h2[start])
        elif crowds.any():
            label = np.repeat(np.arange(len(starts)), size)
            inside = crowds[label]
            yield from settled(*split([c[inside] for c in rows], label[inside]), parted=True)
        keep = (n > 0) & ~np.repeat(crowds, size)
        if keep.any():
            yield out(h1[keep], h2[keep], side[keep], n[keep], values[keep])

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last cluster of a batch may go on in the next: it is held back, or, beyond a batch, what is free of it.
        held, free = None, None
        for batch in given:
            if not batch.num_rows:
                continue
            rows = arrays(batch) if held is None else [np.concatenate(c) for c in zip(held, arrays(batch))]
            starts = clusters(rows)
            if len(starts) == 1:
                free = free or _Free(dims, rtol, atol)
                feed(free, [c[:-1] for c in rows])
                held = [c[-1:] for c in rows]
                continue
            if free:
                feed(free, [c[: starts[1]] for c in rows])
                yield from rest(free, rows[0][0], rows[1][0])
                free, rows, starts = None, [c[starts[1] :] for c in rows], starts[1:] - starts[1]
            if len(starts) > 1:
                yield from settled([c[: starts[-1]] for c in rows], starts[:-1])
            held = [c[starts[-1] :] for c in rows]
        if free:
            feed(free, held)
            yield from rest(free, held[0][0], held[1][0])
        elif held:
            yield from settled(held, np.array([0]))

    def quiet(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            yield from batches(given)

    return quiet


def unmatched(rows: DataFrame, width: int, rtol: float, atol: float) -> DataFrame:
    """What is left of ``rows`` (COLUMNS, with ``width`` values each) when close rows of the two sides have been matched.

    Runs jobs and keeps the rounds' results in the shared folder.
    """
    if rtol >= 0.5:
        raise ValueError("without keys the relative tolerance must be below one half")
    balance = F.sum(F.when(F.col("side") == 0, F.col("n")).otherwise(-F.col("n")))
    uneven = rows.groupBy("h1", "h2", "values").agg(balance.alias("b")).where("b <> 0")
    left = cut_lineage(uneven.select("h1", "h2", F.when(F.col("b") > 0, 0).otherwise(1).alias("side"), F.abs("b").alias("n"), "values"), name="unmatched")
    distinct = left.agg(*[F.approx_count_distinct(F.get("values", F.lit(d))).alias(f"d{d}") for d in range(width)]).first()
    dims = sorted(range(width), key=lambda d: -distinct[d])[:GRID]
    rounds = len(dims) + 1
    for s in range(rounds):
        places = [F.floor(bent(F.get("values", F.lit(d)), rtol, atol) / (WIDTH * rounds) + s / rounds) for d in dims]
        celled = left.withColumn("cell", F.xxhash64(*places))
        dealt = celled.repartition("h1", "h2", "cell").sortWithinPartitions("h1", "h2", "cell", "values", "side")
        left = cut_lineage(dealt.mapInArrow(_match(dims, rtol, atol), "h1 long, h2 long, side int, n long, values array<double>"), name="unmatched")
    return left
