"""Exact joins of vectors by a least cosine, with pairs left out that triangle bounds exclude.

Angles between vectors are a metric. Each row knows its angles to a few pivots;
rows of one key and nearest pivot, of like angle to it, share a cell, of a
bounded number of rows. A cell keeps its least and largest angle to each pivot:
two rows of cells whose intervals lie further apart than the join's angle, for
any pivot, cannot match, so that such cells never meet. First the pivots'
regions are compared, then the cells of those that remain. What meets is a pair
of cells, in a task of its own; every pair that meets is still computed, and the
pivots only decide what needs not be. Where a sample shows that vectors lie too
evenly for that (many dimensions without groups), blocks of rows meet instead.

Either way two lists of rows meet in one task, as matrices: one product, in 32
bits, tells the pairs that come near the limit (and, where a row's best are
asked for, near those), by more than its rounding. Only theirs are summed in the
order of the dimensions, so that equal vectors have equal cosines wherever they
meet. Vectors may have any length.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as vx
from ..session import shared_checkpoint

#: Rows of a cell at most (about), pivots, and rows that pivots are chosen from.
CELL, PIVOTS, SAMPLE = 2048, 16, 2000
#: Radians that rounding may add to a difference of angles.
SLACK = 1e-6
#: Twice what rounding to 32 bits may add to a product of unit vectors, for each dimension.
FINE = 2.0**-23
#: The share of a sample's pairs that pivots must exclude to be used, and left rows of one product.
WORTH, STRIP = 0.3, 256


def usable(vector: Column) -> Column:
    """Neither null nor with a null in it."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull())


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; zero rows stay."""
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(size == 0, 1, size)


def _matrices(column: pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The rows' numbers and vectors, as one matrix for each number of dimensions."""
    lists = pa.concat_arrays(column.chunks)
    size = pc.list_value_length(lists).to_numpy()
    flat, start = lists.flatten().to_numpy(), np.cumsum(size) - size
    return [(at := np.flatnonzero(size == n), flat[start[at][:, None] + np.arange(n)]) for n in np.unique(size)]


def _summed(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Dot products of rows i of a and j of b over the shorter ones' dimensions, in their order."""
    out = np.zeros(len(i))
    for x, y in zip(a.T.copy(), b.T.copy(), strict=False):
        both = x[i]
        both *= y[j]
        out += both
    return out


def _hopeful(i: np.ndarray, near: np.ndarray, loose: float, top: int) -> np.ndarray:
    """Whether a pair may be among the ``top`` most similar ones of its i (ascending), of cosines known to ``loose``."""
    starts = np.flatnonzero(np.diff(i, prepend=-1))
    many = np.diff(starts, append=len(i))
    if len(i) == 0 or many.max() <= top:
        return np.ones(len(i), bool)
    ordered = np.sort(4.0 * i - np.where(np.isnan(near), -1.5, near))  # by i, the largest cosine first
    last = 4.0 * i[starts] - ordered[starts + np.minimum(many, top) - 1]
    return ~(near < np.repeat(last, many) - 2 * loose)


def _cosines(left: pa.ChunkedArray, right: pa.ChunkedArray, least: float, differ: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, top: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in both and cosine of the pairs with ``least`` or more (or that are no number), some left rows at a time. A zero vector's cosine is 0.

    With ``differ``, of pairs that differ, and of a left row's at least the
    ``top`` most similar ones of each length, with all their equals.
    """
    theirs = [(at, v, _unit(v).T.astype(np.float32, order="C"), _summed(v, v, own := np.arange(len(v)), own)) for at, v in _matrices(right)]
    for here, mine in _matrices(left):
        square = _summed(mine, mine, own := np.arange(len(mine)), own)
        for first in range(0, len(mine), STRIP):
            some, size = mine[first : first + STRIP], square[first : first + STRIP]
            unit, found = _unit(some).astype(np.float32), []
            for there, v, heads, sizes in theirs:
                n = min(some.shape[1], v.shape[1])
                near = (unit[:, :n] @ heads[:n]).ravel()
                loose = SLACK + (n + 8) * FINE
                at = np.flatnonzero(~(near < least - loose))
                i, j = np.divmod(at, len(v))
                if differ is not None:
                    keep = differ(here[first + i], there[j])
                    i, j, near = i[keep], j[keep], near[at[keep]]
                    keep = _hopeful(i, near, loose, top)
                    i, j = i[keep], j[keep]
                length = np.sqrt(size[i] * sizes[j])
                cosine = np.clip(np.where(length == 0, 0.0, _summed(some, v, i, j) / np.where(length == 0, 1, length)), -1, 1)
                keep = ~(cosine < least)
                found.append((here[first + i[keep]], there[j[keep]], cosine[keep]))
            yield tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _best(i: np.ndarray, j: np.ndarray, cosine: np.ndarray, place: np.ndarray, top: int) -> np.ndarray:
    """Of pairs the numbers of the ``top`` most similar ones of each i, the smallest place of j first among equals; what is no number is largest."""
    order = np.lexsort((place[j], -np.where(np.isnan(cosine), np.inf, cosine), i))
    starts = np.flatnonzero(np.diff(i[order], prepend=-1))
    return order[np.arange(len(order)) - np.repeat(starts, np.diff(starts, append=len(order))) < top]


def meet(left: DataFrame, right: DataFrame, by: list[str], least: float, top: tuple[str, str, int] | None = None) -> DataFrame:
    """Of rows (``by``, v, others) those pairs of equal ``by`` that have a cosine of ``least`` or more: by, others, cosine.

    The other columns need different names. ``top`` is a left and a right
    column and a number: of a left row, only that many pairs of different
    values, the most similar ones of those that meet in a task, are given.
    """
    own = [c for c in left.columns if c not in (*by, "v")]
    other = [c for c in right.columns if c not in (*by, "v")]
    fields = [*(left.schema[c] for c in (*by, *own)), *(right.schema[c] for c in other)]
    kinds = T.StructType([T.StructField(f.name, f.dataType) for f in fields] + [T.StructField("cosine", T.DoubleType())])

    def solve(a: pa.Table, b: pa.Table) -> pa.Table:
        parts = []
        if a.num_rows and b.num_rows and top is None:
            met = _cosines(a["v"], b["v"], least)
        elif a.num_rows and b.num_rows:
            place = pc.rank(b[top[1]], sort_keys="ascending", tiebreaker="dense").to_numpy()
            met = _cosines(a["v"], b["v"], least, lambda i, j: pc.fill_null(pc.not_equal(a[top[0]].take(i), b[top[1]].take(j)), False).to_numpy(), top[2])
            met = ((i[kept], j[kept], cosine[kept]) for i, j, cosine in met for kept in [_best(i, j, cosine, place, top[2])])
        else:
            met = ()
        for i, j, cosine in met:
            parts.append(pa.table([*(a[c].take(i) for c in (*by, *own)), *(b[c].take(j) for c in other), pa.array(cosine)], names=kinds.names))
        none = pa.table([*(a[c][:0] for c in (*by, *own)), *(b[c][:0] for c in other), pa.array([], pa.float64())], names=kinds.names)
        return pa.concat_tables([none, *parts])

    # Every column anew: the sides may be one table.
    sides = [x.filter(usable(F.col("v"))).select(*(F.col(c).alias(c) for c in (*by, *names)), vx.as_doubles(F.col("v")).alias("v")).groupBy(*by) for x, names in ((left, own), (right, other))]
    return sides[0].cogroup(sides[1]).applyInArrow(solve, kinds)


def useful_pivots(rows: DataFrame, id_col: str, least: float, count: int = PIVOTS) -> np.ndarray | None:
    """Vectors far from each other, of a sample by hash, a unit row each; None if their bounds exclude few of the sample's pairs."""
    if least <= 0:
        return None
    drawn = rows.select("v").orderBy(F.xxhash64(F.col(id_col).cast("string"))).limit(SAMPLE).collect()
    found = [r.v for r in drawn if r.v is not None and None not in r.v and any(r.v) and np.isfinite(r.v).all()]
    if len(found) < 2:
        return None
    size = max({len(v) for v in found}, key=[len(v) for v in found].count)
    sample = _unit(np.array([v for v in found if len(v) == size], float))
    picked, nearest = [0], sample @ sample[0]
    while len(picked) < min(count, len(sample)) and nearest.min() < 1 - 1e-9:
        picked.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, sample @ sample[picked[-1]])
    pivots, angle = sample[picked], math.acos(min(least, 1.0))
    angles = np.arccos(np.clip(sample @ pivots.T, -1, 1))
    region = angles.argmin(axis=1) * 1000 + (angles.min(axis=1) / _width(angle)).astype(int)
    cells = [angles[region == k] for k in np.unique(region)]
    low, high, n = np.array([c.min(axis=0) for c in cells]), np.array([c.max(axis=0) for c in cells]), np.array([len(c) for c in cells])
    gaps = (low[:, None, :] - high[None, :, :]).max(axis=2)
    excluded = np.maximum(gaps, gaps.T) > angle + SLACK
    return pivots if (excluded * n[:, None] * n[None, :]).sum() >= WORTH * n.sum() ** 2 else None


def _width(angle: float) -> float:
    """Radians of a ring around a pivot."""
    return max(angle / 2, 0.02)


def _placed(rows: DataFrame, key: str, id_col: str, pivots: np.ndarray, width: float) -> DataFrame:
    """``rows`` with their angles, region, and cell; rows without as many dimensions as the pivots, or with infinite ones, share an open region."""

    @F.pandas_udf("array<double>")
    def angles(vectors: pd.Series) -> pd.Series:
        fits = [len(v) == pivots.shape[1] and np.isfinite(v).all() for v in vectors]
        own = [v for v, fit in zip(vectors, fits, strict=True) if fit]
        found = iter(np.arccos(np.clip(_unit(np.stack(own)) @ pivots.T, -1, 1)) if own else ())
        return pd.Series([next(found) if fit else None for fit in fits], index=vectors.index, dtype=object)

    nearest = F.when(F.col("angles").isNull(), -1).otherwise(F.array_position("angles", F.array_min("angles")).cast("int") - 1)
    ring = F.when(F.col("angles").isNull(), 0).otherwise(F.floor(F.array_min("angles") / width).cast("int"))
    own = shared_checkpoint(rows.withColumn("angles", angles("v")).withColumns({"region": nearest, "ring": ring}))
    sizes = own.groupBy(key, "region", "ring").agg(F.ceil(F.count("*") / CELL).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.col("parts"))
    return own.join(sizes, [key, "region", "ring"]).withColumn("cell", F.concat_ws(":", "region", "ring", part)).drop("ring", "parts")


def _limits(rows: DataFrame, by: list[str], pivots: int, name: str) -> DataFrame:
    """Least and largest angles to each pivot per group; an open region's are all angles."""
    low = [F.coalesce(F.min(F.col("angles")[k]), F.lit(0.0)) for k in range(pivots)]
    high = [F.when(F.count("*") > F.count(F.col("angles")[k]), math.pi).otherwise(F.max(F.col("angles")[k])) for k in range(pivots)]
    return rows.groupBy(*by).agg(F.array(*low).alias(f"low{name}"), F.array(*high).alias(f"high{name}"), F.count("*").alias(f"n{name}"))


def _near(angle: float) -> Column:
    gap = F.greatest(*(F.array_max(F.zip_with(a, b, lambda x, y: x - y)) for a, b in (("low1", "high2"), ("low2", "high1"))))
    return gap <= angle + SLACK


def cell_pairs(left: DataFrame, right: DataFrame, key: str, pivots: int, angle: float, same: bool) -> DataFrame:
    """(key, cell1, cell2, n1, n2) of the cells that may hold a match; of one table, each pair once."""

    def side(rows: DataFrame, name: str, *by: str) -> DataFrame:
        return _limits(rows, [key, *by], pivots, name).withColumnsRenamed({b: f"{b}{name}" for b in by})

    regions = side(left, "1", "region").join(side(right, "2", "region"), key).filter(_near(angle)).select(key, "region1", "region2")
    if same:
        regions = regions.filter("region1 <= region2")
    met = side(left, "1", "region", "cell").join(regions, [key, "region1"]).join(side(right, "2", "region", "cell"), [key, "region2"]).filter(_near(angle))
    if same:
        met = met.filter("region1 < region2 or cell1 <= cell2")
    return shared_checkpoint(met.select(key, "cell1", "cell2", "n1", "n2"))


def _met(left: DataFrame, right: DataFrame, key: str, id1: str, id2: str, least: float, pivots: np.ndarray, same: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both tables' rows with cells, and the pairs of cells."""
    real = usable(F.col("v")) & F.exists("v", lambda x: x != 0)  # a zero vector's cosine is 0 and below any positive limit
    angle = math.acos(min(least, 1.0))
    one = _placed(left.filter(real), key, id1, pivots, _width(angle))
    two = one if same else _placed(right.filter(real), key, id2, pivots, _width(angle))
    return one, two, cell_pairs(one, two, key, len(pivots), angle, same)


def _joined(one: DataFrame, two: DataFrame, cells: DataFrame, key: str, names1: dict[str, str], names2: dict[str, str], least: float, top: tuple[str, str, int] | None = None) -> DataFrame:
    """The pairs of the rows of pairs of cells, with their columns (v aside) by other names."""
    cut = cells.select(key, "cell1", "cell2")
    first = one.select(key, F.col("cell").alias("cell1"), "v", *(F.col(a).alias(b) for a, b in names1.items())).join(cut, [key, "cell1"])
    second = two.select(key, F.col("cell").alias("cell2"), "v", *(F.col(a).alias(b) for a, b in names2.items())).join(cut, [key, "cell2"])
    return meet(first, second, [key, "cell1", "cell2"], least, top)


def pairs_within(rows: DataFrame, key: str, least: float, pivots: np.ndarray, id_col: str = "a") -> DataFrame:
    """Unordered pairs of rows of one key whose vectors ``v`` have a cosine of ``least`` (above 0) or more.

    Each once: ``key``, the other columns of either row under 1 and 2, and cosine.
    """
    one, two, cells = _met(rows, rows, key, id_col, id_col, least, pivots, True)
    names = [c for c in rows.columns if c not in (key, "v")]
    out = _joined(one, two, cells, key, {c: f"{c}1" for c in names}, {c: f"{c}2" for c in names}, least)
    return out.filter((F.col("cell1") != F.col("cell2")) | (F.col(f"{id_col}1") < F.col(f"{id_col}2"))).drop("cell1", "cell2")


def pairs_between(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str, least: float, pivots: np.ndarray, top: int | None = None) -> DataFrame:
    """Pairs of a left (``left_id``, v) and a right row (``right_id``, v) of one key with a cosine of ``least`` (above 0) or more, and cosine.

    With ``top``, a left row's best so many of other ids in each pair of cells.
    """
    one, two, cells = _met(left, right, key, left_id, right_id, least, pivots, False)
    best = None if top is None else (left_id, right_id, top)
    return _joined(one, two, cells, key, {left_id: left_id}, {right_id: right_id}, least, best).drop("cell1", "cell2")


def evaluated_pairs(rows: DataFrame, key: str, least: float, pivots: np.ndarray, id_col: str = "a") -> DataFrame:
    """(key, possible, met): pairs of rows of each key, and how many of them meet in a task."""
    one, _, cells = _met(rows, rows, key, id_col, id_col, least, pivots, True)
    met = cells.groupBy(key).agg(F.sum(F.when(F.col("cell1") == F.col("cell2"), F.col("n1") * (F.col("n1") - 1) / 2).otherwise(F.col("n1") * F.col("n2"))).cast("long").alias("met"))
    return one.groupBy(key).agg((F.count("*") * (F.count("*") - 1) / 2).cast("long").alias("possible")).join(met, key)
