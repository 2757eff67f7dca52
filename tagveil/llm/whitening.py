"""Whitening of embeddings: merged moments, principal axes, and a second pass that verifies them.

Entries become whole numbers first (floor(64 c) + 1,000,000), so sums and deviations are exact.
The fit is over distinct vectors. Each partition has its count, sums, mean and centred
scatter; Chan's formula merges two of these, in a tree. The axes are the eigenvectors of the
covariance (divisor n), on the driver. A second pass over the fit list whitens it, merges its
moments the same way and gives the largest deviation of its covariance from the identity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagveil.llm.common import dropped, stored

SCALE, SHIFT = 64.0, 1_000_000
#: Larger whole numbers are taken as this, so that no sum of two is too large for a long.
MOST_WHOLE = 1 << 61
COMPONENTS = 16
#: Rows of a block of the moments; and cells that the scatters of all lengths of vectors may have together.
BLOCK, MOST_CELLS = 4096, 1 << 25
#: An axis whose variance is below this share of the largest one's has none.
NO_VARIANCE = 1e-12

#: (n, sums, mean, scatter) of vectors of one length.
Moments = tuple[int, list[int], np.ndarray, np.ndarray]


def whole_vectors(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """The rows with ``_x``, their vector in whole numbers; rows whose vector is null, empty or holds a null or non-finite entry are left out."""
    wide = F.transform(F.col(f"`{column}`"), lambda c: c.cast("double"))
    fine = F.forall("_wide", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    whole = F.transform("_wide", lambda c: F.greatest(F.least(F.floor(c * SCALE), F.lit(MOST_WHOLE)), F.lit(-MOST_WHOLE)).cast("long") + SHIFT)
    return rows.withColumn("_wide", wide).where(fine & (F.size("_wide") > 0)).withColumn("_x", whole).drop("_wide")


def _matrices(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the vectors of each length in a batch."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    values, starts = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield at, values[starts[at][:, None] + np.arange(d)]


def exact_sums(x: np.ndarray) -> list[int]:
    """Column sums of whole numbers as Python's, in two halves that can't overflow."""
    low, high = x & 0xFFFFFFFF, x >> 32
    return [int(h) * 2**32 + int(lo) for h, lo in zip(high.sum(0), low.sum(0), strict=True)]


def moments(x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, scatter), centred before multiplying."""
    mean = x[0] + (x - x[0]).mean(0)
    centred = x - mean
    return len(x), mean, centred.T @ centred


def merged(a: tuple[int, np.ndarray, np.ndarray], b: tuple[int, np.ndarray, np.ndarray]) -> tuple[int, np.ndarray, np.ndarray]:
    """Chan's pairwise formula."""
    n = a[0] + b[0]
    gap = b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def merged_maps(a: dict[int, Moments], b: dict[int, Moments]) -> dict[int, Moments]:
    out = dict(a)
    for d, other in b.items():
        if d in out:
            n, mean, scatter = merged((out[d][0], *out[d][2:]), (other[0], *other[2:]))
            out[d] = (n, [p + q for p, q in zip(out[d][1], other[1], strict=True)], mean, scatter)
        else:
            out[d] = other
    if sum(d * d for d in out) > MOST_CELLS:
        raise ValueError(f"the vectors' lengths need more than {MOST_CELLS} cells of covariance")
    return out


def _fitted(distinct: DataFrame, view=lambda d, x: (x - SHIFT).astype(np.float64), sums: bool = True) -> dict[int, Moments]:
    """Moments of a table of vectors by length, merged in a tree; ``view`` is what is measured of each vector."""

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        own: dict[int, Moments] = {}
        for batch in batches:
            for _, whole in _matrices(batch.column("_x")):
                for k in range(0, len(whole), BLOCK):
                    x = whole[k : k + BLOCK]
                    n, mean, scatter = moments(view(x.shape[1], x))
                    own = merged_maps(own, {x.shape[1]: (n, exact_sums(x) if sums else [], mean, scatter)})
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(own)], pa.binary())], names=["moments"])

    def read(row) -> dict[int, Moments]:
        import pickle

        return pickle.loads(bytes(row["moments"]))

    return distinct.select("_x").mapInArrow(partition, "moments binary").rdd.map(read).treeReduce(merged_maps) if distinct.head(1) else {}


@dataclass
class Axes:
    """What vectors of one length are whitened with."""

    n: int
    sums: list[int]
    vectors: np.ndarray  # a column an axis
    variances: np.ndarray
    shares: np.ndarray
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def has(self) -> np.ndarray:
        """Axes with a variance."""
        return self.variances > NO_VARIANCE * max(self.variances[0], 0.0)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows on the axes, in units of the axes' deviations; NaN on an axis without variance."""
        # whole parts of the mean are taken off as whole numbers, so that nothing is rounded before it is centred
        floors = np.array([s // self.n for s in self.sums])
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        centred = (x - floors).astype(np.float64) - rest
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.has, (centred @ self.vectors) / np.sqrt(np.where(self.has, self.variances, 1.0)), np.nan)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact; None where it is no long."""
        gap = int(max(abs(int(x.max()) * self.n - min(self.sums)), abs(int(x.min()) * self.n - max(self.sums)))) if x.size else 0
        widest = max(abs(int(v)) for v in (x.min(), x.max())) * self.n
        if gap * gap * x.shape[1] < 2**63 and widest < 2**63 and max(map(abs, self.sums)) < 2**63:
            d = x * np.int64(self.n) - np.array(self.sums, np.int64)
            return (d * d).sum(1).tolist()
        out = [sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x]
        return [v if v < 2**63 else None for v in out]


def axes(found: Moments, components: int) -> Axes:
    n, sums, _, scatter = found
    cov = scatter / n
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    # one sign for all rows and all runs: the largest entry of an axis is positive
    top = vectors[np.abs(vectors).argmax(0), np.arange(len(values))]
    vectors = vectors * np.where(top < 0, -1.0, 1.0)
    trace = float(np.trace(cov))
    k = min(components, len(values))
    shares = values[:k] / trace if trace > 0 else np.full(k, np.nan)
    return Axes(n, sums, vectors[:, :k].copy(), values[:k].copy(), shares)


def fit(whole: DataFrame, components: int = COMPONENTS) -> dict[int, Axes]:
    """Axes by length of vector, over the distinct vectors of ``whole`` (_x), verified by a second pass."""
    distinct = stored(whole.select("_x").distinct())
    found = {d: axes(m, components) for d, m in _fitted(distinct).items()}
    checked = _fitted(distinct, lambda d, x: np.nan_to_num(found[d].whitened(x)), sums=False) if found else {}
    for d, (n, _, _, scatter) in checked.items():
        wanted = np.diag(found[d].has.astype(np.float64))
        found[d].identity_error = float(np.abs(scatter / n - wanted).max())
    dropped(distinct)
    return found


def whiten(rows: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for each remaining row and component.

    Vectors that differ in length are whitened with their equals; ``identity_error`` is that
    of a row's length. Repeated vectors weigh once in the fit and each get their rows; null
    and repeated keys are no matter. An axis along which the fit list does not vary has a null
    ``whitened``; with no variance at all ``explained`` is null as well. Entries beyond 2^61
    in whole numbers count as that; a deviation beyond a long is null. No row is left: no row.
    """
    whole = whole_vectors(rows.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{column}`").alias("_vector")), "_vector").select("_key", "_x")
    found = fit(whole, components)
    key_type = whole.schema["_key"].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _matrices(batch.column("_x")):
                own = found[x.shape[1]]
                k = len(own.variances)
                keys = batch.column("_key").take(pa.array(np.repeat(at, k)))
                deviation = np.repeat(np.arange(len(at)), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        keys, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(len(keys), own.n, np.int64)), pa.array(own.deviations(x), pa.int64()).take(pa.array(deviation)),
                        pa.array(own.whitened(x).ravel(), from_pandas=True), pa.array(np.tile(own.shares, len(at)), from_pandas=True), pa.array(np.full(len(keys), own.identity_error)),
                    ],
                    names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return whole.mapInArrow(apply, f"`{key}` {key_type}, component int, n long, deviation long, whitened double, explained double, identity_error double")
