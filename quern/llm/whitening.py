"""Whitening of embeddings by the polarisation identity, in exact integers.

Entries become integers, and each is centred on the integer next to its dimension's mean.
The squares of these values, and of the sums of each two dimensions, are aggregated
exactly. The fraction by which the centre misses the mean is taken off in integers, so
that all variances are exact, and differences of variances are the covariances:
2 cov(i, j) = var(i + j) - var(i) - var(j). Only numbers a dimension and a pair of
dimensions reach the driver, whatever the number of rows; it assembles them for eigh.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrays

#: x = floor(SCALE * entry) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Entries count as this in size at most: x and sums of two centred ones stay within a long.
LARGEST = 2.0**54
#: Rows squared at once.
BLOCK = 512

_LIMB = 60


@dataclass
class Model:
    """What the fit found: exact sums, and the components by falling eigenvalue."""

    n: int
    centre: np.ndarray  # (d,), the integers next to the means
    rest: list[int]  # sums of x - centre
    covariance: np.ndarray  # (d, d)
    eigenvalues: np.ndarray  # (k,)
    vectors: np.ndarray  # (d, k)

    @property
    def live(self) -> np.ndarray:
        """Which components have a variance above the rounding of eigh."""
        return self.eigenvalues > len(self.centre) * np.finfo(float).eps * max(self.eigenvalues.max(initial=0), 0)

    @property
    def explained(self) -> np.ndarray:
        trace = np.trace(self.covariance)
        return np.maximum(self.eigenvalues, 0) / trace if trace > 0 else np.zeros(len(self.eigenvalues))


def finite(vector: str) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    wrong = F.exists(vector, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(wrong, F.lit(False))


def vectors_of(rows: DataFrame, vector: str = "embedding", keep: str | None = None) -> tuple[DataFrame, int, int]:
    """The finite vectors of the length that most have (of equals the shortest), their length and number.

    The frame has `vector` as an array of doubles, before it `keep` as id.
    """
    kept = [] if keep is None else [F.col(keep).alias("id")]
    rows = rows.filter(finite(vector)).select(*kept, F.col(vector).cast("array<double>").alias("vector"))
    sizes = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"))
    found = sizes.filter("d > 0").orderBy(F.desc("n"), "d").first()
    d, n = (found["d"], found["n"]) if found else (0, 0)
    return rows.filter(F.size("vector") == d), d, n


def integers(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """x of each row and dimension."""
    values = arrays(pa.table([batch.column("vector")], ["vector"]), "vector")[1].reshape(-1, d)
    return np.floor(np.clip(values, -LARGEST, LARGEST) * SCALE).astype(np.int64) + OFFSET


def limbs(value: int) -> list[int]:
    """Longs p0, p1 ... with value = p0 + p1 * 2**60 + ...; sums of limbs are limbs of the sum."""
    out = []
    while not -(1 << 62) <= value < 1 << 62:
        out.append(value & ((1 << _LIMB) - 1))
        value >>= _LIMB
    return [*out, value]


def exact_sums(rows: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], list[int]]) -> list[int]:
    """Sums over all partitions of the integers that `partial` gives for each, as many as it gives."""

    def run(batches):
        found = [(i, p, v) for i, value in enumerate(partial(batches)) for p, v in enumerate(limbs(int(value)))]
        for at in range(0, len(found), 10_000):
            yield pa.record_batch([pa.array(c) for c in zip(*found[at : at + 10_000])], ["at", "part", "value"])

    parts = rows.mapInArrow(run, "at long, part long, value long").groupBy("at", "part")
    total: dict[int, int] = {}
    for at, part, value in zip(*(c.to_pylist() for c in parts.agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).toArrow().columns)):
        total[at] = total.get(at, 0) + (int(value) << (_LIMB * part))
    return [total[i] for i in range(len(total))]


def sums(rows: DataFrame, d: int) -> list[int]:
    """The exact sum of x for each dimension."""

    def partial(batches):
        low, high = np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            x = integers(batch, d)
            low += (x & 0xFFFFFFFF).sum(0)
            high += (x >> 32).sum(0)
        return [int(a) + (int(b) << 32) for a, b in zip(low, high)]

    return exact_sums(rows, partial)


def squares(centred: np.ndarray) -> list[np.ndarray]:
    """Exact sums over the rows of squares: of each dimension, then of its sum with each later one.

    One array a dimension. Doubles hold the sums where none can reach 2**53; else Python's
    integers do.
    """
    most = int(np.abs(centred).max(initial=0))
    columns = np.ascontiguousarray(centred.T).astype(np.float64 if len(centred) * (2 * most) ** 2 < 1 << 53 else object)
    out = []
    for i in range(len(columns)):
        both = columns[i] + columns[i + 1 :]
        own, pairs = (columns[i] ** 2).sum(), (both * both).sum(1) if columns.dtype == object else np.einsum("ij,ij->i", both, both)
        out.append(np.array([int(own), *map(int, pairs)], object))
    return out


def fit(rows: DataFrame, d: int, n: int, components: int = 32) -> Model:
    """The model of `n` vectors of `d` entries, all of `rows`. Eigenvectors have their largest entry positive."""
    total = sums(rows, d)
    centre = [(2 * s + n) // (2 * n) for s in total]
    rest = [s - n * c for s, c in zip(total, centre)]
    at = np.array(centre, np.int64)

    def partial(batches):
        found = [np.zeros(d - i, object) for i in range(d)]
        for batch in batches:
            centred = integers(batch, d) - at
            for b in range(0, len(centred), BLOCK):
                for i, s in enumerate(squares(centred[b : b + BLOCK])):
                    found[i] += s
        return np.concatenate(found).tolist()

    q = iter(exact_sums(rows, partial))
    square = [[next(q) for _ in range(i, d)] for i in range(d)]
    # n * n times the variances of the dimensions and of sums of two, less what the centres miss.
    own = [n * square[i][0] - rest[i] ** 2 for i in range(d)]
    covariance = np.zeros((d, d))
    for i in range(d):
        covariance[i, i] = own[i] / n**2
        for j in range(i + 1, d):
            both = n * square[i][j - i] - (rest[i] + rest[j]) ** 2
            covariance[i, j] = covariance[j, i] = (both - own[i] - own[j]) / (2 * n**2)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    vectors = vectors * np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(0)[None], 0)[0] < 0, -1.0, 1.0)
    return Model(n, at, rest, covariance, values, vectors)


def _deviations(centred: np.ndarray, model: Model) -> pa.Array:
    """Sums over the dimensions of (n * x - S)**2; null beyond 38 digits."""
    n, rest, d = model.n, model.rest, len(model.centre)
    most = n * int(np.abs(centred).max(initial=0)) + max(map(abs, rest))
    if d * most**2 < 1 << 63:
        return pa.array(((centred * n - np.array(rest, np.int64)) ** 2).sum(1)).cast(pa.decimal128(38, 0))
    found = ((centred.astype(object) * n - np.array(rest, object)) ** 2).sum(1)
    return pa.array([Decimal(v) if v < 10**38 else None for v in found], pa.decimal128(38, 0))


def _projected(centred: np.ndarray, model: Model) -> np.ndarray:
    """The centred rows on the live components, over the roots of their eigenvalues."""
    live = model.live
    missed = np.array([r / model.n for r in model.rest])
    return ((centred - missed) @ model.vectors[:, live]) / np.sqrt(model.eigenvalues[live])


def whiten(rows: DataFrame, model: Model) -> DataFrame:
    """id, deviation (decimal), whitened (an array, null for components without variance) of the rows (id, vector)."""
    d, places = len(model.centre), np.cumsum(model.live) - 1

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            centred = integers(batch, d) - model.centre
            flat, rows_ = _projected(centred, model), batch.num_rows
            out = np.full((rows_, len(places)), np.nan)
            out[:, model.live] = flat
            dead = np.broadcast_to(~model.live, out.shape).ravel()
            lists = pa.ListArray.from_arrays(np.arange(rows_ + 1, dtype=np.int32) * len(places), pa.array(out.ravel(), mask=dead))
            yield pa.record_batch([batch.column("id"), _deviations(centred, model), lists], ["id", "deviation", "whitened"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, deviation decimal(38,0), whitened array<double>")


def identity_error(rows: DataFrame, model: Model) -> float | None:
    """The largest absolute entry of the whitened vectors' covariance less the identity, measured on all rows.

    The vectors are centred already: their exact mean was taken off. Null where no component has variance.
    """
    d, k = len(model.centre), int(model.live.sum())
    if not k:
        return None
    upper = np.triu_indices(k)

    def run(batches):
        total = np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                w = _projected(integers(batch, d) - model.centre, model)
                total += w.T @ w
        yield pa.record_batch([pa.array(upper[0]), pa.array(upper[1]), pa.array(total[upper])], ["i", "j", "s"])

    found = rows.mapInArrow(run, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    return float(found.select(F.max(F.abs(F.col("s") / model.n - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)))).first()[0])


def whitened(rows: DataFrame, components: int = 32, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row a vector and component.

    Dropped are null and empty vectors, those with null or non-finite entries, and those of
    another length than most have (of equally many the shortest). All others are fitted on
    and returned: repeated rows and ids count each, null ids too. Vectors with fewer
    dimensions than `components` have that many. Entries beyond 2**54 in size count as
    that. deviation is exact, null beyond 38 digits. Components without variance have a
    null `whitened` and do not enter identity_error. Of equal eigenvalues any basis may be
    taken. No vectors give no rows. Other columns are not read.
    """
    kept, d, n = vectors_of(rows, vector, key)
    schema = f"vec_id {kept.schema['id'].dataType.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not n:
        return rows.sparkSession.createDataFrame([], schema)
    model = fit(kept.select("vector"), d, n, components)
    error = F.lit(identity_error(kept.select("vector"), model)).cast("double")
    rows = whiten(kept, model).select(F.col("id").alias("vec_id"), "deviation", F.posexplode("whitened").alias("at", "whitened"))
    share = F.element_at(F.array(*(F.lit(float(e)) for e in model.explained)), F.col("at") + 1)
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), error.alias("identity_error"))
