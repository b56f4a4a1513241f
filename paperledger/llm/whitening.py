"""Whitening of embeddings by a covariance that is weighted by multiplicity.

Equal vectors are grouped first. The fit runs over the distinct ones with their counts (or one) as
weights: exact sums for the means, then a weighted product of the centred vectors in each task, whose
partial matrices Spark adds up row by row. Only the finished matrix, as large as the dimension squared,
reaches the driver. Each distinct vector is whitened once, and its values are joined back to the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import materialize, ship_package
from .common import look_up

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Components with less than this share of the trace have no direction in doubles: their values are 0.
LEAST_SHARE = 1e-13
#: Products of whole numbers under this fit 64 bits when added up.
SAFE = 1 << 62


def fixed_point(c: Column) -> Column:
    """The whole number that stands for an entry; what no long can hold becomes the outermost long."""
    return F.least(F.floor(c.cast("double") * SCALE), F.lit((1 << 63) - 1 - SHIFT)) + SHIFT


def usable(vector: Column) -> Column:
    """Neither null nor with entries that are null or not finite."""
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(True))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), -1)


def _far(x: np.ndarray) -> int:
    """The largest absolute value."""
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def _total(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact sum of the rows of x times their weights, as Python's whole numbers."""
    if _far(x) * int(w.sum()) < SAFE:
        return (w @ x).astype(object)
    return w.astype(object) @ x.astype(object)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: the weighted sum of each dimension, as text."""
    total = None
    for batch in batches:
        if batch.num_rows:
            s = _total(batch.column("weight").to_numpy(), _matrix(batch.column("x")))
            total = s if total is None else total + s
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array([str(int(v)) for v in total])], names=["i", "total"])


def exact_sums(vectors: DataFrame) -> list[int]:
    """Per dimension the weighted sum of (x, weight)."""
    rows = vectors.select("x", "weight").mapInArrow(_sums, "i int, total string").groupBy("i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    return [int(r["total"]) for r in sorted(rows, key=lambda r: r["i"])]


def centred(x: np.ndarray, sums: list[int], n: int) -> np.ndarray:
    """x minus sums / n. The whole part of the mean goes off exactly before anything is rounded."""
    base = [s // n for s in sums]
    rest = np.array([(s - b * n) / n for s, b in zip(sums, base, strict=True)])
    if max(_far(x), *map(abs, base)) >= SAFE:
        return (x.astype(object) - np.array(base, object)).astype(float) - rest
    return (x - np.array(base, np.int64)).astype(float) - rest


def _products(centre):
    """Per task: rows of the weighted product of the centred vectors with themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = None
        for batch in batches:
            if batch.num_rows:
                c = centre(_matrix(batch.column("x")))
                g = (c * batch.column("weight").to_numpy()[:, None]).T @ c
                gram = g if gram is None else gram + g
        if gram is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(gram), dtype=np.int32)), pa.array(list(gram), pa.list_(pa.float64()))], names=["i", "row"])

    return run


def _add(group: pa.Table) -> pa.Table:
    row = _matrix(group.column("row").combine_chunks()).sum(axis=0)
    return pa.table({"i": group.column("i")[:1], "row": pa.array([row], pa.list_(pa.float64()))})


def covariance(vectors: DataFrame, centre, n: int) -> np.ndarray:
    """Covariance of (x, weight) with divisor n, centred before the multiplication."""
    rows = vectors.select("x", "weight").mapInArrow(_products(centre), "i int, row array<double>")
    rows = rows.groupBy("i").applyInArrow(_add, "i int, row array<double>").toArrow().sort_by("i")
    return _matrix(rows.column("row").combine_chunks()) / n


def deviations(x: np.ndarray, sums: list[int], n: int) -> list[int]:
    """Exact sum over the dimensions of (n*x - S)^2 for each row of x."""
    base = [s // n for s in sums]
    rest = [s - b * n for s, b in zip(sums, base, strict=True)]
    if max(_far(x), *map(abs, base)) < SAFE:
        y = x - np.array(base, np.int64)
        far = _far(y)
        if far * far * len(base) >= SAFE or far * max(rest) * len(base) >= SAFE:
            y = y.astype(object)
    else:
        y = x.astype(object) - np.array(base, object)
    square, mixed = (y * y).sum(axis=1), y @ np.array(rest, y.dtype)
    own = sum(r * r for r in rest)  # (n*y - rest)^2 = n^2 y^2 - 2 n y rest + rest^2
    return [n * n * int(a) - 2 * n * int(b) + own for a, b in zip(square, mixed, strict=True)]


def principal(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a covariance, by falling eigenvalue: the first ``most`` unit eigenvectors (columns), the factors
    that make their variance 1 (0 without a direction), and their shares of the trace."""
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    trace = float(np.trace(v))
    on = e > max(trace, 0.0) * LEAST_SHARE
    factor = np.where(on, 1 / np.sqrt(np.where(on, e, 1.0)), 0.0)
    return u, factor, np.where(on, e, 0.0) / trace if trace > 0 else np.zeros(len(e))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8, weights: str = "counts") -> DataFrame:
    """vec_id, component (from 1), n, deviation (decimal, as text), whitened, explained, identity_error: one
    row for each usable row of ``vectors`` and component.

    Rows whose vector is null or holds null or non-finite entries drop out, and so do vectors of another
    length than most have (of two lengths equally frequent the larger counts): the entries that they lack
    are null. ``weights`` is "counts" (a vector of k rows counts k times in means and covariance) or "one"
    (once); n is the sum of the weights. Components beyond the dimension don't exist; a component without
    variance has whitened and explained 0, and identity_error, the largest entry of the whitened vectors'
    covariance minus the identity, is then 1. Null and repeated ids are rows like others. Without usable
    rows, or with vectors of length 0 alone, the result is empty. Other columns are not read.
    """
    if weights not in ("counts", "one"):
        raise ValueError("weights must be counts or one")
    ship_package(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")).where(usable(F.col("v")))
    rows = materialize(rows.select("vec_id", F.transform("v", fixed_point).alias("x")), "whitening-rows")
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    shape = "vec_id {id}, component int, n bigint, deviation string, whitened double, explained double, identity_error double"
    if not lengths or lengths[0]["d"] == 0:
        return rows.sparkSession.createDataFrame([], shape.format(id=rows.schema["vec_id"].dataType.simpleString()))
    rows = rows.where(F.size("x") == lengths[0]["d"])
    groups = rows.groupBy("x").agg(F.count(F.lit(1)).alias("n_rows"))
    groups = materialize(groups.withColumn("weight", F.col("n_rows") if weights == "counts" else F.lit(1).cast("long")), "whitening-distinct")
    n, total = groups.agg(F.sum("weight"), F.sum("n_rows")).first()
    sums = exact_sums(groups)
    v = covariance(groups, lambda x: centred(x, sums, n), n)
    axes, factor, share = principal(v, components)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"))
                z = centred(x, sums, n) @ axes * factor
                out = [batch.column("x"), batch.column("n_rows"), batch.column("weight"), pa.array([str(d) for d in deviations(x, sums, n)]), pa.array(list(z), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(out, names=["x", "n_rows", "weight", "deviation", "z"])

    white = materialize(groups.mapInArrow(project, "x array<bigint>, n_rows bigint, weight bigint, deviation string, z array<double>"), "whitening-white")
    means = white.select("weight", F.posexplode("z").alias("k", "z")).groupBy("k").agg(F.sum(F.col("z") * F.col("weight")).alias("s")).collect()
    mean = np.array([r["s"] for r in sorted(means, key=lambda r: r["k"])]) / n
    error = float(np.abs(covariance(white.select(F.col("z").alias("x"), "weight"), lambda z: z - mean, n) - np.eye(len(mean))).max())
    back = look_up(rows, white.select("x", "n_rows", "deviation", "z"), "x", "n_rows", total)
    shares = F.array(*(F.lit(float(s)) for s in share))
    return back.select("vec_id", "deviation", F.posexplode("z").alias("k", "whitened")).select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("k")).alias("explained"), F.lit(error).alias("identity_error")
    )
