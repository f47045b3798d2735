"""Embedding whitening by Chebyshev-filtered subspace iteration.

Entries become integers, x = floor(scale * c) + shift, so that sums are exact and every row is centred without rounding:
n x - S is an integer. One pass of the iteration multiplies the covariance with a block of vectors: each task computes
XᵀXQ / n of its centred rows, batch by batch, and the small products are added up; the covariance itself is never formed. A Chebyshev
polynomial of such passes damps the unwanted part of the spectrum, [0, smallest Ritz value of the block]; its degree is held so
low that the strongest vector does not drown the weakest wanted one. Then QR, Rayleigh-Ritz, and the residuals of the wanted pairs.
It ends when these are below `tol` of the largest eigenvalue and no longer halve; if it takes long, the block is widened, up to all dimensions, where
one step is exact. Failing that it raises.

Defined results:
* Rows whose vector is NULL or holds NULL or non-finite entries are dropped, and so are empty vectors. If lengths differ, those of
  the most frequent length (of equally frequent ones the smallest) are used; others have no place in a covariance.
* Repeated rows and NULL ids count like any other row. Other columns are ignored, names may clash.
* Components without variance (below dims * 2.2e-16 of the largest eigenvalue) cannot be whitened and are left out; of an empty
  table, and of equal vectors, nothing is left.
* Equal eigenvalues share a plane, of which any basis is returned, the same one for all rows. Signs: the largest entry of a component is positive.
* Values of x beyond 2^53 are an error.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from condmon.llm.common import named
from condmon.session import stored

DEGREE = 12      # of the polynomial at most
DROWNED = 1e6    # how much more it may amplify the first wanted vector than the last
ROUNDS = 60
EPS = float(np.finfo(float).eps)


def integer_rows(df: DataFrame, id_col: str, vec_col: str, scale: int, shift: int) -> tuple[DataFrame, int]:
    """((vec_id, x array<bigint>), dims), written once; all passes read it."""
    rows = named(df, i=id_col, v=vec_col).withColumn("v", F.col("v").cast("array<double>"))
    odd = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    clean = rows.filter(F.col("v").isNotNull() & (F.size("v") > 0) & ~odd)
    entry = lambda c: F.floor(F.lit(float(scale)) * c)
    fits = F.forall("v", lambda c: F.abs(F.lit(float(scale)) * c) < float(2 ** 53 - abs(shift)))
    x = F.when(fits, F.transform("v", lambda c: entry(c) + F.lit(shift).cast("long"))).otherwise(
        F.raise_error(F.lit("an entry is too large for exact sums")).cast("array<bigint>"))
    kept = stored(clean.select(F.col("i").alias("vec_id"), x.alias("x")), "vectors")
    first = kept.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dims = first["n"] if first else 0
    return kept.filter(F.size("x") == dims), dims


def entries(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, dims)


def added_up(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], dims: int, kind: str = "double") -> np.ndarray:
    """Sum over all rows of part(x) of a batch: an array whose size does not depend on the rows."""
    out = T._parse_datatype_string(f"v array<{kind}>")
    arrow = to_arrow_schema(out)

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                value = part(entries(batch, dims))
                total = value if total is None else total + value
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], arrow.field("v").type)], schema=arrow)

    cells = rows.select("x").mapInArrow(run, out).select(F.posexplode("v").alias("p", "v"))
    table = cells.groupBy("p").agg(F.sum("v").alias("v")).toArrow()
    values = np.zeros(table.num_rows, table["v"].type.to_pandas_dtype())
    values[table["p"].to_numpy()] = table["v"].to_numpy()
    return values


@dataclass(frozen=True)
class Centred:
    """n and the exact sums; rows are centred as (n x - S) / n."""

    n: int
    sums: np.ndarray

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: 64-bit integers where they suffice, else Python's."""
        if self.n * max(1, int(np.abs(x).max(initial=0))) < 1 << 61:
            return self.n * x - self.sums
        return self.n * x.astype(object) - self.sums.astype(object)

    def values(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(x).astype(float) / self.n

    def deviation(self, x: np.ndarray) -> list[int]:
        d = self.scaled(x)
        if d.dtype != object and int(np.abs(d).max(initial=0)) ** 2 * d.shape[1] < 1 << 62:
            return (d * d).sum(1).tolist()
        return [sum(int(v) * int(v) for v in row) for row in d]


def filtered(apply: Callable[[np.ndarray], np.ndarray], q: np.ndarray, edge: float, top: float, degree: int) -> np.ndarray:
    """Chebyshev polynomial of the covariance on q: below 1 on [0, edge], growing above, scaled to 1 at top."""
    half = edge / 2
    first = sigma = half / (top - half)
    before, now = q, (apply(q) - half * q) * (sigma / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - sigma)
        before, now = now, (apply(now) - half * now) * (2 * following / half) - sigma * following * before
        sigma = following
    return now


def leading_components(apply: Callable[[np.ndarray], np.ndarray], dims: int, k: int, tol: float, seed: int
                       ) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, vectors as columns, largest residual) of the at most k largest; apply(q) is the covariance times q."""
    rng = np.random.default_rng(seed)
    block = min(dims, k + max(8, k // 2))
    q = np.linalg.qr(rng.standard_normal((dims, block)))[0]
    reached = np.inf
    for turn in range(ROUNDS):
        image = apply(q)
        product = q.T @ image
        values, rotation = np.linalg.eigh((product + product.T) / 2)
        values, rotation = values[::-1], rotation[:, ::-1]
        q, image = q @ rotation, image @ rotation
        if values[0] <= 0:
            return values[:0], q[:, :0], 0.0
        wanted = int((values[:k] > dims * EPS * values[0]).sum())
        residual = float(np.linalg.norm(image - q * values, axis=0)[:wanted].max() / values[0])
        if residual <= tol and (residual > reached / 2 or residual < 8 * EPS or block == dims):
            return values[:wanted], q[:, :wanted], residual
        reached = min(reached, residual)
        if block < dims and turn % 6 == 5:
            more = rng.standard_normal((dims, min(block, dims - block)))
            block += more.shape[1]
            q = np.linalg.qr(np.column_stack([q, more]))[0]
            continue
        edge = max(values[-1], 1e-14 * values[0])
        spread = math.acosh(max(1.0, 2 * values[0] / edge - 1)) - math.acosh(max(1.0, 2 * values[wanted - 1] / edge - 1))
        degree = DEGREE if spread <= 0 else max(2, min(DEGREE, int(math.log(DROWNED) / spread)))
        q = np.linalg.qr(filtered(apply, q, edge, values[0], degree))[0]
    raise RuntimeError(f"not certified: residual {reached:.1e} after {ROUNDS} rounds")


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 32, scale: int = 64,
           shift: int = 1_000_000, tol: float = 1e-12, seed: int = 7) -> DataFrame:
    """(vec_id, component, n, deviation decimal(38, 0), whitened, eigenvalue, explained, residual, identity_error), a row for each vector and component."""
    spark = df.sparkSession
    rows, dims = integer_rows(df, id_col, vec_col, scale, shift)
    out = (T.StructType().add("vec_id", rows.schema["vec_id"].dataType).add("component", "integer").add("n", "long")
           .add("deviation", "decimal(38,0)").add("whitened", "double").add("eigenvalue", "double").add("explained", "double")
           .add("residual", "double").add("identity_error", "double"))
    if not dims:
        return spark.createDataFrame([], out)
    counted = added_up(rows, lambda x: np.concatenate((x.sum(0), [len(x)])), dims, "bigint")
    centred = Centred(int(counted[-1]), counted[:-1])
    n = centred.n
    # Entries beyond what the rounding of the sum of squares needs are added up in floats: the trace, not the deviation.
    trace = float(added_up(rows, lambda x: np.array([(centred.values(x) ** 2).sum()]), dims)[0]) / n

    def apply(q: np.ndarray) -> np.ndarray:
        def part(x):
            c = centred.values(x)
            return c.T @ (c @ q)
        return added_up(rows, part, dims).reshape(q.shape) / n

    values, vectors, residual = leading_components(apply, dims, k, tol, seed)
    if not len(values):
        return spark.createDataFrame([], out)
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(values))])
    to_white = vectors / np.sqrt(values)

    def second(x):
        w = centred.values(x) @ to_white
        return np.concatenate(((w.T @ w).ravel(), w.sum(0)))

    moments = added_up(rows, second, dims) / n
    mean = moments[len(values) ** 2:]
    spread = moments[:len(values) ** 2].reshape(len(values), -1) - np.outer(mean, mean)
    error = float(np.abs(spread - np.eye(len(values))).max())
    arrow = to_arrow_schema(out)

    def project(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, many = entries(batch, dims), len(values)
            whitened = centred.values(x) @ to_white
            again = np.repeat(np.arange(len(x)), many)
            deviation = pa.array(centred.deviation(x)).cast(arrow.field("deviation").type)
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(pa.array(again)), pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(again), n)), deviation.take(pa.array(again)), pa.array(whitened.ravel()),
                pa.array(np.tile(values, len(x))), pa.array(np.tile(values / trace, len(x))),
                pa.array(np.full(len(again), residual)), pa.array(np.full(len(again), error))], schema=arrow)

    return rows.mapInArrow(project, out)
