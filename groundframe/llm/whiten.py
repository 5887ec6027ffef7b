"""Embedding whitening (operator 12): an exact scatter matrix from residues, then principal components of unit variance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, named, others

#: Entries become floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Primes are below 2^BITS, so sums of ROWS products of residues are exact in double precision.
BITS, ROWS = 20, 1 << 13
#: Entries of this size and more would not fit a long once scaled; they count as not finite.
LARGEST = 2.0**52


def primes(product: int) -> list[int]:
    """The largest primes below 2^BITS, as many as their product needs to exceed `product`."""
    out, have, p = [], 1, (1 << BITS) - 1
    while have <= product:
        if all(p % q for q in range(3, int(p**0.5) + 1, 2)):
            out.append(p)
            have *= p
        p -= 2
    return out


def reconstruct(residues: list[int], moduli: list[int]) -> int:
    """The integer of least magnitude with these residues (Chinese remaindering, a modulus at a time)."""
    x, m = 0, 1
    for r, p in zip(residues, moduli, strict=True):
        x += m * ((r - x) * pow(m, -1, p) % p)
        m *= p
    return x - m if 2 * x > m else x


def integers(vectors: pa.Array, d: int) -> np.ndarray:
    """Rows of integer entries; every vector has d of them, none null."""
    c = np.asarray(vectors.flatten().cast(pa.float64())).reshape(-1, d)
    return np.floor(SCALE * c).astype(np.int64) + SHIFT


def _sums(batches, d: int, moduli: list[int]) -> Iterator[pa.RecordBatch]:
    """One task's residues of the scatter of (1, x): (prime, i, j, r) for i <= j."""
    total = np.zeros((len(moduli), d + 1, d + 1), np.int64)
    for b in batches:
        x = integers(b.column(0), d)
        for a in range(0, len(x), ROWS):
            part = np.hstack([np.ones((len(x[a : a + ROWS]), 1), np.int64), x[a : a + ROWS]])
            for k, p in enumerate(moduli):
                r = (part % p).astype(np.float64)
                total[k] = (total[k] + (r.T @ r).astype(np.int64)) % p
    k, i, j = np.nonzero(np.broadcast_to(np.triu(np.ones((d + 1, d + 1), bool)), total.shape))
    yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[k, i, j])], names=["k", "i", "j", "r"])


@dataclass
class Fit:
    """n vectors' sums, the widest range of x, and components: (d, m) eigenvectors over the roots of their eigenvalues."""

    n: int
    sums: list[int]
    span: int
    basis: np.ndarray
    explained: list[float]

    def apply(self, vectors: pa.Array) -> pa.Array:
        """(deviation, whitened) of vectors; a deviation beyond a long is null."""
        n, d = self.n, len(self.sums)
        x = integers(vectors, d)
        if n * max(self.span, 1) < 1 << 62 and n * (int(abs(x).max(initial=0)) + 1) < 1 << 62:
            y = n * x - np.array(self.sums, np.int64)
        else:
            y = n * x.astype(object) - np.array(self.sums, object)
        f = y.astype(np.float64)
        about = (f * f).sum(1)
        if y.dtype != object and about.max(initial=0) < 2.0**62:
            deviation = pa.array((y * y).sum(1))
        else:
            exact = [sum(int(v) ** 2 for v in row) for row in y]
            deviation = pa.array([e if e < 1 << 63 else None for e in exact], pa.int64())
        w = f / n @ self.basis
        flat = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
        size = w.shape[1]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * size, pa.int32()), flat)
        return pa.StructArray.from_arrays([deviation, lists], names=["deviation", "whitened"])


def _valid(vector: Column) -> Column:
    fine = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < LARGEST), F.lit(False)))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False))


def fit_whitening(vectors: DataFrame, *, vector_col: str = "embedding", components: int = 8) -> Fit | None:
    """The fit over all vectors (null, empty, other than finite ones left out); None without any.

    All have to have one length: that of most vectors counts (of several, the largest), and others are left out.
    A first pass finds the length, their number and the range of entries, and so how many primes the scatter
    needs. In the second every task multiplies its residues, block by block, and only its sums, a few numbers
    for each pair of dimensions and prime, are shuffled and added up. The driver gets one number for each pair and
    prime, puts the exact integers together and decomposes the covariance, rounded once to double precision.
    """
    (vector,) = named(vector_col)
    v = vectors.where(_valid(vector)).select(vector.cast("array<double>").alias("v"))
    seen = v.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.min(F.array_min("v")).alias("low"), F.max(F.array_max("v")).alias("high"))
    top = seen.orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not top:
        return None
    d, n, low, high = top[0]
    low, high = (int(np.floor(SCALE * c)) + SHIFT for c in (low, high))
    moduli = primes(2 * n * max(abs(low), abs(high), 1) ** 2)
    parts = v.where(F.size("v") == d).mapInArrow(lambda batches: _sums(batches, d, moduli), "k int, i int, j int, r long")
    table: dict = {}
    for k, i, j, r in parts.groupBy("k", "i", "j").agg(F.sum("r")).collect():
        table.setdefault((i, j), [0] * len(moduli))[k] = r % moduli[k]
    exact = {at: reconstruct(r, moduli) for at, r in table.items()}
    sums = [exact[0, j + 1] for j in range(d)]
    cov = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            cov[i, j] = cov[j, i] = (n * exact[i + 1, j + 1] - sums[i] * sums[j]) / (n * n)  # whole numbers: rounded once
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1][:components], q[:, ::-1][:, :components]
    real = e > max(e[0], 0) * d * np.finfo(float).eps
    basis = np.where(real, q / np.sqrt(np.where(real, e, 1)), np.nan)
    trace = float(np.trace(cov))
    return Fit(n, sums, high - low, basis, [float(x) / trace if trace else 0.0 for x in np.maximum(e, 0)])


def whiten(vectors: DataFrame, *, vector_col: str = "embedding", components: int = 8) -> DataFrame:
    """The rows that count, less `vector_col`, with n, deviation, whitened, explained and identity_error.

    Entries c become whole numbers x = floor(1024 c) + 100000. `whitened` (array of double) is x less its mean on the first components of
    the covariance of all x, each over the root of its eigenvalue; `explained` the eigenvalues' shares of the trace; `deviation` the
    exact sum of (n x - S)^2 (null if it exceeds a long); identity_error the largest entry by which the covariance of `whitened`, measured
    over the rows, differs from the identity.

    Rows are left out whose vector is null, empty, of another length than most, or holds a null, an entry that is not
    finite or one of 2^52 or more. A component without variance (equal vectors, more components than vectors) is null in
    `whitened` and left out of identity_error, which is 0 if none has variance. Repeated rows count each time; ids are not looked at;
    extra columns pass through (those named as results, in any case, are replaced). An empty table gives an empty one.
    """
    (vector,) = named(vector_col)
    made = ("n", "deviation", "whitened", "explained", "identity_error")
    rest = others(vectors, vector_col, *made)
    fit = fit_whitening(vectors, vector_col=vector_col, components=components)
    if fit is None:
        empty = vectors.limit(0).select(*rest)
        kinds = ("bigint", "bigint", "array<double>", "array<double>", "double")
        return empty.select(*rest, *(F.lit(None).cast(k).alias(c) for c, k in zip(made, kinds, strict=True)))

    @F.arrow_udf("struct<deviation:bigint,whitened:array<double>>")
    def told(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield fit.apply(b)

    (own,) = fresh(vectors, "told")
    rows = vectors.where(_valid(vector)).where(F.size(vector) == len(fit.sums))
    rows = cut(rows.select(*rest, told(vector.cast("array<double>")).alias(own)))
    m = fit.basis.shape[1]
    at = lambda i: F.col(own)["whitened"][i]
    pairs = [(i, j) for i in range(m) for j in range(i, m)]
    cov = rows.agg(*(F.covar_pop(at(i), at(j)) for i, j in pairs)).first()
    error = max((abs(c - (i == j)) for c, (i, j) in zip(cov, pairs, strict=True) if c is not None), default=0.0)
    return rows.select(
        *rest, F.lit(fit.n).cast("long").alias("n"), F.col(own)["deviation"].alias("deviation"), F.col(own)["whitened"].alias("whitened"),
        F.array(*map(F.lit, fit.explained)).alias("explained"), F.lit(float(error)).alias("identity_error"),
    )
