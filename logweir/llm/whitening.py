"""Embedding whitening from the exact characteristic polynomial of an integer scatter matrix.

1. Scatter. Entries become integers x = floor(1024 c) + 100000. Tasks sum y = x - 100000 and
   the products y y' exactly (blocks small enough for exact float64 products, long integers
   beyond), Spark adds the tasks' sums limb by limb, and A = n sum(y y') - T T' is n^2 times
   the covariance of x, without rounding.
2. Polynomial. The coefficients of det(t I - A) are integers below a bound that the trace
   gives. Modulo enough primes below 2^31, A is brought to Hessenberg form and the
   polynomial read off (one task per few primes); Chinese remaindering joins the residues.
3. Roots. All roots are real, so the sign changes of the coefficients shifted by a are exactly
   the number of roots above a (Descartes). Bisection over that count isolates the largest
   roots, and signs at dyadic points narrow single ones to 2^-``ROOT_BITS``. Roots
   that even then lie in one interval count as one eigenvalue of that multiplicity.
4. Components. Inverse iteration on A - root I, in fixed point of ``FIXED_BITS`` bits, gives
   the null space; sign: the entry of largest size is positive.
5. Projection. One pass measures the covariance of the whitened vectors against the identity,
   one gives the rows.

What reaches the driver has the size of the dimension squared (64 squared here), whatever the
number of rows; with the arithmetic of step 3 on one driver core, dimensions of some hundred are
meant.

Defined results. Vectors that are null or hold null or non-finite entries are dropped. The
dimension is the one most vectors have (of equally many, the larger); vectors of another length, and empty
ones, are dropped too. Entries whose integer would not fit a long count as the nearest long. Components
without variance (roots equal to 0, which the polynomial shows exactly) are left out: constant or single vectors, or
an empty table, give no rows. Equal eigenvalues: any orthonormal basis of their space, the same for all
rows. Repeated rows count and are returned each for itself, also those without an id. A deviation beyond a
long is null and stands as decimal text in deviation_text, which is null otherwise. Other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import col
from .memory import trim

SCALE, SHIFT = 1024.0, 100_000
COMPONENTS = 8
ROOT_BITS, FIXED_BITS = 96, 256
#: Sums leave the tasks in limbs of 36 bits, which Spark adds as longs.
LIMB, LIMBS = 36, 6
_TOP = (1 << 63) - 1 - SHIFT


def finite_rows(vectors: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length -> (row numbers, integers y) of the rows without null or non-finite entries."""
    offsets = vectors.offsets.to_numpy().astype(np.int64)
    flat = vectors.values.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
    length = np.diff(offsets)
    good = np.asarray(vectors.is_valid()) & (bad[offsets[1:]] == bad[offsets[:-1]]) & (length > 0)
    out = {}
    for d in np.unique(length[good]).tolist():
        rows = np.flatnonzero(good & (length == d))
        scaled = np.floor(flat[offsets[rows][:, None] + np.arange(d)] * SCALE)
        # Beyond 2^62 doubles are taken one by one.
        y = np.where(np.abs(scaled) < 2.0**62, scaled, 0).astype(np.int64)
        for i, j in np.argwhere(np.abs(scaled) >= 2.0**62).tolist():
            y[i, j] = max(-_TOP, min(_TOP, int(scaled[i, j]) if np.isfinite(scaled[i, j]) else int(np.sign(scaled[i, j])) * _TOP))
        out[d] = rows, y
    return out


def gram(y: np.ndarray) -> np.ndarray:
    """y' y, exactly, as Python integers."""
    size = np.abs(y).max(axis=1)
    small, out = y[size < 1 << 26], np.zeros((y.shape[1],) * 2, object)
    top = int(np.abs(small).max()) if len(small) else 0
    step = max(1, (1 << 53) // (top * top + 1))
    for a in range(0, len(small), step):
        part = small[a : a + step].astype(np.float64)
        out = out + (part.T @ part).astype(np.int64)
    for row in y[size >= 1 << 26].astype(object):
        out = out + np.outer(row, row)
    return out


def limbs(values: list[int]) -> list[list[int]]:
    """Integers as ``LIMBS`` signed limbs each, lowest first."""
    out = []
    for v in values:
        v, row = int(v), []
        for _ in range(LIMBS - 1):
            row.append(v & (1 << LIMB) - 1)
            v >>= LIMB
        out.append([*row, v])
    return out


def _each(df: DataFrame, work, schema: str) -> DataFrame:
    """Rows that ``work`` makes of each Arrow batch's vectors (it gets ids and ``finite_rows``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from work(batch.column(0), finite_rows(batch.column(1)))
        trim()

    return df.mapInArrow(run, schema)


def common_length(vectors: DataFrame) -> int | None:
    """The length that most finite vectors have."""

    def count(_, found) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"d": pa.array(list(found), pa.int64()), "n": pa.array([len(r) for r, _ in found.values()], pa.int64())})

    row = _each(vectors, count, "d long, n long").groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return row.d if row else None


def scatter(vectors: DataFrame, d: int) -> tuple[int, list[int], np.ndarray]:
    """(rows n, sums T of y, sums of products of y) over the vectors of length d."""
    up = np.triu_indices(d)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            found = finite_rows(batch.column(1)).get(d)
            if found:
                y = found[1]
                wide = y.astype(object) if np.abs(y).max() >= 1 << 40 else y
                n, sums, products = n + len(y), sums + wide.sum(axis=0), products + gram(y)
        trim()
        values = limbs([n, *sums, *products[up]])
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(len(values)), pa.int32()), **{f"l{k}": pa.array([v[k] for v in values], pa.int64()) for k in range(LIMBS)}})

    parts = vectors.mapInArrow(partial, "at int, " + ", ".join(f"l{k} long" for k in range(LIMBS)))
    total = parts.groupBy("at").agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS)])
    # d (d + 1) / 2 + d + 1 rows.
    values = {r["at"]: sum(r[f"l{k}"] << LIMB * k for k in range(LIMBS)) for r in total.collect()}
    n, sums, products = values.get(0, 0), [values.get(1 + i, 0) for i in range(d)], np.zeros((d, d), object)
    for k, (i, j) in enumerate(zip(*up)):
        products[i, j] = products[j, i] = values.get(1 + d + k, 0)
    return n, sums, products


def primes(count: int, below: int = 1 << 31) -> list[int]:
    """The largest primes below 2^31 (four Miller-Rabin bases decide there)."""

    def is_prime(p: int) -> bool:
        s, odd = 0, p - 1
        while odd % 2 == 0:
            s, odd = s + 1, odd // 2
        for a in (2, 3, 5, 7):
            x = pow(a, odd, p)
            if x not in (1, p - 1) and all((x := x * x % p) != p - 1 for _ in range(s - 1)):
                return False
        return True

    out, p = [], below - 1
    while len(out) < count:
        if is_prime(p):
            out.append(p)
        p -= 2
    return out


def polynomial_modulo(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(t I - matrix) modulo p, highest power first, by Hessenberg reduction."""
    h, n = (matrix % p).astype(np.int64), len(matrix)
    for m in range(1, n - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        pivot = m + int(below[0])
        if pivot != m:
            h[[m, pivot]] = h[[pivot, m]]
            h[:, [m, pivot]] = h[:, [pivot, m]]
        factor = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - factor[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * factor % p).sum(axis=1)) % p
    # By leading blocks, lowest power first.
    poly = np.zeros((n + 1, n + 1), np.int64)
    poly[0, 0] = 1
    for k in range(1, n + 1):
        weights, product = np.zeros(k, np.int64), 1
        weights[k - 1] = h[k - 1, k - 1]
        for i in range(k - 2, -1, -1):
            product = product * int(h[i + 1, i]) % p
            if not product:
                break
            weights[i] = product * int(h[i, k - 1]) % p
        poly[k, 1:] = poly[k - 1, :-1]
        poly[k] = (poly[k] - (weights[:, None] * poly[:k] % p).sum(axis=0)) % p
    return poly[n][::-1].tolist()


def characteristic_polynomial(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Exact coefficients of det(t I - matrix), highest power first, for a symmetric matrix without negative eigenvalues."""
    d, trace = len(matrix), sum(int(matrix[i, i]) for i in range(len(matrix)))
    # Of numbers of given sum, none negative, equal ones have the largest symmetric functions.
    bound = max(comb(d, k) * (-(-trace // d)) ** k for k in range(d + 1))
    moduli = primes(bound.bit_length() // 30 + 1)

    def residues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = [moduli[i] for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"p": pa.array(some, pa.int64()), "c": pa.array([polynomial_modulo(matrix, p) for p in some], pa.list_(pa.int64()))})

    tasks = min(len(moduli), spark.sparkContext.defaultParallelism)
    rows = spark.range(len(moduli), numPartitions=tasks).mapInArrow(residues, "p long, c array<long>").collect()
    product = 1
    for p in moduli:
        product *= p
    units = {p: product // p * pow(product // p, -1, p) for p in moduli}
    out = []
    for k in range(d + 1):
        value = sum(units[r.p] * r.c[k] for r in rows) % product
        # The coefficient's sign is that of (-1)^k.
        out.append(value - product if value and k % 2 else value)
    return out


def shifted(poly: list[int], a: int) -> list[int]:
    """Coefficients of poly(t + a)."""
    out = list(poly)
    for stop in range(len(out) - 1, 0, -1):
        for k in range(1, stop + 1):
            out[k] += a * out[k - 1]
    return out


def value(poly: list[int], a: int) -> int:
    out = 0
    for c in poly:
        out = out * a + c
    return out


def roots_above(poly: list[int], a: int) -> int:
    """How many roots, all real, exceed a: the sign changes of the shifted coefficients."""
    signs = [c > 0 for c in shifted(poly, a) if c]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def largest_roots(poly: list[int], count: int, bits: int = ROOT_BITS) -> list[tuple[int, int]]:
    """(root times 2^bits, rounded up; multiplicity) of the largest positive roots, falling, at least ``count`` in all if there are."""
    while len(poly) > 1 and poly[-1] == 0:
        poly = poly[:-1]
    fine = [c << bits * k for k, c in enumerate(poly)]
    positive = roots_above(fine, 0)
    if not positive:
        return []
    # The trace bounds every root; intervals (low, high] with their number of roots, the highest on top.
    stack, out, have = [(0, max(-fine[1], 1), positive)], [], 0
    while stack and have < count:
        low, high, inside = stack.pop()
        if inside == 1:
            sign = value(fine, high) > 0
            if value(fine, high):
                while high - low > 1:
                    middle = (low + high) // 2
                    at = value(fine, middle)
                    low, high = (low, middle) if at == 0 or (at > 0) == sign else (middle, high)
        if inside == 1 or high - low == 1:
            out.append((high, inside))
            have += inside
            continue
        middle = (low + high) // 2
        # ``have`` roots lie above this interval, however many times it was halved.
        upper = roots_above(fine, middle) - have
        if inside - upper:
            stack.append((low, middle, inside - upper))
        if upper:
            stack.append((middle, high, upper))
    return out


def null_space(matrix: np.ndarray, root: int, many: int, bits: int = ROOT_BITS, fixed: int = FIXED_BITS) -> np.ndarray:
    """``many`` orthonormal vectors v with matrix v = root v (rows), by inverse iteration in fixed point."""
    d, trace = len(matrix), sum(int(matrix[i, i]) for i in range(len(matrix)))
    one = 1 << fixed
    # Everything over the trace, so that no entry exceeds 1.
    a = np.array([[(int(x) << fixed) // trace for x in row] for row in matrix], object)
    for i in range(d):
        a[i, i] -= (root << fixed) // (trace << bits)
    order, low = list(range(d)), np.zeros((d, d), object)
    for k in range(d):
        best = max(range(k, d), key=lambda i: abs(a[i, k]))
        if best != k:
            a[[k, best]], low[[k, best]] = a[[best, k]], low[[best, k]]
            order[k], order[best] = order[best], order[k]
        if a[k, k] == 0:
            a[k, k] = 1  # the smallest pivot there is: the root is met to the last bit
        low[k + 1 :, k] = (a[k + 1 :, k] << fixed) // a[k, k]
        a[k + 1 :, k:] -= np.outer(low[k + 1 :, k], a[k, k:]) >> fixed
    rng = np.random.default_rng(d)
    out: list[np.ndarray] = []
    for _ in range(many):
        v = np.array([int(x) << fixed - 30 for x in rng.integers(-(1 << 30), 1 << 30, d)], object)
        for _ in range(3):
            w = v[order]
            for k in range(d):
                w[k + 1 :] -= (low[k + 1 :, k] * w[k]) >> fixed
            for k in range(d - 1, -1, -1):
                rest = int((a[k, k + 1 :] * w[k + 1 :]).sum()) >> fixed if k + 1 < d else 0
                w[k] = ((int(w[k]) - rest) << fixed) // a[k, k]
            top = max(abs(int(x)) for x in w)
            v = np.array([(int(x) << fixed) // top for x in w], object)
        u = np.array([float(Fraction(int(x), one)) for x in v])
        for _ in range(2):
            for other in out:
                u = u - (u @ other) * other
            u = u / np.linalg.norm(u)
        out.append(u if u[np.argmax(np.abs(u))] > 0 else -u)
    return np.array(out)


@dataclass(frozen=True)
class Whitening:
    """What the fit list says: rows, sums of y, and the components with their eigenvalues of the scatter matrix."""

    dimension: int
    n: int
    sums: tuple[int, ...]
    roots: tuple[Fraction, ...]
    vectors: np.ndarray
    trace: int
    polynomial: tuple[int, ...] = ()

    def variances(self) -> list[float]:
        """Eigenvalues of the covariance of x."""
        return [float(r / self.n**2) for r in self.roots]

    def centred(self, y: np.ndarray) -> np.ndarray:
        """n x - S, as integers."""
        if self.n * int(np.abs(y).max(initial=0)) + max(map(abs, self.sums), default=0) < 1 << 62:
            return y * np.int64(self.n) - np.array(self.sums, np.int64)
        return y.astype(object) * self.n - np.array(self.sums, object)

    def project(self, centred: np.ndarray) -> np.ndarray:
        return centred.astype(np.float64) @ self.vectors.T / np.array([float(r) ** 0.5 for r in self.roots])


def fit(df: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all finite vectors; None where none has variance."""
    vectors = df.select(F.lit(None).cast("long").alias("id"), col(df, vector_col).alias("v"))
    d = common_length(vectors)
    if d is None:
        return None
    n, sums, products = scatter(vectors, d)
    matrix = products * n - np.outer(np.array(sums, object), np.array(sums, object))
    trace = sum(int(matrix[i, i]) for i in range(d))
    if trace == 0:
        return None
    poly = characteristic_polynomial(df.sparkSession, matrix)
    roots, rows = [], []
    for root, many in largest_roots(poly, components):
        take = min(many, components - len(roots))
        roots += [Fraction(root, 1 << ROOT_BITS)] * take
        rows.append(null_space(matrix, root, take))
    return Whitening(d, n, tuple(int(s) for s in sums), tuple(roots), np.concatenate(rows), trace, tuple(poly))


def identity_error(df: DataFrame, model: Whitening, vector_col: str = "embedding") -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, over all rows."""
    k, d = len(model.roots), model.dimension

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            found = finite_rows(batch.column(1)).get(d)
            if found:
                w = model.project(model.centred(found[1]))
                sums, products = sums + w.sum(axis=0), products + w.T @ w
        values = [*sums, *products.ravel()]
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(len(values)), pa.int32()), "v": pa.array(values, pa.float64())})

    vectors = df.select(F.lit(None).cast("long").alias("id"), col(df, vector_col).alias("v"))
    total = {r["at"]: r.v for r in vectors.mapInArrow(partial, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()}
    mean = np.array([total[i] for i in range(k)]) / model.n
    second = np.array([total[k + i] for i in range(k * k)]).reshape(k, k) / model.n
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


_ROWS = ("component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_text string")


def whiten(df: DataFrame, model: Whitening | None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per finite vector and component: the id under its own name, component, n, deviation, whitened, explained, identity_error, deviation_text."""
    given = df.select(col(df, id_col).alias("id"), col(df, vector_col).alias("v"))
    kind = given.schema["id"].dataType.simpleString()
    if model is None:
        empty = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in _ROWS.split(", ")]
        return given.limit(0).select(F.col("id").alias(id_col), *empty)
    error, k = identity_error(df, model, vector_col), len(model.roots)
    explained = [float(r / model.trace) for r in model.roots]

    def rows(ids: pa.Array, found) -> Iterator[pa.RecordBatch]:
        if model.dimension not in found:
            return
        at, y = found[model.dimension]
        z = model.centred(y)
        if z.dtype != object and float(np.abs(z.astype(np.float64)).max()) ** 2 * model.dimension < 2.0**62:
            deviation = (z * z).sum(axis=1).tolist()
        else:
            deviation = (z.astype(object) ** 2).sum(axis=1).tolist()
        fits = [v if v < 1 << 63 else None for v in deviation]
        text = [None if v < 1 << 63 else str(v) for v in deviation]
        m = len(at)
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n, np.int64)),
             pa.array([v for v in fits for _ in range(k)], pa.int64()), pa.array(model.project(z).ravel()), pa.array(np.tile(explained, m)),
             pa.array(np.full(m * k, error)), pa.array([v for v in text for _ in range(k)], pa.string())],
            names=["id", *[c.split()[0] for c in _ROWS.split(", ")]])

    return _each(given, rows, f"id {kind}, {_ROWS}").withColumnRenamed("id", id_col)

