"""Whitening of vectors from the exact characteristic polynomial of their integer scatter.

General: notices carry no vectors.  The vectors are rounded down to integers, so counts, sums and
the scatter matrix are exact; Spark adds them up and reduces the matrix modulo many primes, the
driver only sees a matrix of the vectors' dimension, whatever the number of vectors.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketlake.llm.store import saved

SCALE = 256            # integers per unit of a vector entry
SLICE_ROWS = 4096      # vectors multiplied at once
PRIME_TOP = 1 << 31    # primes lie below, so that products of two residues fit 62 bits
PRIMES_PER_TASK = 32
LIMB = 20              # bits of the parts that large integers are multiplied in
WIDTH_BITS = 160       # roots are isolated to the matrix norm over two to this power
FIXED_BITS = 512       # fractional bits of the null-space solves
SEED_STEP = 0x9E3779B97F4A7C15


class Whitening(NamedTuple):
    """A fitted whitening; its size depends on the dimension alone."""

    n: int                        # vectors it was fitted on
    sums: list[int]               # their sum per dimension
    values: list[float]           # eigenvalues of the covariance, falling, all above 0
    components: np.ndarray        # unit eigenvectors, one per row
    explained: list[float]        # eigenvalues over the trace
    identity_error: float | None  # largest absolute entry of the whitened covariance less the identity


# ---- integers ------------------------------------------------------------------------------------------------


def integer_vectors(vectors: DataFrame, embedding: str = "embedding", scale: int = SCALE, dimension: int | None = None) -> DataFrame:
    """Adds ``x``, the vectors times ``scale`` rounded down; rows without a usable vector go.

    Unusable are NULL and empty vectors, those with a NULL, infinite or not-a-number entry, and
    those of another length than ``dimension`` (without it: than most of the others; the longer
    of two equally frequent lengths).
    """
    entry = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    usable = vectors.where((F.size(embedding) > 0) & F.forall(F.col(embedding).cast("array<double>"), entry))
    if dimension is None:
        top = usable.groupBy(F.size(embedding).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
        dimension = top["size"] if top else 0
    x = F.transform(F.col(embedding).cast("array<double>"), lambda c: F.floor(c * scale))
    return usable.where(F.size(embedding) == dimension).withColumn("x", x)


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, dimension)


def exact_product(x: np.ndarray) -> np.ndarray:
    """``x.T @ x`` of an int64 matrix in Python integers.

    Entries are cut into limbs so small that a float64 product of limbs is exact.
    """
    top = int(np.abs(x.astype(np.float64)).max(initial=0.0)) + 1
    if top * top * len(x) < 1 << 53:
        f = x.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    bits = min(LIMB, (52 - max(len(x), 2).bit_length()) // 2)
    limbs, rest = [], x.copy()
    while not limbs or not ((rest == 0) | (rest == -1)).all():
        limbs.append((rest & ((1 << bits) - 1)).astype(np.float64))
        rest = rest >> bits
        if len(limbs) * bits >= 64:
            break
    # What is left of negative numbers is -1 in every higher bit.
    limbs.append(rest.astype(np.float64))
    out = np.zeros((x.shape[1], x.shape[1]), dtype=object)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            out += (a.T @ b).astype(np.int64).astype(object) * (1 << (bits * (i + j)))
    return out


def _packed(numbers) -> bytes:
    return ",".join(map(str, numbers)).encode()


def _unpacked(data: bytes) -> list[int]:
    return [int(v) for v in data.split(b",")]


def integer_moments(distinct: DataFrame, dimension: int) -> tuple[int, list[int], list[list[int]]]:
    """``(n, sums, products)`` of distinct integer vectors ``x``, exact.

    Tasks send a row of numbers per row of the matrix; those of one matrix row are added up
    in one task, a few bytes per task and entry, so the driver gets one matrix in all.
    """

    def partial(batches):
        n, sums, products = 0, np.zeros(dimension, dtype=object), np.zeros((dimension, dimension), dtype=object)
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE_ROWS):
                x = _matrix(batch.column("x").slice(first, SLICE_ROWS), dimension)
                n += len(x)
                sums += _column_sums(x)
                products += exact_product(x)
        if n:
            rows = [[n, *sums], *products]
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, dimension), pa.int32()), pa.array(list(map(_packed, rows)), pa.binary())],
                                             ["line", "numbers"])

    def added(key, table):
        total: list[int] = []
        for part in table.column("numbers"):
            row = _unpacked(part.as_py())
            total = [a + b for a, b in zip(total, row)] if total else row
        return pa.table({"line": pa.array([key[0].as_py()], pa.int32()), "numbers": pa.array([_packed(total)], pa.binary())})

    schema = "line int, numbers binary"
    rows = distinct.select("x").mapInArrow(partial, schema).groupBy("line").applyInArrow(added, schema).collect()
    if not rows:
        return 0, [0] * dimension, [[0] * dimension for _ in range(dimension)]
    found = {r.line: _unpacked(bytes(r.numbers)) for r in rows}
    return found[-1][0], found[-1][1:], [found[i] for i in range(dimension)]


def _column_sums(x: np.ndarray) -> np.ndarray:
    if float(np.abs(x.astype(np.float64)).max(initial=0.0)) * len(x) < 2.0 ** 62:
        return x.sum(axis=0).astype(object)
    return x.astype(object).sum(axis=0)


# ---- characteristic polynomial -------------------------------------------------------------------------------


def primes_below(top: int, count: int) -> list[int]:
    """The ``count`` largest primes below ``top`` (Miller-Rabin with bases that decide below 2^32)."""

    def prime(p: int) -> bool:
        odd, twos = p - 1, 0
        while odd % 2 == 0:
            odd, twos = odd // 2, twos + 1
        for base in (2, 7, 61):
            v = pow(base, odd, p)
            if v in (1, p - 1):
                continue
            for _ in range(twos - 1):
                v = v * v % p
                if v == p - 1:
                    break
            else:
                return False
        return True

    found, at = [], top - 1 | 1
    while len(found) < count:
        if prime(at):
            found.append(at)
        at -= 2
    return found


def hessenberg_polynomial(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients (constant first) of ``det(t - matrix)`` modulo a prime, by reduction to Hessenberg form."""
    h = matrix.astype(np.int64) % p
    d = len(h)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1:, k])
        if not len(below):
            continue
        at = k + 1 + int(below[0])
        if at != k + 1:
            h[[k + 1, at]] = h[[at, k + 1]]
            h[:, [k + 1, at]] = h[:, [at, k + 1]]
        factors = h[k + 2:, k] * pow(int(h[k + 1, k]), -1, p) % p
        # A similarity: rows lose multiples of the pivot's row, the pivot's column takes up the same multiples.
        h[k + 2:] = (h[k + 2:] - factors[:, None] * h[k + 1]) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2:] * factors % p).sum(axis=1)) % p
    polys = np.zeros((d + 1, d + 1), dtype=np.int64)
    polys[0, 0] = 1
    for k in range(1, d + 1):
        out = np.roll(polys[k - 1], 1) - h[k - 1, k - 1] * polys[k - 1] % p
        # Product of the subdiagonal from row i + 1 to row k, times the entry right of it.
        weights, run = np.zeros(k - 1, dtype=np.int64), 1
        for i in range(k - 2, -1, -1):
            run = run * int(h[i + 1, i]) % p
            if not run:
                break
            weights[i] = run * int(h[i, k - 1]) % p
        if k > 1:
            out = out - (weights[:, None] * polys[: k - 1] % p).sum(axis=0)
        polys[k] = out % p
    return polys[d].tolist()


def remaindered(residues: list[list[int]], primes: list[int]) -> list[int]:
    """Integers (of either sign) whose remainders are given, one list per prime; pairs of moduli are merged like a tournament."""
    level = [(p, r) for p, r in zip(primes, residues)]
    while len(level) > 1:
        merged = []
        for (m, a), (q, b) in zip(level[::2], level[1::2]):
            inverse = pow(m, -1, q)
            merged.append((m * q, [x + m * ((y - x) * inverse % q) for x, y in zip(a, b)]))
        level = merged + level[len(level) & ~1:]
    m, a = level[0]
    return [x - m if x > m // 2 else x for x in a]


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients (constant first) of ``det(t - matrix)`` of a symmetric integer matrix with roots of 0 or more, exact.

    One Spark row per prime; there are enough primes for the largest coefficient, which is at
    most ``binom(d, k) * (trace / d)^k`` for some k.
    """
    d = len(matrix)
    trace = max(1, sum(matrix[i][i] for i in range(d)))
    bits = d * max(1, math.ceil(math.log2(trace) - math.log2(d)) + 1) + d + 2
    primes = primes_below(PRIME_TOP, -(-bits // 30) + 1)
    # Residues are taken from the decimal text of the entries, which needs no fixed width.
    sent = spark.sparkContext.broadcast(_packed(v for row in matrix for v in row))

    def reduce(batches):
        whole = np.array(_unpacked(sent.value), dtype=object).reshape(d, d)
        for batch in batches:
            mine = batch.column("p").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("p"), pa.array([hessenberg_polynomial(whole % p, p) for p in mine], pa.list_(pa.int64()))], ["p", "residues"])

    rows = spark.createDataFrame([(p,) for p in primes], "p long").repartition(-(-len(primes) // PRIMES_PER_TASK)) \
        .mapInArrow(reduce, "p long, residues array<long>").collect()
    return remaindered([r.residues for r in rows], [r.p for r in rows])


# ---- roots and components ------------------------------------------------------------------------------------


def roots_above(poly: list[int], numerator: int, shift: int) -> int:
    """Roots, with multiplicity, above ``numerator / 2^shift`` of a polynomial that only has real roots.

    The sign changes of the coefficients about that point: for real roots the rule of signs is exact.
    """
    d = len(poly) - 1
    c = [v << (shift * (d - k)) for k, v in enumerate(poly)]
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            c[k] += numerator * c[k + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def largest_roots(poly: list[int], top: int, count: int, bits: int = WIDTH_BITS) -> list[tuple[int, int, int]]:
    """The ``count`` largest roots of at least ``top / 2^bits``: ``(low, high, shift)``, root in ``(low, high] / 2^shift``.

    Isolated by bisection of ``[0, top]``; roots that a width of ``top / 2^bits`` does not tell
    apart share an interval.
    """
    shift = max(0, bits - top.bit_length())
    floor = max(1, (top << shift) >> bits)
    found, known = [], {}

    def above(at: int) -> int:
        if at not in known:
            known[at] = roots_above(poly, at, shift)
        return known[at]

    for k in range(min(count, above(floor))):
        low = max([a for a, n in known.items() if n > k], default=floor)
        high = min([a for a, n in known.items() if n <= k], default=(top + 1) << shift)
        while high - low > floor:
            middle = (low + high) // 2
            if above(middle) > k:
                low = middle
            else:
                high = middle
        found.append((low, high, shift))
    return found


def _solver(matrix: list[list[int]], numerator: int, shift: int, unit: int):
    """Factors of ``(matrix - numerator / 2^shift) / 2^unit`` in fixed-point integers, as a function that solves."""
    d, one = len(matrix), FIXED_BITS
    a = np.array([[(v << one) >> unit for v in row] for row in matrix], dtype=object)
    mu = (numerator << one) >> (unit + shift)
    for i in range(d):
        a[i, i] -= mu
    order, below = list(range(d)), np.zeros((d, d), dtype=object)
    for k in range(d):
        at = max(range(k, d), key=lambda r: abs(a[r, k]))
        a[[k, at]], below[[k, at]] = a[[at, k]], below[[at, k]]
        order[k], order[at] = order[at], order[k]
        if a[k, k] == 0:
            a[k, k] = 1  # the smallest number there is, so that the null direction grows
        for r in range(k + 1, d):
            if a[r, k]:
                f = (a[r, k] << one) // a[k, k]
                below[r, k] = f
                a[r, k:] -= (f * a[k, k:]) >> one

    def solve(b: np.ndarray) -> np.ndarray:
        y = b[order].copy()
        for k in range(d):
            y[k + 1:] -= (below[k + 1:, k] * y[k]) >> one
        for k in range(d - 1, -1, -1):
            y[k] = (y[k] << one) // a[k, k]
            y[:k] -= (a[:k, k] * y[k]) >> one
        return y

    return solve


def _unit(v: np.ndarray) -> np.ndarray:
    """Fixed-point vector of length 1 along an integer vector."""
    norm = math.isqrt(sum(int(c) * int(c) for c in v))
    return np.array([(int(c) << FIXED_BITS) // norm for c in v], dtype=object) if norm else v


def _across(v: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    for other in others:
        v = v - ((other * (sum(int(a) * int(b) for a, b in zip(v, other)) >> FIXED_BITS)) >> FIXED_BITS)
    return v


def null_space_components(matrix: list[list[int]], roots: list[tuple[int, int, int]]) -> np.ndarray:
    """A unit vector per root, rows of a float matrix: inverse iteration at the isolated root.

    Vectors of roots that share an interval are kept across each other, so they span the
    null space of a repeated root.
    """
    d = len(matrix)
    unit = max(1, max(abs(v) for row in matrix for v in row)).bit_length()
    found: list[np.ndarray] = []
    for k, (low, high, shift) in enumerate(roots):
        same = [found[j] for j in range(k) if roots[j][1] >= low and roots[j][0] <= high]
        solve = _solver(matrix, (low + high) // 2, shift, unit)
        # Any start that is not across the wanted direction will do: fixed, well mixed numbers.
        v = np.array([((k * d + i + 1) * SEED_STEP % (1 << 64)) - (1 << 63) for i in range(d)], dtype=object)
        for _ in range(4):
            v = _unit(_across(solve(_unit(_across(v, same))), same))
        found.append(v)
    return np.array([[int(c) / (1 << FIXED_BITS) for c in v] for v in found], dtype=np.float64).reshape(len(found), d)


# ---- operator ------------------------------------------------------------------------------------------------


def fit_whitening(vectors: DataFrame, components: int = 4) -> Whitening:
    """Whitening along the largest ``components`` principal directions of the distinct vectors ``x``.

    ``x`` is an integer array, as of :func:`integer_vectors`; repeated vectors count once.
    Directions without variance are left out, so there may be fewer components, none for
    less than two distinct vectors or an empty table.
    """
    spark = vectors.sparkSession
    distinct = saved(vectors.select("x").distinct(), "vectors")
    first = distinct.select(F.size("x").alias("size")).first()
    if first is None:
        return Whitening(0, [], [], np.zeros((0, 0)), [], None)
    d = first["size"]
    n, sums, products = integer_moments(distinct, d)
    # The covariance times n squared.
    scatter = [[n * products[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    trace = sum(scatter[i][i] for i in range(d))
    if trace == 0:
        return Whitening(n, sums, [], np.zeros((0, d)), [], None)
    poly = characteristic_polynomial(spark, scatter)
    roots = largest_roots(poly, trace, components)
    axes = null_space_components(scatter, roots)
    size = [_ratio(low + high, 1 << (shift + 1)) for low, high, shift in roots]
    model = Whitening(n, sums, [_ratio(low + high, n * n << (shift + 1)) for low, high, shift in roots], axes,
                      [s / trace for s in size], None)
    return model._replace(identity_error=_identity_error(distinct, model))


def _ratio(a: int, b: int) -> float:
    """``a / b`` as a float, also where neither fits one."""
    return a / b


def _projected(x: np.ndarray, model: Whitening) -> tuple[np.ndarray, list[int | None]]:
    """Whitened rows, and the exact sums of squares of ``n * x - sums`` (None beyond 64 bits)."""
    top = max(int(x.max(initial=0)), -int(x.min(initial=0)), 1)
    reach = model.n * top + max(abs(s) for s in model.sums)
    wide = reach * reach * x.shape[1] >= 1 << 63
    moved = (x.astype(object) if wide else x) * model.n - np.array(model.sums, dtype=object if wide else np.int64)
    squares = (moved * moved).sum(axis=1).tolist()
    exact = [v if v < 1 << 63 else None for v in squares]
    centred = (moved / model.n).astype(np.float64)
    return centred @ model.components.T / np.sqrt(np.array(model.values)), exact


def _identity_error(distinct: DataFrame, model: Whitening) -> float:
    """Covariance of the whitened vectors, added up by Spark, against the identity."""
    sent = distinct.sparkSession.sparkContext.broadcast(model)
    k = len(model.values)

    def partial(batches):
        m = sent.value
        total, square = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE_ROWS):
                w, _ = _projected(_matrix(batch.column("x").slice(first, SLICE_ROWS), len(m.sums)), m)
                total += w.sum(axis=0)
                square += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array([[*total, *square.ravel()]], pa.list_(pa.float64()))], ["sums"])

    sums = distinct.select("x").mapInArrow(partial, "sums array<double>")
    added = sums.select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()
    flat = np.array([r.v for r in added]) / model.n
    mean, square = flat[:k], flat[k:].reshape(k, k)
    return float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, model: Whitening, key: str = "vec_id") -> DataFrame:
    """One row per vector ``x`` and component: ``key, component, n, deviation, whitened, explained, identity_error``.

    ``deviation`` is the sum over the dimensions of ``(n * x - sums)^2``, exact, NULL beyond 64 bits.
    Rows are projected where they lie; repeated and NULL keys stay rows of their own.  Other
    columns are not read.
    """
    sent = vectors.sparkSession.sparkContext.broadcast(model)
    k = len(model.values)

    def project(batches):
        m = sent.value
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(first, SLICE_ROWS)
                if not k or not part.num_rows:
                    continue
                w, exact = _projected(_matrix(part.column("x"), len(m.sums)), m)
                rows = np.repeat(np.arange(len(w)), k)
                yield pa.RecordBatch.from_arrays([
                    part.column(key).take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(w))),
                    pa.array(np.full(len(rows), m.n, dtype=np.int64)), pa.array(exact, pa.int64()).take(pa.array(rows)),
                    pa.array(w.ravel()), pa.array(np.tile(m.explained, len(w))), pa.array(np.full(len(rows), m.identity_error))],
                    [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    schema = T.StructType([vectors.schema[key]]).add("component", "integer").add("n", "long").add("deviation", "long") \
        .add("whitened", "double").add("explained", "double").add("identity_error", "double")
    return vectors.select(key, "x").mapInArrow(project, schema)
