"""Whitening of embeddings by spectral divide and conquer over polar decompositions.

Every entry c becomes the integer floor(64 c) + 1,000,000. The fit list holds each distinct integer vector once; its count n,
its sums S and its covariance V (centred, divisor n) are gathered in the tasks and added up by Spark, one number for each pair
of dimensions and task. V is as wide as the vectors, so the driver may hold it.

The eigenvectors of V come from ``spectrum``: the dynamically weighted Halley iteration finds the orthogonal polar factor U of
V - s I, (U + I) / 2 projects on the eigenvectors above the shift s, a QR factorisation of that projector gives bases of both
invariant subspaces, and each half is split in the same way until it is one component (or a multiple of the identity, whose
every basis consists of eigenvectors). The matrix of components is then broadcast in the closure and applied to every row.

Vectors of different lengths have nothing in common and are fitted apart. Rows with a null vector, an empty one, or null or
non-finite entries are left out; a null vec_id stays null. Repeated rows count once in the fit and are all returned. Components
without variance (an eigenvalue at most the rounding error of the largest) cannot be scaled to one and are not returned; a
fit list of one vector so has no rows. Entries of 2^40 or more are an error, as are deviations beyond 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import quoted
from tablewright.llm.shared import cut_lineage

COMPONENTS = 16
SCALE, OFFSET = 64, 1_000_000
EPS = np.finfo(np.float64).eps


def polar_factor(a: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix, by the QR form of the weighted Halley iteration.

    The weights follow a lower bound of the smallest singular value, which starts at the rounding error.
    """
    size = np.abs(a).sum(1).max()
    x, low, eye = a / size, EPS, np.eye(len(a))
    for _ in range(rounds):
        square = low * low
        d = np.cbrt(4 * (1 - square) / (square * square)) if low < 1 else 0.0
        root = np.sqrt(1 + d)
        p = root + 0.5 * np.sqrt(max(8 - 4 * d + 8 * (2 - square) / (square * root), 0.0))
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        both = np.linalg.qr(np.vstack([np.sqrt(r) * x, eye]))[0]
        new = (q / r) * x + (p - q / r) / np.sqrt(r) * both[:len(a)] @ both[len(a):].T
        moved = np.linalg.norm(new - x)
        x = (new + new.T) / 2
        low = min(1.0, low * (p + q * square) / (1 + r * square))
        if moved <= 1e-14 * len(a) and 1 - low < 1e-12:
            break
    return x


def _split(a: np.ndarray, shift: float, seed: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the invariant subspaces above and below the shift; None if the shift does not part them cleanly."""
    m = len(a)
    projector = (polar_factor(a - shift * np.eye(m)) + np.eye(m)) / 2
    rank = int(round(np.trace(projector)))
    if not 0 < rank < m or abs(np.trace(projector) - rank) > 1e-6:
        return None
    mix = np.random.default_rng(seed).standard_normal((m, m))
    mix[:, :rank] = projector @ mix[:, :rank]
    mix[:, rank:] -= projector @ mix[:, rank:]
    for _ in range(2):  # the second round takes out what rounding left of the other half
        basis = np.linalg.qr(mix)[0]
        mix = np.hstack([projector @ basis[:, :rank], basis[:, rank:] - projector @ basis[:, rank:]])
    basis = np.linalg.qr(mix)[0]
    above, below = basis[:, :rank], basis[:, rank:]
    return (above, below) if np.abs(above.T @ a @ below).max() <= 1e-12 * np.abs(a).max() * m else None


def spectrum(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    a = (a + a.T) / 2
    whole = max(np.abs(a).max(), np.finfo(np.float64).tiny)
    values, vectors = [], []
    work = [(a, np.eye(len(a)))]
    while work:
        part, basis = work.pop()
        m = len(part)
        centre = np.trace(part) / m
        if m == 1 or np.abs(part - centre * np.eye(m)).max() <= EPS * whole:
            values += np.diag(part).tolist()
            vectors += list(basis.T)
            continue
        # the mean lies strictly between the smallest and the largest eigenvalue, and so does the middle of the diagonal's
        # range unless the diagonal is level; steps aside leave a shift that hits an eigenvalue
        diagonal, spread = np.diag(part), np.linalg.norm(part - centre * np.eye(m)) / np.sqrt(m)
        shifts = [float(np.median(diagonal)), centre] + [centre + s * spread for s in (1e-3, -1e-3, 1e-2, -1e-2, 0.05, -0.05, 0.2, -0.2, 0.5, -0.5)]
        halves = next((h for i, s in enumerate(shifts) if (h := _split(part, s, i)) is not None), None)
        if halves is None:  # eigenvalues that agree to rounding: no shift parts them, and none needs to
            if spread > 1e-9 * whole:
                raise ArithmeticError("no shift splits the covariance")
            values += diagonal.tolist()
            vectors += list(basis.T)
            continue
        for half in halves:
            inner = half.T @ part @ half
            work.append(((inner + inner.T) / 2, basis @ half))
    order = np.argsort(-np.array(values), kind="stable")
    found = np.linalg.qr(np.array(vectors).T[:, order])[0]
    return np.einsum("ij,ik,kj->j", found, a, found, optimize=True), found


def _rows(batch: pa.RecordBatch, column: int, kind) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{length: (row numbers, matrix)} of a list column."""
    lists = batch.column(column)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    found = {}
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        found[n] = at, lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(at), n)
    return found


def _summed(vectors: DataFrame, piece) -> dict[tuple, float]:
    """{(length, i, j): sum} of the numbers that ``piece(length, matrix)`` gives for each batch, added up in tasks, then by Spark."""
    def run(batches):
        total: dict = {}
        for batch in batches:
            for n, (_, x) in _rows(batch, 0, np.int64).items():
                new = piece(n, x)
                total[n] = total[n] + new if n in total else new
        for n, matrix in total.items():
            i, j = np.nonzero(np.triu(np.ones(matrix.shape, bool)) if matrix.shape[0] == matrix.shape[1] else np.ones(matrix.shape, bool))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), n), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()),
                                              pa.array(matrix[i, j].astype(np.float64))], ["n", "i", "j", "value"])

    sums = vectors.select("x").mapInArrow(run, "n int, i int, j int, value double").groupBy("n", "i", "j").agg(F.sum("value").alias("value"))
    return {(r.n, r.i, r.j): r.value for r in sums.collect()}


def _square(sums: dict, n: int, size: int) -> np.ndarray:
    matrix = np.zeros((size, size))
    for i in range(size):
        for j in range(i, size):
            matrix[i, j] = matrix[j, i] = sums[n, i, j]
    return matrix


def whitened(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for every usable row and component."""
    v = quoted(vector_col)
    usable = (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(F.col("v"), lambda c: F.when(F.abs(c) < float(1 << 40), F.floor(c * SCALE) + OFFSET).otherwise(
        F.raise_error(F.lit("an embedding has an entry of 2^40 or more")).cast("long")))
    rows = table.select(quoted(id_col).alias("vec_id"), F.when(usable, v.cast("array<double>")).alias("v")).where("v IS NOT NULL").select(
        "vec_id", x.alias("x"))
    fit = cut_lineage(rows.select("x").distinct())
    # sums of whole numbers: exact as decimals, whatever the number of rows
    sums = {(r.n, r.j): int(r.s) for r in fit.select(F.size("x").alias("n"), F.posexplode("x").alias("j", "c")).groupBy("n", "j")
            .agg(F.sum(F.col("c").cast("decimal(38,0)")).alias("s")).collect()}
    count = {r.n: r["count"] for r in fit.groupBy(F.size("x").alias("n")).count().collect()}
    total = {n: [sums[n, j] for j in range(n)] for n in count}
    # S/n to double precision; the whole part is taken off first, so that nothing is lost beside the offset
    whole = {n: np.array([s // count[n] for s in t], np.int64) for n, t in total.items()}
    part = {n: np.array([s % count[n] / count[n] for s in t]) for n, t in total.items()}

    def centred(n: int, m: np.ndarray) -> np.ndarray:
        return (m - whole[n]) - part[n]

    def products(n, m):
        c = centred(n, m)
        return c.T @ c

    raw = _summed(fit, products)
    maps, shares = {}, {}
    for n in count:
        values, vectors = spectrum(_square(raw, n, n) / count[n])
        trace = values.sum()
        some = [k for k in range(min(components, n)) if values[k] > n * EPS * values[0]]
        maps[n] = vectors[:, some] / np.sqrt(values[some])
        shares[n] = (values[some] / trace).tolist() if some else []

    def again(n, m):
        w = centred(n, m) @ maps[n]
        return np.vstack([w.sum(0)[None, :], w.T @ w])

    check = _summed(fit, again)
    worst = {}
    for n in count:
        k = maps[n].shape[1]
        mean = np.array([check[n, 0, j] for j in range(k)]) / count[n]
        cov = np.array([[check[n, i + 1, j] for j in range(k)] for i in range(k)]).reshape(k, k) / count[n] - np.outer(mean, mean)
        worst[n] = float(np.abs(cov - np.eye(k)).max()) if k else 0.0
    base = rows.schema["vec_id"].dataType
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches):
        for batch in batches:
            for n, (at, m) in _rows(batch, 1, np.int64).items():
                k = maps[n].shape[1]
                if not k:
                    continue
                # n x - S = n (x - whole) - rest, in 64-bit integers where these hold the sum of squares
                rest = np.array([s % count[n] for s in total[n]], np.int64)
                gap = m - whole[n]
                if float(np.abs(gap).max() + 1) * count[n] * np.sqrt(n) >= 3.0e9:
                    exact = [sum((count[n] * int(c) - int(r)) ** 2 for c, r in zip(row, rest)) for row in gap]
                    if max(exact) >= 1 << 63:
                        raise OverflowError("a deviation does not fit in 64 bits")
                    deviation = np.array(exact, np.int64)
                else:
                    deviation = ((count[n] * gap - rest) ** 2).sum(1)
                w = centred(n, m) @ maps[n]
                rows_out = len(at) * k
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1), len(at)), pa.int32()),
                    pa.array(np.full(rows_out, count[n]), pa.int64()), pa.array(np.repeat(deviation, k), pa.int64()), pa.array(w.reshape(-1)),
                    pa.array(np.tile(shares[n], len(at))), pa.array(np.full(rows_out, worst[n]))], names)

    schema = f"vec_id {base.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return rows.mapInArrow(run, schema)
