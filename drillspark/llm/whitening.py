"""Embedding whitening by a bidiagonal qd solver.

Entries become whole numbers x = floor(256 c); the model is fitted on the
distinct x vectors (the fit list), so copies do not weigh twice.

1. Sums per dimension, exact, give the mean. The centred rows go block by block
   through QR factorisations inside the tasks; a task keeps one triangle, and
   the triangles of the tasks are merged in a tree of bounded groups. The last
   one, R, has R'R = n V for the covariance V of the fit list, without V ever
   being formed (which would square the condition number).
2. R is a d x d matrix, whatever the number of rows. Householder reflections from
   both sides make it bidiagonal, ``dqds`` finds its singular values to high
   relative accuracy, and twisted factorisations of B'B - lambda give a vector
   each; the right reflections carry it back to the dimensions of x.
3. Every row is projected on the components and divided by their deviations. The
   covariance of the whitened fit list is summed up in a further pass and
   compared with the identity.

Defined cases: rows whose vector is null, or holds a null or non-finite entry (or
one whose x is no long), are left out; among vectors of different lengths the
commonest length counts (of equal ones the largest) and others are left out;
empty tables, empty vectors and fit lists of a single vector give no rows.
Directions without variance (to double precision) are no components, so there
may be fewer than asked for. Repeated rows come back each, whitened alike.
``deviation`` is null where it is no long. Columns of the input named as a new one
are replaced.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ..session import checkpointed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

GRID = 256
LARGEST = float(1 << 62)  # x beyond it is no long
BLOCK_ROWS = 4096
MERGE_BYTES = 64 << 20  # of triangles in one task
EPS = np.finfo(float).eps


# --- the solver: a d x d triangle ------------------------------------------------


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Unit u with (I - 2uu')x = (alpha, 0, ...), and alpha."""
    norm = float(np.sqrt(x @ x))
    if norm == 0.0 or not np.any(x[1:]):
        return np.zeros_like(x), float(x[0])
    alpha = -norm if x[0] >= 0 else norm
    u = x.copy()
    u[0] -= alpha
    return u / np.sqrt(u @ u), alpha


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and superdiagonal of B = U'rW, and the reflections that make up W."""
    a = np.array(r, float)
    d = len(a)
    diagonal, upper, right = np.zeros(d), np.zeros(max(0, d - 1)), []
    for k in range(d):
        u, diagonal[k] = _reflector(a[k:, k])
        a[k:, k + 1 :] -= 2 * np.outer(u, u @ a[k:, k + 1 :])
        if k < d - 1:
            w, upper[k] = _reflector(a[k, k + 1 :])
            a[k + 1 :, k + 1 :] -= 2 * np.outer(a[k + 1 :, k + 1 :] @ w, w)
            right.append(w)
    return diagonal, upper, right


def _qd_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]]:
    """One differential qd transformation: the new q and e, and the d values."""
    new_q, new_e, ds = [], [], []
    d = q[0] - shift
    for k in range(len(e)):
        ds.append(d)
        top = d + e[k]
        if top <= 0.0:
            return [], [], [-1.0]
        ratio = q[k + 1] / top
        new_q.append(top)
        new_e.append(e[k] * ratio)
        d = d * ratio - shift
    ds.append(d)
    new_q.append(d)
    return new_q, new_e, ds


def dqds(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squares of the singular values of a bidiagonal matrix, largest first.

    The d values of an unshifted step are the inverses of the diagonal of (BB')^-1
    (Fernando & Parlett 1994); their harmonic sum is Newton's step from zero, a
    lower bound of the smallest square, which is a safe shift. A step that turns
    out negative all the same (rounding) is taken back with half the shift.
    """
    scale = max(np.abs(diagonal).max(initial=0), np.abs(upper).max(initial=0))
    if scale == 0:
        return np.zeros(len(diagonal))
    floor = 1e-200  # a zero on the diagonal is no obstacle, only a very small number
    whole_q = [max(float(x), floor) for x in (diagonal / scale) ** 2]
    whole_e = [float(x) for x in (upper / scale) ** 2]
    found: list[float] = []
    work = [(whole_q, whole_e, 0.0)]
    steps = 1000 * len(whole_q)
    while work:
        q, e, sigma = work.pop()
        while q:
            steps -= 1
            if steps < 0:
                raise ArithmeticError("the qd steps do not converge")
            if len(q) == 1:
                found.append(q[0] + sigma)
                break
            small = [k for k in range(len(e)) if e[k] <= EPS * EPS * (sigma + min(q[k], q[k + 1]))]
            if small:
                k = small[-1]
                work.append((q[: k + 1], e[:k], sigma))
                q, e = q[k + 1 :], e[k + 1 :]
                continue
            plain_q, plain_e, ds = _qd_step(q, e, 0.0)
            if min(ds) <= 0.0 or not plain_q:
                q = [max(x, floor) for x in plain_q or q]
                e = plain_e or e
                continue
            q, e = plain_q, plain_e
            shift = (1 - 4 * EPS * len(q)) / sum(1.0 / d for d in ds)
            while shift > EPS * EPS * (sigma + min(q)):
                shifted_q, shifted_e, ds = _qd_step(q, e, shift)
                if min(ds) >= 0.0:
                    q, e, sigma = [max(x, floor) for x in shifted_q], shifted_e, sigma + shift
                    break
                shift /= 2
    return np.sort(np.array(found))[::-1] * scale * scale


class _Twisted:
    """Twisted factorisation N D N' of B'B - value at the index with the
    smallest middle element."""

    def __init__(self, a: np.ndarray, b: np.ndarray, value: float):
        n = len(a)
        tiny = EPS * EPS * max(abs(value), float(np.max(a * a, initial=0)), 1e-300)
        s, p = np.zeros(n), np.zeros(n)
        down, up = np.zeros(n), np.zeros(n)  # pivots of the two factorisations
        s[0] = -value
        for i in range(n - 1):
            down[i] = a[i] * a[i] + s[i]
            down[i] = down[i] if abs(down[i]) > tiny else -tiny
            s[i + 1] = b[i] * b[i] * s[i] / down[i] - value
        p[n - 1] = a[n - 1] * a[n - 1] - value
        for i in range(n - 2, -1, -1):
            up[i + 1] = b[i] * b[i] + p[i + 1]
            up[i + 1] = up[i + 1] if abs(up[i + 1]) > tiny else -tiny
            p[i] = a[i] * a[i] * p[i + 1] / up[i + 1] - value
        gamma = s + p + value
        self.order = np.argsort(np.abs(gamma), kind="stable")
        self.k = int(self.order[0])
        middle = gamma[self.k] if abs(gamma[self.k]) > tiny else tiny
        self.pivot = np.concatenate([down[: self.k], [middle], up[self.k + 1 :]])
        self.lower = a[:-1] * b / np.where(down[:-1] == 0, 1, down[:-1])
        self.upper = a[:-1] * b / np.where(up[1:] == 0, 1, up[1:])

    def vector(self, k: int) -> np.ndarray:
        """z with N'z = the k-th unit vector."""
        z = np.zeros(len(self.pivot))
        z[k] = 1.0
        for i in range(k - 1, -1, -1):
            z[i] = -self.lower[i] * z[i + 1]
        for i in range(k, len(z) - 1):
            z[i + 1] = -self.upper[i] * z[i]
        return z / np.sqrt(z @ z)

    def solve(self, y: np.ndarray) -> np.ndarray:
        """A vector along (N D N')^-1 y."""
        y, k, n = y.copy(), self.k, len(y)
        for i in range(k):
            y[i + 1] -= self.lower[i] * y[i]
        for i in range(n - 1, k, -1):
            y[i - 1] -= self.upper[i - 1] * y[i]
        y /= self.pivot / np.abs(self.pivot).max()
        for i in range(k - 1, -1, -1):
            y[i] -= self.lower[i] * y[i + 1]
        for i in range(k, n - 1):
            y[i + 1] -= self.upper[i] * y[i]
        return y / np.abs(y).max()


def principal_directions(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Squares of the ``most`` largest singular values of a square ``r`` that are
    no rounding error, and its right singular vectors (columns)."""
    a, b, right = bidiagonalise(r)
    squares = dqds(a, b)
    good = squares > (len(squares) * EPS) ** 2 * squares[0] if len(squares) else np.zeros(0, bool)
    squares = squares[good][:most]
    scale = np.sqrt(squares[0]) if len(squares) else 1.0
    a, b = a / scale, b / scale
    found: list[np.ndarray] = []
    for value in squares / scale**2:
        twisted = _Twisted(a, b, float(value))

        def free(z: np.ndarray) -> np.ndarray:
            for other in found * 2:
                z = z - (z @ other) * other
            return z

        # an equal value has given its best vector away already: take the next index
        for k in twisted.order:
            z = free(twisted.vector(int(k)))
            if z @ z > 0.25:
                break
        for _ in range(2):  # values close to each other: iterate within what is left
            z = free(z / np.sqrt(z @ z))
            z = free(twisted.solve(z))
        found.append(z / np.sqrt(z @ z))
    out = np.array(found).T.reshape(len(a), len(found))
    for k in range(len(right) - 1, -1, -1):
        out[k + 1 :] -= 2 * np.outer(right[k], right[k] @ out[k + 1 :])
    return squares, out


# --- over the rows ---------------------------------------------------------------


def quantised(vector: Column) -> Column:
    """x of a vector, null where it has none."""
    c = lambda v: v.cast("double") * GRID
    whole = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(c(v)) < LARGEST))
    return F.when(whole, F.transform(vector, lambda v: F.floor(c(v)).cast("long")))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _blocks(batches, d: int):
    for batch in batches:
        rows = _matrix(batch.column("x"), d)
        for at in range(0, len(rows), BLOCK_ROWS):
            yield rows[at : at + BLOCK_ROWS]


def _sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """Count and exact sums per dimension."""

    def run(batches):
        n, total = 0, [0] * d
        for x in _blocks(batches, d):
            n += len(x)
            safe = int(np.abs(x).max(initial=0)) * len(x) < 1 << 62
            part = x.sum(axis=0) if safe else x.astype(object).sum(axis=0)
            total = [a + int(b) for a, b in zip(total, part)]
        digits = [str(v) for v in [n, *total]]
        yield pa.RecordBatch.from_arrays([pa.array(range(d + 1), pa.int32()), pa.array(digits)], ["at", "part"])

    parts = rows.mapInArrow(run, "at int, part string")
    found = parts.groupBy("at").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("s")).collect()  # d + 1 rows
    sums = {r.at: int(r.s) for r in found}
    return sums.get(0, 0), [sums.get(k + 1, 0) for k in range(d)]


def _triangle(rows: np.ndarray) -> np.ndarray:
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((rows.shape[1] - len(r), rows.shape[1]))])


def _reduce(rows: DataFrame, mean: np.ndarray) -> np.ndarray:
    """R of the centred rows: one triangle a task, merged group by group."""
    d = len(mean)

    def factor(batches):
        r = np.zeros((d, d))
        for x in _blocks(batches, d):
            r = _triangle(np.vstack([r, x - mean]))
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([r.tobytes()], pa.binary())], ["part", "r"])

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        stack = np.vstack([np.frombuffer(x.as_py()).reshape(d, d) for x in table["r"]])
        return pa.table({"part": table["group"][:1], "r": pa.array([_triangle(stack).tobytes()], pa.binary())})

    fan = max(2, MERGE_BYTES // (8 * d * d))
    table = checkpointed(rows.mapInArrow(factor, "part long, r binary"))
    parts = table.count()
    while parts > 1:
        grouped = table.withColumn("group", F.expr(f"part div {fan}")).groupBy("group")
        table = checkpointed(grouped.applyInArrow(merge, "part long, r binary"))
        parts = table.count()
    last = table.collect()  # one triangle
    return np.frombuffer(bytes(last[0].r)).reshape(d, d) if last else np.zeros((d, d))


@dataclass
class Model:
    """Fit list size and sums, the whitening directions (columns, already divided
    by the deviations), the share of the variance each explains, and the largest
    entry of the fit list's whitened covariance off the identity."""

    n: int
    sums: list[int]
    directions: np.ndarray
    explained: np.ndarray
    identity_error: float

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n x - S)^2, exactly."""
        reach = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums))
        if len(self.sums) * reach * reach < 1 << 63:
            off = self.n * x - np.array(self.sums, np.int64)
            return (off * off).sum(axis=1).tolist()
        off = self.n * x.astype(object) - np.array(self.sums, object)
        return [v if v < 1 << 63 else None for v in (off * off).sum(axis=1)]


def _identity_error(rows: DataFrame, n: int, mean: np.ndarray, directions: np.ndarray) -> float:
    d, k = directions.shape
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def run(batches):
        total = np.zeros(k + len(pairs))
        for x in _blocks(batches, d):
            y = (x - mean) @ directions
            total += np.concatenate([y.sum(axis=0), [y[:, i] @ y[:, j] for i, j in pairs]])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["at", "part"])

    found = rows.mapInArrow(run, "at int, part double").groupBy("at").agg(F.sum("part").alias("s")).collect()
    sums = {r.at: r.s for r in found}  # at most 14 rows for four components
    centre = [sums[i] / n for i in range(k)]
    return max(abs(sums[k + at] / n - centre[i] * centre[j] - (i == j)) for at, (i, j) in enumerate(pairs))


def fit(df: DataFrame, vector_col: str = "embedding", components: int = 4) -> Model | None:
    """The model of the distinct x vectors of ``df``; None without a component."""
    x = df.select(quantised(F.col(vector_col)).alias("x")).where("x IS NOT NULL")
    rows = checkpointed(x.groupBy("x").agg(F.count(F.lit(1)).alias("copies")))
    common = rows.groupBy(F.size("x").alias("d")).agg(F.sum("copies").alias("n"))
    length = common.orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not length or not length[0].d:
        return None
    d = length[0].d
    rows = rows.where(F.size("x") == d).select("x")
    n, sums = _sums(rows, d)
    mean = np.array([s / n for s in sums])
    r = _reduce(rows, mean)
    squares, directions = principal_directions(r, components)
    if not len(squares):
        return None
    directions = directions / np.sqrt(squares / n)
    error = _identity_error(rows, n, mean, directions)
    return Model(n, sums, directions, squares / float((r * r).sum()), error)


def whiten(df: DataFrame, model: Model, vector_col: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """The rows of ``df`` that have an x vector of the model's length, with
    ``deviation`` and ``whitened`` (one entry a component)."""
    new = [StructField("deviation", LongType()), StructField("whitened", ArrayType(DoubleType()))]
    kept = [f for f in df.schema.fields if f.name not in ("deviation", "whitened") and (keep is None or f.name in keep)]
    out = StructType([*kept, *new])
    arrow = to_arrow_schema(out)
    d, k = model.directions.shape
    mean = np.array([s / model.n for s in model.sums])
    # the input's columns in a struct: none of them can clash with x
    whole = F.struct(*[F.col(f.name) for f in kept]) if kept else F.struct(F.lit(None).alias("none"))
    rows = df.select(whole.alias("row"), quantised(F.col(vector_col)).alias("x")).where(F.size("x") == d)

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            y = (x - mean) @ model.directions
            made = [pa.array(model.deviation(x), pa.int64())]
            made.append(pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, k), pa.int32()), pa.array(y.ravel())))
            struct = batch.column("row")
            arrays = [struct.field(i) for i in range(len(kept))] + made
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, arrow)], schema=arrow)

    return rows.mapInArrow(run, out)


def whitened_components(df: DataFrame, id_col: str, vector_col: str = "embedding", components: int = 4) -> DataFrame:
    """A row for each remaining row of ``df`` and component, numbered from 1."""
    model = fit(df, vector_col, components)
    head = StructType([df.schema[id_col]])
    if model is None:
        tail = "component int, n long, deviation long, whitened double, explained double, identity_error double"
        return df.sparkSession.createDataFrame([], StructType([*head, *StructType.fromDDL(tail)]))
    shares = F.array(*[F.lit(float(s)) for s in model.explained])
    flat = whiten(df.select(id_col, F.col(vector_col)), model, vector_col, keep=[id_col])
    flat = flat.select(id_col, "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return flat.select(
        id_col,
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        shares[F.col("at")].alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )
