"""Whitening of embedding vectors on the leading components of their covariance, found by contour integration.

Entries become whole numbers, so sums and products over all rows are exact whatever the order of the tasks. Every task
gives one block of sums and one of products; Spark adds the blocks up. The covariance of ``d`` dimensions (d * d
numbers, whatever the number of rows) is then cut into slices of its spectrum:

* inertia (signs of the pivots of an LDL' factorisation of the shifted covariance) tells how many eigenvalues lie above
  a shift, and bisection with it finds slices of few eigenvalues each;
* the resolvent, integrated on a circle around a slice by Gauss-Legendre quadrature, is a filter that keeps the slice's
  eigenvectors: one solve with a complex shift for each node;
* Rayleigh-Ritz on the filtered block gives the components, and is repeated until their residuals are at rounding level;
* a slice is accepted only if as many components were found in it as its inertia counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bindmill.llm.common import read

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
LIMIT = float(1 << 52)  # entries whose scaled value is not below it are no whole numbers in double precision
SLICE = 4  # eigenvalues in a slice of the spectrum, more where they are equal
NODES = 16
ROUNDS = 40
LIMB = 17  # bits; products of two limbs over 2^18 rows stay exact in double precision
FLAT = 1e-12  # components with a smaller share of the trace have no direction to scale


def inertia_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix exceed ``shift``: positive pivots of P(A - shift I)P' = LDL'."""
    a = matrix - shift * np.eye(len(matrix))
    ratio, positive = (1 + 17 ** 0.5) / 8, 0
    while len(a):
        diagonal = np.abs(np.diag(a))
        off = np.abs(np.triu(a, 1))
        largest = off.max() if len(a) > 1 else 0.0
        if diagonal.max() >= ratio * largest:
            chosen, size = [int(diagonal.argmax())], 1
        else:
            chosen, size = list(np.unravel_index(int(off.argmax()), off.shape)), 2
        order = np.array([*chosen, *np.setdiff1d(np.arange(len(a)), chosen)])
        a = a[np.ix_(order, order)]
        pivot, below = a[:size, :size], a[size:, :size]
        if size == 2:
            positive += 1  # such a pivot has one eigenvalue of either sign
        else:
            positive += int(pivot[0, 0] > 0)
            if pivot[0, 0] == 0:  # nothing left but zeros
                break
        a = a[size:, size:] - below @ np.linalg.solve(pivot, below.T)
        a = (a + a.T) / 2
    return positive


def slices(matrix: np.ndarray, wanted: int, width: int = SLICE) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside) from the top until ``wanted`` eigenvalues are covered."""
    reach = float(np.abs(matrix).sum(axis=1).max()) or 1.0

    def cut(count: int, low: float, high: float, close: float) -> float:
        """A shift with ``count`` eigenvalues above it, or with more where the next ones are as good as equal."""
        while high - low > close:
            middle = (low + high) / 2
            above = inertia_above(matrix, middle)
            if above == count and count:
                return middle
            low, high = (middle, high) if above > count else (low, middle)
        return low if count else high

    found, above, high = [], 0, cut(0, -reach * 1.01, reach * 1.01, reach * 1e-4)
    while above < wanted:
        low = cut(min(above + width, wanted), -reach * 1.01, high, reach * 1e-10)
        count = inertia_above(matrix, low)
        found.append((low, high, count - above))
        above, high = count, low
    return found


def contour_filter(matrix: np.ndarray, block: np.ndarray, low: float, high: float, nodes: int = NODES) -> np.ndarray:
    """The block's part in the eigenvectors of [low, high], by quadrature of the resolvent on the upper half circle."""
    middle, radius = (low + high) / 2, (high - low) / 2
    x, weight = np.polynomial.legendre.leggauss(nodes)
    turn = np.exp(1j * np.pi / 2 * (1 + x))
    kept = np.zeros_like(block)
    for point, w in zip(turn, weight):
        solved = np.linalg.solve((middle + radius * point) * np.eye(len(matrix)) - matrix, block.astype(complex))
        kept += w / 2 * (radius * point * solved).real
    return kept


def slice_components(matrix: np.ndarray, low: float, high: float, count: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and unit eigenvectors of one slice; an error if they are not as many as ``count``."""
    d, draw = len(matrix), np.random.default_rng(seed)
    size = min(d, 2 * count + 4)
    block = draw.standard_normal((d, size))
    tight = 64 * np.finfo(float).eps * max(float(np.linalg.norm(matrix)), np.finfo(float).tiny)
    best, settled = np.inf, 0
    for _ in range(ROUNDS):
        base, _ = np.linalg.qr(contour_filter(matrix, block, low, high))
        values, turned = np.linalg.eigh(base.T @ matrix @ base)
        block = base @ turned
        inside = (values > low) & (values <= high)
        residual = np.linalg.norm(matrix @ block[:, inside] - block[:, inside] * values[inside], axis=0)
        worst = float(residual.max()) if inside.sum() == count else np.inf
        settled = settled + 1 if worst <= tight or worst >= best / 2 and np.isfinite(best) else 0
        best = min(best, worst)
        if inside.sum() == count and settled and best <= tight * 1e3:
            return values[inside], block[:, inside]
        if inside.sum() < count:  # some directions are missing from the block
            block[:, :max(1, size - count)] = draw.standard_normal((d, max(1, size - count)))
    raise RuntimeError(f"{int(inside.sum())} of {count} components of a slice found")


def leading_components(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and their unit eigenvectors as columns (largest entry positive)."""
    wanted, scale = min(wanted, len(matrix)), float(np.abs(matrix).max(initial=0.0))
    if not wanted or scale == 0.0:
        return np.zeros(wanted), np.eye(len(matrix))[:, :wanted]
    unit = matrix / scale
    parts = [slice_components(unit, low, high, count, k) for k, (low, high, count) in enumerate(slices(unit, wanted))]
    base, _ = np.linalg.qr(np.hstack([vectors for _, vectors in parts]))
    values, turned = np.linalg.eigh(base.T @ unit @ base)
    vectors = (base @ turned)[:, ::-1][:, :wanted]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(wanted)])
    return values[::-1][:wanted] * scale, vectors * sign


def gram(rows: np.ndarray) -> np.ndarray:
    """Exact products of whole-number columns, as a matrix of Python integers."""
    total = np.zeros((rows.shape[1], rows.shape[1]), dtype=object)
    for at in range(0, len(rows), 1 << 18):
        left, limbs = rows[at:at + (1 << 18)].astype(np.int64), []
        while True:
            low = ((left + (1 << LIMB - 1)) & ((1 << LIMB) - 1)) - (1 << LIMB - 1)
            limbs.append(low.astype(float))
            left = (left - low) >> LIMB
            if not left.any():
                break
        for a, one in enumerate(limbs):
            for b, other in enumerate(limbs):
                total = total + ((one.T @ other).astype(np.int64).astype(object) << (LIMB * (a + b)))
    return total


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 0), np.int64)


def _totals(frame: DataFrame, column: str, parts) -> np.ndarray:
    """Sum over all rows of what ``parts`` gives for a matrix of rows; one row per task and place is exchanged."""
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = 0
        for batch in batches:
            if len(batch):
                total = total + parts(_matrix(batch[column]))
        if not isinstance(total, int):
            yield pd.DataFrame({"place": np.arange(len(total)), "value": [Decimal(int(x)) for x in total]})

    added = frame.select(column).mapInPandas(add, "place int, value decimal(38,0)")
    rows = added.groupBy("place").agg(F.sum("value").alias("value")).collect()  # a row per place
    out = np.zeros(len(rows), dtype=object)
    for row in rows:
        out[row["place"]] = int(row["value"])
    return out


def usable(vector: Column) -> Column:
    """True for vectors whose entries are all there, finite and small enough to be whole numbers after scaling."""
    ok = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < LIMIT / SCALE)
    return F.coalesce(F.forall(vector, ok), F.lit(False))


def whole_numbers(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)


def whiten(frame: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``frame`` without ``vector`` but with component, n, deviation, whitened, explained, identity_error.

    One row per usable row and component, ``components`` at most and as many as there are dimensions. Rows are left
    out whose vector is null or empty, holds a null, a NaN, an infinity or an entry of 2^42 or more, or has another
    length than most vectors have (ties: the longer). ``deviation`` is decimal(38,0). Components that hold less than
    1e-12 of the variance (all of them for one row or equal rows) have a null ``whitened`` and do not count in
    ``identity_error``. Repeated rows count as often as they are there. New columns replace those of the same names.
    """
    new = ("component", "n", "deviation", "whitened", "explained", "identity_error")
    kept = [c for c in frame.columns if c != vector and c.lower() not in new]
    packed = frame.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row") if kept else F.lit(1).alias("row"),
                          F.col(f"`{vector}`").alias("v")).where(usable(F.col("v")) & (F.size("v") > 0))
    lengths = packed.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    schema = packed.schema["row"].dataType
    if lengths is None:
        empty = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
        none = frame.sparkSession.createDataFrame([], empty)
        fields = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields] if kept else []
        return none.select(*fields, *new)
    d, n = int(lengths["d"]), int(lengths["count"])
    rows = packed.where(F.size("v") == d).select("row", whole_numbers(F.col("v")).alias("x"))

    sums = _totals(rows, "x", lambda x: (x >> 26).sum(axis=0).astype(object) * (1 << 26)
                   + (x & ((1 << 26) - 1)).sum(axis=0).astype(object))
    pivot = np.array([(2 * int(s) + n) // (2 * n) for s in sums], dtype=np.int64)  # whole numbers next to the means
    rest = np.array([int(s) - n * int(p) for s, p in zip(sums, pivot)], dtype=object)  # sums of x - pivot
    products = _totals(rows, "x", lambda x: gram(x - pivot).ravel()).reshape(d, d)
    exact = n * products - np.outer(rest, rest)
    covariance = np.array([[int(x) / (n * n) for x in line] for line in exact], dtype=float)
    values, vectors = leading_components(covariance, components)
    trace = sum(int(exact[i, i]) for i in range(d)) / (n * n)
    firm = values > FLAT * trace
    turn = vectors / np.where(firm, np.sqrt(np.where(firm, values, 1.0)), np.nan)
    mean = np.array([int(r) / n for r in rest], dtype=float)

    def project(x: np.ndarray) -> np.ndarray:
        return ((x - pivot).astype(float) - mean) @ turn

    identity_error = _identity_error(rows, project, n, firm)
    squares, top = sum(int(r) ** 2 for r in rest), max((abs(int(r)) for r in rest), default=0)

    def deviations(y: np.ndarray) -> list[Decimal]:
        """Sums of (n y - rest)^2, from exact sums of y^2 and of y * rest."""
        most = int(np.abs(y).max(initial=0))
        kind = np.int64 if d * most * max(most, top, 1) < 1 << 62 else object
        own, cross = (y.astype(kind) ** 2).sum(axis=1), y.astype(kind) @ rest.astype(kind)
        return [Decimal(n * n * int(a) - 2 * n * int(b) + squares) for a, b in zip(own, cross)]

    @F.pandas_udf("deviation decimal(38,0), whitened array<double>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = _matrix(batch)
            z = list(project(x)) if len(x) else []
            yield pd.DataFrame({"deviation": deviations(x - pivot) if len(x) else [], "whitened": z})

    share = F.array(*[F.lit(float(e) / trace if trace else 0.0) for e in values])
    told = rows.withColumn("s", scored("x")).select("row", "s.deviation", F.posexplode("s.whitened").alias("k", "z"))
    fields = ["row.*"] if kept else []
    return told.select(*fields, (F.col("k") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"),
                       "deviation", F.when(~F.isnan("z"), F.col("z")).alias("whitened"),
                       F.get(share, F.col("k")).alias("explained"), F.lit(identity_error).alias("identity_error"))


def _identity_error(rows: DataFrame, project, n: int, firm: np.ndarray) -> float:
    """Largest entry of the whitened rows' covariance minus the identity, measured on all rows."""
    k = int(firm.sum())
    if not k:
        return 0.0

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if len(batch):
                z = project(_matrix(batch["x"]))[:, firm]
                sums, products = sums + z.sum(axis=0), products + z.T @ z
        values = np.concatenate([sums, products.ravel()])
        yield pd.DataFrame({"place": np.arange(len(values)), "value": values})

    parts = rows.select("x").mapInPandas(add, "place int, value double").groupBy("place").agg(F.sum("value").alias("v"))
    values = np.array([r["v"] for r in sorted(parts.collect(), key=lambda r: r["place"])])  # k + k * k numbers
    mean = values[:k] / n
    return float(np.abs(values[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())


def op11_feast_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector on the eight leading components; deviations beyond a long are null."""
    table = read(spark, folder, "embeddings").select("vec_id", "embedding")
    return whiten(table).withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


QUERIES = {"op11_feast_whitening": op11_feast_whitening}
ORACLES: dict[str, str] = {}
