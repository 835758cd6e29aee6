"""Embedding whitening with an exact covariance.

Entries are integers (floor(64 * c) + 1,000,000), so sums and products are exact as long as
nothing is rounded. Each task splits the integers of a batch into limbs of LIMB bits and
multiplies limb matrices with BLAS in float64: products of two limbs, summed over at most
ROWS rows, stay below 2**53, so every such sum is exact. The limb products are put together
as Python integers, added up in the task, and leave it as signed digits of 32 bits, which
Spark sums exactly over all tasks. From n, the sums S and the products G,
V = (n * G - S S') / n**2 is the covariance without any rounding before the last division;
its eigenvectors are found in float64 on the driver (as wide as a vector, however many rows).

Edge cases: rows whose vector is null or holds null or non-finite entries are left out; null
ids and repeated rows are whitened each; vectors shorter than the widest count as padded
with zeros; entries beyond 2**56 saturate there; deviation is null where it does not fit a
long; components without variance (constant dimensions, fewer vectors than dimensions) have
whitened null and take no part in identity_error; an empty table, or one without a usable
vector, gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweave.llm.common import settle, table

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
LIMB = 20
#: Rows of one product of limbs: 2 * LIMB + 12 bits and a sign.
ROWS = 4096
#: Bits of the digits in which integers leave a task, and so many digits.
DIGIT, DIGITS = 32, 8
LARGEST = 1 << 56
#: A component below so much of the trace, a dimension, has no variance.
NOTHING = 1e-14


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """Integers as limbs of LIMB bits, the lowest first; the last one carries the sign."""
    out = []
    while True:
        small = np.abs(x).max(initial=0) < 1 << LIMB
        out.append((x if small else x & ((1 << LIMB) - 1)).astype(float))
        if small:
            return out
        x = x >> LIMB


def gram(x: np.ndarray) -> np.ndarray:
    """x' x as Python integers; x: int64, any number of rows."""
    total = np.zeros((x.shape[1], x.shape[1]), object)
    for at in range(0, len(x), ROWS):
        parts = limbs(x[at : at + ROWS])
        for i, a in enumerate(parts):
            for j, b in enumerate(parts[: i + 1]):
                product = (a.T @ b).astype(np.int64).astype(object)
                total += (product if i == j else product + product.T) << (LIMB * (i + j))
    return total


def column_sums(x: np.ndarray) -> np.ndarray:
    """Sums by column as Python integers; the halves of fewer than 2**31 rows fit an int64."""
    low, high = (x & ((1 << DIGIT) - 1)).sum(axis=0), (x >> DIGIT).sum(axis=0)
    return low.astype(object) + (high.astype(object) << DIGIT)


def digits(values: np.ndarray) -> np.ndarray:
    """Python integers as rows of DIGITS signed digits, the lowest first."""
    out = np.zeros((len(values), DIGITS), np.int64)
    sign = np.array([-1 if v < 0 else 1 for v in values])
    rest = np.array([abs(v) for v in values], object)
    for k in range(DIGITS):
        out[:, k] = (rest & ((1 << DIGIT) - 1)).astype(np.int64) * sign
        rest = rest >> DIGIT
    return out


def _undo(rows: list) -> dict[tuple[int, int], int]:
    return {(r["i"], r["j"]): sum(int(r[f"d{k}"]) << (DIGIT * k) for k in range(DIGITS)) for r in rows}


def integers(rows: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """key and x (array<long>), rows without a usable vector left out."""
    held = rows.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull())
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    good = held.where(~bad & (F.size("v") > 0))
    width = good.agg(F.max(F.size("v"))).first()[0] or 0
    top = float(LARGEST)
    whole = F.transform("v", lambda c: F.floor(F.least(F.greatest(c * SCALE, F.lit(-top)), F.lit(top))).cast("long") + SHIFT)
    short = F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(width) - F.size("v"))
    return good.select("key", F.concat(whole, short).alias("x"))


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of a task's rows: sums (i = -1) and products (j <= i) in digits, and in the row (-1, -1) their number."""
    n, total, product = 0, None, None
    for rows in batches:
        if not len(rows):
            continue
        x = np.stack(rows["x"].to_numpy()).astype(np.int64)
        part, sums = gram(x), column_sums(x)
        n, total, product = n + len(x), sums if total is None else total + sums, part if product is None else product + part
    if not n:
        return
    d = len(total)
    i, j = np.tril_indices(d)
    first, second = np.concatenate([[-1], np.full(d, -1), i]), np.concatenate([[-1], np.arange(d), j])
    values = digits(np.concatenate([np.array([n], object), total, product[i, j]]))
    yield pd.DataFrame({"i": first, "j": second, **{f"d{k}": values[:, k] for k in range(DIGITS)}})


def moments(fit: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """n, S and G of the fit list, exact; what reaches the driver is as large as G."""
    shape = "i int, j int, " + ", ".join(f"d{k} long" for k in range(DIGITS))
    sums = fit.select("x").mapInPandas(_moments, shape).groupBy("i", "j").agg(*(F.sum(f"d{k}").alias(f"d{k}") for k in range(DIGITS)))
    at = _undo(sums.collect())
    if not at:
        return 0, np.zeros(0, object), np.zeros((0, 0), object)
    d = 1 + max(j for _, j in at)
    g = np.array([[at[max(i, j), min(i, j)] for j in range(d)] for i in range(d)], object).reshape(d, d)
    return at[-1, -1], np.array([at[-1, j] for j in range(d)], object), g


def components(n: int, s: np.ndarray, g: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvectors (columns), eigenvalues by falling size, and the trace of V = (n G - S S') / n**2."""
    exact = n * g - np.outer(s, s)
    v = np.array([[float_of(c, n * n) for c in row] for row in exact])
    e, w = np.linalg.eigh((v + v.T) / 2)
    order = np.argsort(-e, kind="stable")[: min(most, len(e))]
    return w[:, order], e[order], float_of(int(np.trace(exact)), n * n)


def float_of(a: int, b: int) -> float:
    """a / b, rounded once."""
    return int(a) / int(b)


def centred(x: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
    """n * x - S, exact: as int64 where that holds it, else as Python integers."""
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, s), default=0) < 1 << 62:
        return n * x - s.astype(np.int64)
    return n * x.astype(object) - s


def projected(y: np.ndarray, n: int, w: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """(x - S/n) on the components, over the roots of their eigenvalues; y: n * x - S."""
    return (y / n).astype(float) @ w * scale


def _deviation(y: np.ndarray) -> list:
    """Sums of squares, exact; None beyond a long."""
    if y.dtype != object and y.shape[1] * float(np.abs(y).max(initial=0)) ** 2 < 2.0**62:
        return (y * y).sum(axis=1).tolist()
    out = [sum(int(c) ** 2 for c in row) for row in y]
    return [v if v < 1 << 63 else None for v in out]


def _spread(n: int, s, w, scale):
    """Of a task's fit vectors: number, means and centred products of the whitened values."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, mean, m2 = 0, 0.0, 0.0
        for rows in batches:
            if not len(rows):
                continue
            z = projected(centred(np.stack(rows["x"].to_numpy()).astype(np.int64), n, s), n, w, scale)
            own, k = z.mean(axis=0), len(z)
            off = own - mean
            m2 = m2 + (z - own).T @ (z - own) + np.outer(off, off) * m * k / (m + k)
            mean, m = mean + off * k / (m + k), m + k
        if m:
            yield pd.DataFrame({"m": [m], "mean": [mean.tolist()], "m2": [m2.ravel().tolist()]})

    return run


def identity_error(fit: DataFrame, n: int, s, w, scale) -> float | None:
    """The largest absolute entry of the whitened fit list's covariance less the identity."""
    k = len(scale)
    if not k:
        return None
    parts = settle(fit.select("x").mapInPandas(_spread(n, s, w, scale), "m long, mean array<double>, m2 array<double>"))
    means = parts.select("m", F.posexplode("mean").alias("i", "v")).groupBy("i").agg((F.sum(F.col("v") * F.col("m")) / n).alias("v")).collect()  # k rows
    mean = F.array(*(F.lit(r["v"]) for r in sorted(means, key=lambda r: r["i"])))
    off = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.get("mean", i) - F.get(mean, i))
    cells = parts.select("m", off.alias("off"), F.posexplode("m2").alias("c", "v"))
    row, column = F.expr(f"c div {k}").cast("int"), (F.col("c") % k).cast("int")
    cov = cells.groupBy("c").agg((F.sum(F.col("v") + F.col("m") * F.get("off", row) * F.get("off", column)) / n).alias("v")).collect()  # k * k rows
    return max(abs(r["v"] - (r["c"] // k == r["c"] % k)) for r in cov)


def whiten(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", most: int = COMPONENTS) -> DataFrame:
    """Per usable row and component: key, component, n, deviation, whitened, explained, identity_error."""
    x = settle(integers(rows, vector, key))
    fit = settle(x.select("x").distinct())
    n, s, g = moments(fit)
    kind = dict(x.dtypes)["key"]
    shape = f"`{key}` string, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not n:
        return rows.sparkSession.createDataFrame([], shape).withColumn(key, F.col(key).cast(kind))
    w, e, trace = components(n, s, g, most)
    full = e > NOTHING * max(trace, 0.0) * len(s)
    scale = np.where(full, 1 / np.sqrt(np.where(full, e, 1.0)), np.nan)
    error = identity_error(fit, n, s, w[:, full], scale[full])
    share = e / trace if trace > 0 else np.full(len(e), np.nan)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if not len(part):
                continue
            y = centred(np.stack(part["x"].to_numpy()).astype(np.int64), n, s)
            z = projected(y, n, w, scale)
            k = len(e)
            yield pd.DataFrame({
                key: part["key"].repeat(k).array, "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(part)), "n": n,
                "deviation": pd.Series(_deviation(y), dtype="Int64").repeat(k).array, "whitened": z.ravel(), "explained": np.tile(share, len(part)), "identity_error": error,
            })

    out = x.withColumn("key", F.col("key").cast("string")).mapInPandas(run, shape)  # as text, so that nulls do not make numbers of them
    nothing = [F.when(F.isnan(c), F.lit(None)).otherwise(F.col(c)).alias(c) for c in ("whitened", "explained")]
    return out.select(F.col(key).cast(kind).alias(key), "component", "n", "deviation", nothing[0], nothing[1], "identity_error")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op13_whitening": op13_whitening}
