"""The ambient pool's sample fractions.

The fit depends on ambient molecules only through counts by variant, allele and
quality; Spark sums them, and the projected gradient runs on numpy arrays of
the size of the variant table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ...functions.columns import DEFAULT_TAU, MISSING_QUAL

EDGE = 1e-8


def allele_totals(observations: DataFrame) -> DataFrame:
    """vix, allele (0 or 1), qual, n."""
    return observations.where("allele <= 1").groupBy("vix", "allele", "qual").agg(F.count("*").alias("n"))


def project_to_simplex(x: np.ndarray) -> np.ndarray:
    """The nearest point with entries of at least 0 that sum to 1."""
    if len(x) < 2:
        raise ValueError("the simplex needs at least two entries")
    s = np.sort(x)[::-1]
    excess = (np.cumsum(s) - 1) / np.arange(1, len(x) + 1)
    return np.maximum(0, x - excess[np.flatnonzero(s > excess)[-1]])


def simplex_projection(df: DataFrame, key: str, value: str) -> DataFrame:
    """The projection of value (over all rows of a small table) with window functions."""
    every = Window.partitionBy(F.lit(0))
    down = every.orderBy(F.desc(value), key)
    excess = (F.sum(value).over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1) / F.row_number().over(down)
    last = F.max(F.when(F.col("__x") > F.col("__e"), F.struct("__k", "__e"))).over(every)["__e"]
    marked = df.select(key, F.col(value).alias("__x"), F.row_number().over(down).alias("__k"), excess.alias("__e"))
    return marked.select(key, F.greatest(F.lit(0.0), F.col("__x") - last).alias(value))


def gradient_terms(totals: DataFrame, gammas: DataFrame, samples: int) -> DataFrame:
    """d: an array over samples, the gradient of the ambient log-likelihood by sample fraction.

    gammas has the ambient source first (its current value is the point).
    """
    tau = F.when(F.col("qual") == MISSING_QUAL, DEFAULT_TAU).otherwise(F.pow(F.lit(10.0), -F.col("qual") / 10))
    x = F.least(F.greatest(F.col("gammas")[0], F.lit(EDGE)), F.lit(1 - EDGE))
    a = F.when(F.col("allele") == 1, F.col("x")).otherwise(1 - F.col("x"))
    joined = totals.join(gammas, "vix").where("gammas[0] is not null").withColumns({"tau": tau, "x": x}).withColumn("a", a)
    clean = (1 - F.col("tau")) * F.col("a") / ((1 - F.col("tau")) * F.col("a") + F.col("tau") / 2)
    slope = F.col("n") * clean * (F.col("allele") - F.col("x")) / (F.col("x") * (1 - F.col("x")))
    joined = joined.withColumn("slope", slope)
    return joined.agg(F.array(*[F.sum(F.col("slope") * F.coalesce(F.col("gammas")[s + 1], F.lit(0.0))) for s in range(samples)]).alias("d"), F.sum(F.col("n") * (1 - F.col("tau"))).alias("n"))


def fit_pi_amb(vix: np.ndarray, allele: np.ndarray, tau: np.ndarray, n: np.ndarray, gamma: np.ndarray, eps: float = 1e-6, max_iter: int = 10_000) -> tuple[np.ndarray, np.ndarray]:
    """Fractions of the samples in the ambient pool, and the pool's gamma by variant.

    gamma: samples x variants, NaN where missing.
    """
    m = gamma.shape[0]
    pi = np.full(m, 1 / m)
    known, filled = ~np.isnan(gamma), np.nan_to_num(gamma)

    def pool(p: np.ndarray) -> np.ndarray:
        weight = p @ known
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(weight > 0, np.minimum(1, p @ filled / weight), np.nan)

    usable = known.any(0)[vix]
    vix, allele, tau, n = vix[usable], allele[usable], tau[usable], n[usable]
    total = float(((1 - tau) * n).sum())
    if total == 0:
        return pi, pool(pi)
    for _ in range(max_iter):
        x = np.clip(np.nan_to_num(pool(pi), nan=0.5), EDGE, 1 - EDGE)[vix]
        a = np.where(allele == 1, x, 1 - x)
        slope = n * ((1 - tau) * a / ((1 - tau) * a + tau / 2)) * (allele - x) / (x * (1 - x))
        new = project_to_simplex(pi + filled[:, vix] @ slope / total)
        change = np.linalg.norm(new - pi) / max(np.linalg.norm(pi), 1e-300)
        pi = new
        if change < eps:
            break
    return pi, pool(pi)
