"""The fit: contamination of each droplet, and the weights of hypotheses.

Ambient fractions and so the molecule probabilities are fixed before the loop.
An outer iteration is one Spark job: each droplet estimates its contamination
alpha for every hypothesis and modality by Newton's method, and returns one log
likelihood per hypothesis.  The weights then iterate on that matrix (droplets x
hypotheses) alone; no molecule is read again.  Up to ``DRIVER_CELLS`` cells the
matrix goes to the driver; a larger one stays distributed, and each step is one
aggregation.

Droplets of more than ``most_rows`` distinct molecules are not gathered: their
derivatives are summed by Spark in each Newton step.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.columns import log_sum_exp
from ...scratch import Scratch
from .likelihood import Hypothesis, hypotheses, mixture

ALPHA_LOW, ALPHA_HIGH = 1e-12, 1 - 1e-10
PSEUDO = 1e-8
DRIVER_CELLS = 2_000_000


@dataclass
class Parameters:
    """Weights of the model; prior: mean of alpha by modality."""

    lam: np.ndarray
    pi: np.ndarray
    pi_amb: np.ndarray
    prior: dict[str, float] = field(default_factory=dict)
    prior_weight: float = 1e-8
    iterations: int = 0


def initial(n_samples: int, n_ambient: float, n_test: float, modalities: list[str], prior_weight: float = 1e-8) -> Parameters:
    lam = np.array([n_ambient + 1, 0.9 * n_test + 1, 0.1 * n_test + 1])
    even = np.full(n_samples, 1 / n_samples)
    return Parameters(lam / lam.sum(), even, even.copy(), dict.fromkeys(modalities, 0.1), prior_weight)


def sample_priors(hyps: list[Hypothesis], pi: np.ndarray) -> np.ndarray:
    """log P(samples | number of cells)."""
    pairs = sum(pi[h.s1] * pi[h.s2] for h in hyps if h.h == 2)
    with np.errstate(divide="ignore"):
        return np.log([1.0 if h.h == 0 else pi[h.s1] if h.h == 1 else pi[h.s1] * pi[h.s2] / pairs for h in hyps])


def newton_alpha(probs: np.ndarray, n: np.ndarray, hyps: list[Hypothesis], prior: float, weight: float, start: np.ndarray, eps: float = 1e-6, max_iter: int = 500) -> np.ndarray:
    """Alpha for every hypothesis of one droplet and modality; probs: molecules x sources."""
    alpha = np.ones(len(hyps))
    if not len(n):
        alpha[1:] = prior
        return alpha
    cells = np.stack([probs[:, [s + 1 for s in h.samples]].mean(1) for h in hyps[1:]], 1)
    x = probs[:, :1] - cells
    a, live = start[1:].copy(), np.ones(len(hyps) - 1, bool)
    for _ in range(max_iter):
        cur = a[live]
        ratio = x[:, live] / (cur * probs[:, :1] + (1 - cur) * cells[:, live])
        d1 = weight * prior / cur - weight * (1 - prior) / (1 - cur) + n @ ratio
        d2 = -weight * prior / cur**2 - weight * (1 - prior) / (1 - cur) ** 2 - n @ ratio**2
        new = np.clip(cur - np.divide(d1, d2, out=np.zeros_like(d1), where=d2 != 0), ALPHA_LOW, ALPHA_HIGH)
        done = np.abs(new - cur) / cur < eps
        a[live] = new
        live[np.flatnonzero(live)[done]] = False
        if not live.any():
            break
    alpha[1:] = a
    return alpha


def _one_droplet(rows: pd.DataFrame, hyps, modalities, prior, weight, eps) -> dict:
    out: dict = {}
    llk = np.zeros(len(hyps))
    for m in modalities:
        part = rows[rows["modality"] == m]
        probs = np.array(part["probs"].tolist()).reshape(len(part), -1)
        n = part["n"].to_numpy(float)
        before = part["start"].iloc[0] if len(part) and part["start"].iloc[0] is not None else None
        start = np.array(before) if before is not None else np.full(len(hyps), 0.5)
        alpha = newton_alpha(probs, n, hyps, prior[m], weight, start, eps)
        for h in hyps:
            a = alpha[h.ix]
            if len(n):
                psi = probs[:, 0] if h.h == 0 else a * probs[:, 0] + (1 - a) * probs[:, [s + 1 for s in h.samples]].mean(1)
                llk[h.ix] += float(n @ np.log(psi))
            if h.h:
                llk[h.ix] += weight * (prior[m] * np.log(a) + (1 - prior[m]) * np.log(1 - a))
        out[f"alpha_{m}"] = alpha.tolist()
    return out | {"llk": llk.tolist()}


def fit_alpha(molecules: DataFrame, hyps: list[Hypothesis], modalities: list[str], prior: dict[str, float], weight: float, eps: float = 1e-6, most_rows: int = 1_000_000, starts: DataFrame | None = None) -> DataFrame:
    """Per droplet: alpha_<modality> and llk (with the priors' terms), arrays over hypotheses.

    molecules: droplet, modality, probs, n; distinct ones with multiplicity.
    """
    large = [r["droplet"] for r in molecules.groupBy("droplet").agg(F.count("*").alias("k")).where(F.col("k") > most_rows).select("droplet").collect()]
    small = molecules.where(~F.col("droplet").isin(large)) if large else molecules
    if starts is not None:
        long = starts.select("droplet", F.inline(F.array(*[F.struct(F.lit(m).alias("modality"), F.col(f"alpha_{m}").alias("start")) for m in modalities])))
        small = small.join(long, ["droplet", "modality"], "left")
    else:
        small = small.withColumn("start", F.lit(None).cast("array<double>"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"droplet": key[0], **_one_droplet(rows, hyps, modalities, prior, weight, eps)}])

    schema = "droplet string, " + "".join(f"alpha_{m} array<double>, " for m in modalities) + "llk array<double>"
    got = small.groupBy("droplet").applyInPandas(run, schema)
    for droplet in large:
        got = got.unionByName(_large_droplet(molecules.where(F.col("droplet") == droplet), droplet, hyps, modalities, prior, weight, eps))
    return got


def _large_droplet(molecules: DataFrame, droplet: str, hyps, modalities, prior, weight, eps) -> DataFrame:
    """One droplet's fit with sums made by Spark; the driver holds one alpha per hypothesis."""
    llk, alphas = np.zeros(len(hyps)), {}
    p, n = F.col("probs"), F.col("n")
    for m in modalities:
        part, alpha = molecules.where(F.col("modality") == m), np.full(len(hyps), 0.5)
        alpha[0] = 1
        if part.isEmpty():
            alpha[1:] = prior[m]
        else:
            for _ in range(500):
                sums = []
                for h in hyps[1:]:
                    cells = [p[s + 1] for s in h.samples]
                    ratio = (p[0] - sum(cells[1:], cells[0]) / len(cells)) / mixture(p, h, F.lit(float(alpha[h.ix])))
                    sums += [F.sum(n * ratio), F.sum(n * ratio * ratio)]
                row = np.array(part.agg(*[s.alias(f"s{k}") for k, s in enumerate(sums)]).first()).reshape(-1, 2)
                a = alpha[1:]
                d1 = weight * prior[m] / a - weight * (1 - prior[m]) / (1 - a) + row[:, 0]
                d2 = -weight * prior[m] / a**2 - weight * (1 - prior[m]) / (1 - a) ** 2 - row[:, 1]
                new = np.clip(a - np.divide(d1, d2, out=np.zeros_like(d1), where=d2 != 0), ALPHA_LOW, ALPHA_HIGH)
                change, alpha[1:] = np.max(np.abs(new - a) / a), new
                if change < eps:
                    break
            llk += np.array(part.agg(*[F.sum(n * F.ln(mixture(p, h, F.lit(float(alpha[h.ix]))))).alias(f"s{h.ix}") for h in hyps]).first())
        llk[1:] += weight * (prior[m] * np.log(alpha[1:]) + (1 - prior[m]) * np.log(1 - alpha[1:]))
        alphas[f"alpha_{m}"] = alpha.tolist()
    return molecules.sparkSession.createDataFrame([{"droplet": droplet, **alphas, "llk": llk.tolist()}], "droplet string, " + "".join(f"alpha_{m} array<double>, " for m in modalities) + "llk array<double>")


def joint(llk: Column, hyps: list[Hypothesis], lam: np.ndarray, pi: np.ndarray) -> list[Column]:
    """log P(hypothesis, data) for each hypothesis."""
    prior = sample_priors(hyps, pi)
    with np.errstate(divide="ignore"):
        return [llk[h.ix] + F.lit(float(np.log(lam[h.h]) + prior[h.ix])) for h in hyps]


def posteriors(fits: DataFrame, hyps: list[Hypothesis], lam: np.ndarray, pi: np.ndarray) -> DataFrame:
    """fits with lp (log joint by hypothesis), lp_x, and pp (posterior by hypothesis)."""
    got = fits.withColumn("lp", F.array(*joint(F.col("llk"), hyps, lam, pi)))
    got = got.withColumn("lp_x", log_sum_exp([F.col("lp")[h.ix] for h in hyps]))
    return got.withColumn("pp", F.transform("lp", lambda x: F.exp(x - F.col("lp_x"))))


def m_step(scored: DataFrame, hyps: list[Hypothesis], n_samples: int, n_ambient: float) -> tuple[np.ndarray, np.ndarray]:
    """New lambda and pi from posteriors; a pseudo-count of 1e-8 for each, ambient droplets as empty."""
    pp = F.col("pp")
    of_h = [F.sum(sum((pp[h.ix] for h in hyps if h.h == k), F.lit(0.0))).alias(f"h{k}") for k in range(3)]
    of_s = [F.sum(sum((pp[h.ix] for h in hyps if s in h.samples), F.lit(0.0))).alias(f"s{s}") for s in range(n_samples)]
    row = scored.agg(*of_h, *of_s).first()
    sums = np.array([x or 0.0 for x in row]) + PSEUDO
    lam, pi = sums[:3] + np.array([n_ambient, 0, 0]), sums[3:]
    return lam / lam.sum(), pi / pi.sum()


def m_step_of(llk: np.ndarray, hyps: list[Hypothesis], lam: np.ndarray, pi: np.ndarray, n_ambient: float) -> tuple[np.ndarray, np.ndarray]:
    """One E- and M-step on a matrix of log likelihoods."""
    with np.errstate(divide="ignore"):
        lp = llk + np.log([lam[h.h] for h in hyps]) + sample_priors(hyps, pi)
    top = lp.max(1, keepdims=True, initial=-np.inf)
    pp = np.exp(lp - top)
    sums = (pp / pp.sum(1, keepdims=True)).sum(0)
    new_lam = np.array([sum(sums[h.ix] for h in hyps if h.h == k) for k in range(3)]) + PSEUDO
    new_pi = np.array([sum(sums[h.ix] for h in hyps if s in h.samples) for s in range(len(pi))]) + PSEUDO
    new_lam[0] += n_ambient
    return new_lam / new_lam.sum(), new_pi / new_pi.sum()


def fit(molecules: DataFrame, n_samples: int, n_ambient: float, n_test: int, modalities: list[str], prior_weight: float = 1e-8, eps: float = 1e-6, max_iter: int = 100, pi_amb: np.ndarray | None = None) -> tuple[DataFrame, Parameters]:
    """Droplets with alphas, llk, lp, lp_x, pp; and the final parameters.

    Posteriors are from the last E-step, the weights one M-step later.
    """
    hyps = hypotheses(n_samples)
    pars = initial(n_samples, n_ambient, n_test, modalities, prior_weight)
    if pi_amb is not None:
        pars.pi_amb = pi_amb
    scratch = Scratch(molecules.sparkSession, "fit")
    molecules = scratch.table(molecules.repartition("droplet"), "molecules")
    starts = None
    for outer in range(max(1, max_iter)):
        fits = scratch.table(fit_alpha(molecules, hyps, modalities, pars.prior, prior_weight, eps, starts=starts), f"fits{outer}")
        starts = fits
        matrix = None
        if n_test * len(hyps) <= DRIVER_CELLS:
            matrix = np.array(fits.orderBy("droplet").select("llk").toPandas()["llk"].tolist()).reshape(-1, len(hyps))
        for _ in range(max(1, max_iter)):
            used = pars.lam, pars.pi
            if matrix is not None:
                lam, pi = m_step_of(matrix, hyps, *used, n_ambient)
            else:
                lam, pi = m_step(posteriors(fits, hyps, *used), hyps, n_samples, n_ambient)
            change = max(np.linalg.norm(lam - pars.lam) / np.linalg.norm(pars.lam), np.linalg.norm(pi - pars.pi) / np.linalg.norm(pars.pi))
            pars.lam, pars.pi = lam, pi
            pars.iterations += 1
            if change < eps:
                break
        singles = [h.ix for h in hyps if h.h == 1]
        scored = posteriors(fits, hyps, *used)
        total = F.sum(sum((F.col("pp")[k] for k in singles), F.lit(0.0)))
        means = [(F.sum(sum((F.col("pp")[k] * F.col(f"alpha_{m}")[k] for k in singles), F.lit(0.0))) / total).alias(m) for m in modalities]
        row = scored.agg(*means).first()
        moved = 0.0
        for m in modalities:
            new = float(np.clip(row[m] if row[m] is not None and np.isfinite(row[m]) else pars.prior[m], 1e-4, 1 - 1e-4))
            moved = max(moved, abs(new - pars.prior[m]) / pars.prior[m])
            pars.prior[m] = new
        if moved < eps:
            break
    return scored, pars
