"""Hypotheses, molecule likelihoods and their sums per droplet.

Sources are numbered from 0: the ambient pool, then the samples.  Everything
stays wide: a molecule has one probability per source in an array, and a droplet
one sum per hypothesis, so no row is multiplied by sources or hypotheses.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ...functions.columns import base_probability, phred_error


@dataclass(frozen=True)
class Hypothesis:
    """h samples (0 empty, 1 singlet, 2 doublet); s1, s2 from 0, or None."""

    ix: int
    h: int
    s1: int | None = None
    s2: int | None = None

    @property
    def samples(self) -> list[int]:
        return [s for s in (self.s1, self.s2) if s is not None]


def hypotheses(n_samples: int) -> list[Hypothesis]:
    """Empty, each sample, and each unordered pair."""
    if n_samples < 2:
        raise ValueError("the model needs at least two samples")
    out = [Hypothesis(0, 0)] + [Hypothesis(1 + s, 1, s) for s in range(n_samples)]
    for s1, s2 in itertools.combinations(range(n_samples), 2):
        out.append(Hypothesis(len(out), 2, s1, s2))
    return out


def hypothesis_table(samples: DataFrame) -> DataFrame:
    """hs_ix, h, s1, s2 from a table of samples with ix; pairs by ranges of the small index."""
    count = samples.agg(F.count("*").alias("n"))
    none = F.lit(None).cast("int")
    empty = count.select(F.lit(0).alias("h"), none.alias("s1"), none.alias("s2"))
    single = samples.select(F.lit(1).alias("h"), F.col("ix").cast("int").alias("s1"), none.alias("s2"))
    pairs = samples.select(F.col("ix").cast("int").alias("s2")).where("s2 > 0").select(F.lit(2).alias("h"), F.explode(F.sequence(F.lit(0), F.col("s2") - 1)).alias("s1"), "s2")
    every = empty.unionByName(single).unionByName(pairs)
    m = F.count_if(F.col("h") == 1).over(Window.partitionBy(F.lit(0)))
    place = F.when(F.col("h") == 0, 0).when(F.col("h") == 1, 1 + F.col("s1")).otherwise(1 + F.col("m") + F.col("s1") * F.col("m") - F.floor(F.col("s1") * (F.col("s1") + 1) / 2) + F.col("s2") - F.col("s1") - 1)
    return every.withColumn("m", m).select(place.cast("long").alias("hs_ix"), "h", "s1", "s2")


def observation_probabilities(observations: DataFrame, gammas: DataFrame) -> DataFrame:
    """observations (vix, allele, qual) with probs: P(base | source) for each source."""
    tau = phred_error(F.col("qual"))
    probs = F.transform("gammas", lambda g: base_probability(g, F.col("allele"), F.col("tau")))
    return observations.withColumn("tau", tau).join(gammas, "vix").withColumn("probs", probs).drop("gammas", "tau")


def molecule_probabilities(observed: DataFrame, keys: list[str], n_sources: int) -> DataFrame:
    """Per molecule: probs, the products over its variants (one observation a variant)."""
    logs = [F.exp(F.sum(F.ln(F.col("probs")[t]))) for t in range(n_sources)]
    return observed.groupBy(*keys).agg(F.array(*logs).alias("probs"))


def cell_mean(probs: Column, hypothesis: Hypothesis) -> Column:
    """The mean over the hypothesis' samples of P(molecule | sample)."""
    parts = [probs[s + 1] for s in hypothesis.samples]
    return parts[0] if len(parts) == 1 else (parts[0] + parts[1]) / 2


def mixture(probs: Column, hypothesis: Hypothesis, alpha: Column) -> Column:
    """P(molecule | hypothesis): ambient with probability alpha, else one of the cells' samples."""
    if hypothesis.h == 0:
        return probs[0]
    return alpha * probs[0] + (1 - alpha) * cell_mean(probs, hypothesis)


def log_likelihoods(molecules: DataFrame, key: str, hyps: list[Hypothesis], alpha: float | Column, n: Column | None = None) -> DataFrame:
    """Per droplet: llk, an array over hypotheses of sum(n * ln P(molecule | hypothesis))."""
    a = F.lit(alpha) if isinstance(alpha, float) else alpha
    times = F.lit(1) if n is None else n
    return molecules.groupBy(key).agg(F.array(*[F.sum(times * F.ln(mixture(F.col("probs"), h, a))) for h in hyps]).alias("llk"))


def derivatives(molecules: DataFrame, key: str, hyps: list[Hypothesis], alpha, n: Column | None = None) -> DataFrame:
    """Per droplet: d1 and d2, arrays over hypotheses of the sums of n x / psi and -n (x / psi)**2.

    x = P(molecule | ambient) - mean over cells; alpha: a number or a function of
    the hypothesis.  The empty hypothesis has 0.
    """
    times = F.lit(1) if n is None else n
    of = alpha if callable(alpha) else lambda h: F.lit(float(alpha))
    first, second = [], []
    for h in hyps:
        if h.h == 0:
            first.append(F.lit(0.0))
            second.append(F.lit(0.0))
            continue
        ratio = (F.col("probs")[0] - cell_mean(F.col("probs"), h)) / mixture(F.col("probs"), h, of(h))
        first.append(F.sum(times * ratio))
        second.append(F.sum(-times * ratio * ratio))
    return molecules.groupBy(key).agg(F.array(*first).alias("d1"), F.array(*second).alias("d2"))


def ambient_information(observations: DataFrame, gammas: DataFrame, molecule: list[str], droplet: str) -> DataFrame:
    """Per droplet the sum over molecules of the mean over variants of mean |gamma_s - gamma_amb|.

    Missing dosages add 0; other alleles add 0 but count as variants.
    """
    distance = F.aggregate(F.slice("gammas", F.lit(2), F.size("gammas") - 1), F.lit(0.0), lambda s, g: s + F.coalesce(F.abs(g - F.col("gammas")[0]), F.lit(0.0))) / (F.size("gammas") - 1)
    each = observations.join(gammas.select("vix", distance.alias("distance")), "vix").withColumn("distance", F.when(F.col("allele") > 1, 0.0).otherwise(F.coalesce("distance", F.lit(0.0))))
    per = each.groupBy(*molecule).agg(F.avg("distance").alias("info"))
    return per.groupBy(droplet).agg(F.sum("info").alias("info"))
