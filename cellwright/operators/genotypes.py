"""Genotypes: statistics, filters, dosages and the ambient mean."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import dosage_from_alleles


def variant_stats(genotypes: DataFrame) -> DataFrame:
    """Per variant over allele slots: n_miss, n_alt, n_total (missing slots count in n_total)."""
    slots = genotypes.select("vix", F.explode("alleles").alias("a"))
    missing = F.col("a").isNull() | (F.col("a") < 0)
    return slots.groupBy("vix").agg(F.count_if(missing).alias("n_miss"), F.count_if(F.col("a") > 0).alias("n_alt"), F.count("*").alias("n_total"))


def informative(stats: DataFrame, max_miss: int = 0, maf_cut: float = 0.0) -> DataFrame:
    """Variants with few missing slots whose alternative frequency is inside (maf_cut, 1 - maf_cut)."""
    share = F.col("n_alt") / F.col("n_total")
    return stats.where((F.col("n_miss") <= max_miss) & (share > maf_cut) & (share < 1 - maf_cut))


def biallelic_snps(variants: DataFrame) -> DataFrame:
    return variants.where((F.length("ref") == 1) & (F.length("alt") == 1))


def dosages(genotypes: DataFrame) -> DataFrame:
    """vix, sample, dosage: null if an allele is missing."""
    return genotypes.select("vix", "sample", dosage_from_alleles(F.col("alleles")).alias("dosage"))


def ambient_mean(dosage: DataFrame) -> DataFrame:
    """Per variant the mean of the samples' dosages, -1 if all are missing."""
    return dosage.groupBy("vix").agg(F.coalesce(F.avg("dosage"), F.lit(-1.0)).alias("gamma_amb"))


def gamma_arrays(dosage: DataFrame, samples: list[str]) -> DataFrame:
    """Per variant: gammas, the samples' dosages in order (null: missing)."""
    by = [F.max(F.when(F.col("sample") == s, F.col("dosage"))) for s in samples]
    return dosage.groupBy("vix").agg(F.array(*by).alias("gammas"))


def with_ambient(gammas: DataFrame, pi_amb: list[float] | None = None) -> DataFrame:
    """gammas with the ambient source first: the mean over samples, weighted by pi_amb, at most 1."""
    known = F.filter("gammas", lambda g: g.isNotNull())
    if pi_amb is None:
        mean = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, g: s + g) / F.size(known))
    else:
        weights = F.array(*[F.lit(float(p)) for p in pi_amb])
        pairs = F.zip_with("gammas", weights, lambda g, w: F.struct(g.alias("g"), F.when(g.isNotNull(), w).otherwise(0.0).alias("w")))
        total = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p["w"])
        mean = F.when(total > 0, F.least(F.lit(1.0), F.aggregate(pairs, F.lit(0.0), lambda s, p: s + F.coalesce(p["g"], F.lit(0.0)) * p["w"]) / total))
    return gammas.withColumn("gammas", F.concat(F.array(mean), F.col("gammas")))
