"""Calls from posteriors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .likelihood import Hypothesis


def best_of(values: Column, ixs: list[int]) -> Column:
    """The first of the indices with the largest value."""
    out = F.lit(ixs[0])
    top = values[ixs[0]]
    for k in ixs[1:]:
        out = F.when(values[k] > top, F.lit(k)).otherwise(out)
        top = F.greatest(top, values[k])
    return out


def decide(scored: DataFrame, hyps: list[Hypothesis]) -> DataFrame:
    """scored with pp0..pp2, best, best_singlet, best_doublet (indices) and best_type.

    A tie for the largest type posterior is Empty.
    """
    pp = F.col("pp")
    of = lambda k: [h.ix for h in hyps if h.h == k]
    got = scored.withColumns({f"pp{k}": sum((pp[i] for i in of(k)), F.lit(0.0)) for k in range(3)})
    got = got.withColumns({"best": best_of(F.col("lp"), [h.ix for h in hyps]), "best_singlet": best_of(F.col("lp"), of(1)), "best_doublet": best_of(F.col("lp"), of(2))})
    return got.withColumn("best_type", call_type(F.col("pp0"), F.col("pp1"), F.col("pp2")))


def call_type(p0: Column, p1: Column, p2: Column) -> Column:
    return F.when((p1 > p0) & (p1 > p2), "Singlet").when((p2 > p0) & (p2 > p1), "Doublet").otherwise("Empty")
