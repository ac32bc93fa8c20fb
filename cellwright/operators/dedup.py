"""Deduplication: the unique most-supported reading, or none.

Within a group (barcode and UMI, or barcode and fragment coordinates) equal
readings are counted.  The reading with the strictly highest count stays; if
several share it, the group is dropped.  Two aggregations on nested keys do it:
the second one's keys are a prefix of the first one's, so one shuffle by the
group serves both, and only counts and one reading a group are kept in memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import best_quality


def count_readings(df: DataFrame, keys: list[str], signature: list[str], qual: str | None = None) -> DataFrame:
    """keys, signature, n, and the best quality of equal readings."""
    more = [best_quality(F.col(qual)).cast("int").alias(qual)] if qual else []
    return df.groupBy(*keys, *signature).agg(F.count("*").alias("n"), *more)


def unique_mode(counted: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """The reading of each group with the highest n, where no other has as many: keys, payload, n.

    A count is kept with how many readings have it; max() of such pairs by count
    would lose ties, so ties are counted per (group, n) first.
    """
    tied = counted.groupBy(*keys, "n").agg(F.count("*").alias("__ties"), F.min(F.struct(*payload)).alias("__best"))
    best = tied.groupBy(*keys).agg(F.max(F.struct("n", "__ties", "__best")).alias("__top"))
    return best.where("__top.__ties = 1").select(*keys, "__top.__best.*", F.col("__top.n").alias("n"))


def unique_mode_of(df: DataFrame, keys: list[str], signature: list[str], qual: str | None = None) -> DataFrame:
    """count_readings, then unique_mode."""
    return unique_mode(count_readings(df, keys, signature, qual), keys, [*signature, *([qual] if qual else [])])


def rna_molecules(reads: DataFrame) -> DataFrame:
    """Molecules from reads with barcode, umi, chrom, pos, end, strand, bases and genes.

    bases: array<struct<site, base, qual>> in order of site; genes:
    array<struct<gene_ix, splice>> in order.  Reads are equal if all but the
    qualities agree; their qualities merge to the best at each site.
    """
    signature = ["chrom", "pos", "end", "strand", "genes", "letters"]
    reads = reads.withColumns({"letters": F.transform("bases", lambda b: F.struct(b["site"], b["base"])), "quals": F.transform("bases", lambda b: F.nullif(b["qual"], F.lit(255)))})
    return _modes(reads, ["barcode", "umi"], signature)


def atac_fragments(pairs: DataFrame) -> DataFrame:
    """Fragments from mate pairs with barcode, chrom, start1, end1, start2, end2 and both mates' bases.

    The mates' bases are put together by site, the first mate's first.
    """
    first = F.transform("bases1", lambda b: b["site"])
    pairs = pairs.withColumn("bases", F.array_sort(F.concat("bases1", F.filter("bases2", lambda b: ~F.array_contains(first, b["site"])))))
    letters = lambda c: F.transform(c, lambda b: F.struct(b["site"], b["base"]))
    pairs = pairs.withColumns({"letters1": letters("bases1"), "letters2": letters("bases2"), "letters": letters("bases"), "quals": F.transform("bases", lambda b: F.nullif(b["qual"], F.lit(255)))})
    return _modes(pairs, ["barcode", "chrom", "start1", "end1", "start2", "end2"], ["letters1", "letters2", "letters"]).drop("letters1", "letters2")


def _modes(df: DataFrame, keys: list[str], signature: list[str]) -> DataFrame:
    """Unique modes; ``bases`` again has the best quality of equal readings at each site."""
    spread = df.select(*keys, *signature, F.posexplode_outer("quals").alias("__k", "__q"))
    per_site = spread.groupBy(*keys, *signature, "__k").agg(F.count("*").alias("n"), F.max("__q").alias("__q"))
    counted = per_site.groupBy(*keys, *signature).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct(F.coalesce("__k", F.lit(0)).alias("k"), F.coalesce("__q", F.lit(255)).alias("q")))).alias("__quals"))
    got = unique_mode(counted, keys, [*signature, "__quals"])
    bases = F.zip_with("letters", F.slice("__quals", F.lit(1), F.size("letters")), lambda b, q: F.struct(b["site"].alias("site"), b["base"].alias("base"), q["q"].alias("qual")))
    return got.withColumn("bases", bases).drop("letters", "__quals")
