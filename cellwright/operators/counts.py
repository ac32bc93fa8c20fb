"""Sparse counts by barcode, and per-barcode statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gene_counts(molecules: DataFrame) -> DataFrame:
    """barcode, gene_ix, spl, uns, amb from molecules with exactly one gene (genes: array of structs)."""
    one = molecules.where(F.size("genes") == 1).select("barcode", F.col("genes")[0]["gene_ix"].alias("gene_ix"), F.col("genes")[0]["splice"].alias("splice"))
    return splice_counts(one, ["barcode", "gene_ix"])


def splice_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.count_if(F.col("splice") == k).alias(n) for k, n in enumerate(("spl", "uns", "amb"))])


def allele_counts(calls: DataFrame, keys: list[str]) -> DataFrame:
    """keys with the number of reference, alternative and other alleles."""
    return calls.groupBy(*keys).agg(F.count_if(F.col("allele") == 0).alias("ref"), F.count_if(F.col("allele") == 1).alias("alt"), F.count_if(F.col("allele") > 1).alias("oth"))


def peak_counts(hits: DataFrame, keys: list[str]) -> DataFrame:
    """keys with the number of cut sites (n): one row a hit."""
    return hits.groupBy(*keys).agg(F.count("*").alias("n"))


def triplets(counts: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """matrix, row_ix, col_ix (from 1), n: every matrix has all cells of any, explicit zeros too."""
    cells = F.array(*[F.struct(F.lit(v).alias("matrix"), F.col(v).alias("n")) for v in values])
    return counts.select((F.col(row) + 1).alias("row_ix"), (F.col(column) + 1).alias("col_ix"), F.inline(cells)).select("matrix", "row_ix", "col_ix", "n")


def modality_stats(df: DataFrame, prefix: str, feature: str, variant: str, mito: str, hit: str) -> DataFrame:
    """Per barcode: molecules, distinct features and variants, share of mitochondrial ones and of ones with a feature."""
    return df.groupBy("barcode").agg(
        F.count("*").alias(f"n_{prefix}"),
        F.count_distinct(feature).alias(f"n_{prefix}_features"),
        F.count_distinct(variant).alias(f"n_{prefix}_variants"),
        F.avg(F.col(mito).cast("double")).alias(f"{prefix}_mt"),
        F.avg(F.col(hit).cast("double")).alias(f"{prefix}_in_features"),
    )


def barcode_stats(rna: DataFrame, atac: DataFrame) -> DataFrame:
    """Both modalities; a barcode that one lacks has zeros there."""
    both = rna.join(atac, "barcode", "full_outer")
    return both.na.fill(0)


def low_count_rollup(counts: DataFrame, out_min: int, rna: str = "rna", atac: str = "atac") -> DataFrame:
    """counts with droplet: the barcode, or ``Empty`` where both counts are below out_min."""
    low = (F.col(rna) < out_min) & (F.col(atac) < out_min)
    return counts.withColumn("droplet", F.when(low, F.lit("Empty")).otherwise(F.col("barcode").cast("string")))


def droplets(rolled: DataFrame, rna: str = "rna", atac: str = "atac") -> DataFrame:
    """Per droplet: n_bc (for Empty one more than barcodes merged), summed counts, is_ambient."""
    empty = F.col("droplet") == "Empty"
    return rolled.groupBy("droplet").agg(F.count("*").alias("n"), F.sum(rna).alias(rna), F.sum(atac).alias(atac)).select("droplet", (F.col("n") + F.when(empty, 1).otherwise(0)).alias("n_bc"), rna, atac, empty.alias("is_ambient"))


def nth_count(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n-th largest (from 0) number of rows of a key, as one row; none if there are fewer keys."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).offset(n).limit(1).select("n")
