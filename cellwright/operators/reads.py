"""Read filters, CIGAR blocks, bases at variants, and mate pairing.

Alignments follow ``schemas.ALIGNMENTS``.  ``end`` is pos plus the reference
length of the CIGAR.  Filters come in order of cost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import QUERY_OPS, REFERENCE_OPS, allele_call


def with_end(df: DataFrame) -> DataFrame:
    length = F.aggregate(F.filter("cigar", lambda c: c["op"].isin(*REFERENCE_OPS)), F.lit(0), lambda n, c: n + c["len"])
    return df.withColumn("end", F.col("pos") + length)


def filter_reads(df: DataFrame, min_mapq: int = 30, umi: bool = True, max_nh: int = 0) -> DataFrame:
    """Mapped, primary reads of enough quality with a barcode (and UMI) of 4 characters or more.

    A read of one base counts as unmapped.  With max_nh above 0 a read without
    a hit count is an error.
    """
    df = df.where((F.col("end") - F.col("pos") > 1) & (F.col("flag").bitwiseAND(0x900) == 0) & (F.col("mapq") >= min_mapq))
    df = df.where(F.length("cb") >= 4)
    if umi:
        df = df.where(F.length("ub") >= 4)
    if max_nh > 0:
        df = df.where(F.when(F.col("nh").isNull(), F.raise_error(F.lit("a read has no hit count tag"))).otherwise(F.col("nh") <= max_nh))
    return df


def in_regions(df: DataFrame, regions: str) -> DataFrame:
    """Reads that overlap a region string: ``.`` for all, or ``chr``, ``chr:from-to`` (1-based), comma-separated."""
    if regions == ".":
        return df
    any_of = F.lit(False)
    for r in regions.split(","):
        chrom, _, span = r.strip().rpartition(":") if ":" in r else (r.strip(), "", "")
        if not span:
            any_of = any_of | (F.col("chrom") == chrom)
            continue
        first, _, last = span.replace("_", "").partition("-")
        inside = (F.col("chrom") == chrom) & (F.col("end") >= int(first))
        any_of = any_of | (inside & (F.col("pos") < int(last)) if last else inside)
    return df.where(any_of)


def blocks(cigar: Column, pos: Column) -> Column:
    """array<struct<op, len, ref, query>>: where each operation starts in reference and query."""
    zero = F.struct(pos.cast("int").alias("ref"), F.lit(0).alias("query"), F.array().cast("array<struct<op:string,len:int,ref:int,query:int>>").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        move = lambda ops: F.when(c["op"].isin(*ops), c["len"]).otherwise(F.lit(0))
        here = F.struct(c["op"].alias("op"), c["len"].alias("len"), acc["ref"].alias("ref"), acc["query"].alias("query"))
        return F.struct((acc["ref"] + move(REFERENCE_OPS)).alias("ref"), (acc["query"] + move(QUERY_OPS)).alias("query"), F.concat(acc["out"], F.array(here)).alias("out"))

    return F.aggregate(cigar, zero, step, lambda acc: acc["out"])


def bases_at_variants(reads: DataFrame, sites: DataFrame, key: list[str]) -> DataFrame:
    """The base each read shows at each variant position: key, chrom, site, base, qual.

    Only stretches that consume query and reference show bases.  sites: chrom
    and pos of variants, one row a position.
    """
    aligned = F.filter(blocks(F.col("cigar"), F.col("pos")), lambda b: b["op"].isin("M", "=", "X"))
    spread = reads.select(*key, "chrom", "seq", "qual", F.explode(aligned).alias("b"))
    spread = spread.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("b.ref") / 1024), F.floor((F.col("b.ref") + F.col("b.len") - 1) / 1024))))
    at = sites.select(F.col("chrom").alias("__chrom"), F.col("pos").alias("site"), F.floor(F.col("pos") / 1024).alias("__site_bin")).distinct()
    on = (F.col("chrom") == F.col("__chrom")) & (F.col("__bin") == F.col("__site_bin")) & (F.col("site") >= F.col("b.ref")) & (F.col("site") < F.col("b.ref") + F.col("b.len"))
    got = spread.join(at, on)
    offset = F.col("b.query") + F.col("site") - F.col("b.ref")
    return got.select(*key, "chrom", "site", F.expr("substring(seq, b.query + site - b.ref + 1, 1)").alias("base"), F.coalesce(F.get("qual", offset), F.lit(255)).alias("qual"))


def single_sites(variants: DataFrame) -> DataFrame:
    """Variants whose position no other variant shares."""
    alone = F.count("*").over(Window.partitionBy("chrom", "pos")) == 1
    return variants.withColumn("__alone", alone).where("__alone").drop("__alone")


def call_alleles(bases: DataFrame, variants: DataFrame, min_qual: int = 30) -> DataFrame:
    """bases with vix and allele: 0 reference, 1 alternative, 15 other.

    No call for N, for a quality below min_qual (255, missing, passes), and where
    a position has several variants.
    """
    good = bases.where((F.col("base") != "N") & (F.col("qual") >= min_qual))
    known = single_sites(variants).select(F.col("chrom").alias("__chrom"), F.col("pos").alias("__pos"), "vix", "ref", "alt")
    got = good.join(known, (F.col("chrom") == F.col("__chrom")) & (F.col("site") == F.col("__pos")))
    return got.withColumn("allele", allele_call(F.col("base"), F.col("ref"), F.col("alt"))).drop("__chrom", "__pos", "ref", "alt")


def pair_mates(reads: DataFrame, keys: list[str], order: list[str], contig: str, payload: list[str]) -> DataFrame:
    """Pairs of reads of one name: the first and second, the third and fourth, and so on.

    A name's last read stays alone if their number is odd; pairs on two contigs
    are dropped.  Columns <name>1, <name>2 for contig and payload, and pair_no.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    numbered = reads.withColumn("__k", rank).withColumn("pair_no", F.floor(F.col("__k") / 2).cast("long"))
    side = lambda n, c: F.max(F.when(F.col("__k") % 2 == n, F.col(c))).alias(f"{c}{n + 1}")
    paired = numbered.groupBy(*keys, "pair_no").agg(F.count("*").alias("__n"), *[side(n, c) for c in [contig, *payload] for n in (0, 1)])
    return paired.where(f"__n = 2 and {contig}1 = {contig}2").drop("__n")
