"""Genotypes (VCF), annotations (GTF), intervals (BED), lists and number matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import dosage_from_alleles, dosage_from_probabilities
from ..operators.dictionary import dense_index


def _error_if(df: DataFrame, bad: Column, message: str) -> DataFrame:
    """df; a row for which bad holds makes the query fail."""
    return df.where(F.when(bad, F.raise_error(F.lit(message)).cast("boolean")).otherwise(True))


# Genotypes


def vcf_samples(spark: SparkSession, path: str) -> list[str]:
    head = spark.read.text(path).where(F.col("value").startswith("#CHROM")).first()
    if head is None:
        raise ValueError(f"{path} has no header line")
    return head[0].split("\t")[9:]


def read_vcf(spark: SparkSession, path: str, samples: list[str] | None = None, field: str = "GT", regions: str = ".") -> tuple[DataFrame, DataFrame]:
    """variants (vix, chrom, pos, id, ref, alt, place) and genotypes (vix, sample, alleles, dosage).

    Bi-allelic SNPs only; FILTER is not consulted.  vix counts them from 0 in the
    file's order.  Samples stay in the header's order; one that is listed but not
    there is an error.  A GT with an allele of 2 or more is an error.
    """
    have = vcf_samples(spark, path)
    missing = [s for s in samples or [] if s not in have]
    if missing:
        raise ValueError(f"samples not in the file: {missing}")
    keep = [s for s in have if samples is None or s in samples]
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).withColumn("place", F.monotonically_increasing_id())
    f = F.split("value", "\t")
    rows = rows.select("place", f[0].alias("chrom"), (f[1].cast("int") - 1).alias("pos"), f[2].alias("id"), f[3].alias("ref"), f[4].alias("alt"), f[8].alias("format"), f.alias("f"))
    rows = rows.where((F.length("ref") == 1) & (F.length("alt") == 1) & F.col("alt").rlike("[A-Za-z]"))
    if regions != ".":
        from ..operators.reads import in_regions

        rows = in_regions(rows.withColumn("end", F.col("pos") + 1), regions).drop("end")
    rows = dense_index(rows, ["place"], "vix")
    variants = rows.select("vix", "chrom", "pos", "id", "ref", "alt")
    at = F.array_position(F.split("format", ":"), field).cast("int")
    rows = _error_if(rows, at == 0, f"a variant has no {field}")
    cells = F.array(*[F.struct(F.lit(s).alias("sample"), F.get(F.split(F.col("f")[9 + have.index(s)], ":"), at - 1).alias("value")) for s in keep])
    cells = rows.select("vix", at.alias("at"), F.inline(cells))
    if field == "GP":
        gp = F.transform(F.split("value", ","), lambda x: x.try_cast("double"))
        return variants, cells.select("vix", "sample", F.lit(None).cast("array<int>").alias("alleles"), F.when(F.forall(gp, lambda x: x.isNotNull()), dosage_from_probabilities(gp)).alias("dosage"))
    alleles = F.transform(F.split(F.coalesce("value", F.lit(".")), r"[/|]"), lambda a: a.try_cast("int"))
    got = cells.select("vix", "sample", alleles.alias("alleles"))
    got = _error_if(got, F.exists("alleles", lambda a: a > 1), "a genotype has an allele of 2 or more")
    return variants, got.withColumn("dosage", dosage_from_alleles(F.col("alleles")))


# Annotations


def read_gtf(spark: SparkSession, path: str, basic_only: bool = False) -> DataFrame:
    """Rows of schemas.GTF; start is 0-based.  attrs keeps repeated keys.

    basic_only drops rows, other than genes, that lack the tag ``basic``.
    """
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    f = F.split("value", "\t")
    pairs = F.regexp_extract_all(f[8], F.lit(r'\s*(\S+)\s+("[^"]*"|[^;"]+)\s*;?'), F.lit(0))
    attrs = F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, r"(\S+)\s", 1).alias("key"), F.regexp_replace(F.trim(F.regexp_extract(p, r"\S+\s+(.*?)\s*;?$", 1)), '"', "").alias("value")))
    got = rows.select(f[0].alias("seqname"), f[1].alias("source"), f[2].alias("feature"), (f[3].cast("int") - 1).alias("start"), f[4].cast("int").alias("end"), f[5].alias("score"), f[6].alias("strand"), f[7].alias("frame"), attrs.alias("attrs"))
    if basic_only:
        got = got.where((F.col("feature") == "gene") | has_attribute("tag", "basic"))
    return got


def attribute(key: str) -> Column:
    """The first value of a key."""
    return F.get(F.filter("attrs", lambda a: a["key"] == key), F.lit(0))["value"]


def has_attribute(key: str, value: str) -> Column:
    return F.exists("attrs", lambda a: (a["key"] == key) & (a["value"] == value))


def annotation(gtf: DataFrame) -> tuple[DataFrame, DataFrame]:
    """genes (schemas.GENES and isoforms) and exons (schemas.EXONS), after putting UTRs to exons.

    A gene twice, a transcript without its gene and an exon without its
    transcript are errors.  Touching exons and UTRs of a transcript merge.
    """
    from ..operators.intervals import merge_touching

    genes = gtf.where("feature = 'gene'").select(attribute("gene_id").alias("gene_id"), attribute("gene_name").alias("gene_name"), attribute("gene_type").alias("gene_type"), F.col("seqname").alias("chrom"), "start", "end", "strand")
    twice = genes.groupBy("gene_id").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("gene_id", F.lit("a gene occurs twice").alias("fault"))
    transcripts = gtf.where("feature = 'transcript'").select(attribute("gene_id").alias("gene_id"), attribute("transcript_id").alias("transcript_id"))
    parts = gtf.where("feature in ('exon', 'utr')").select(attribute("gene_id").alias("gene_id"), attribute("transcript_id").alias("transcript_id"), F.col("seqname").alias("chrom"), "start", "end")
    orphan = transcripts.join(genes, "gene_id", "left_anti").select("gene_id", F.lit("a transcript has no gene").alias("fault"))
    lost = parts.join(transcripts, ["gene_id", "transcript_id"], "left_anti").select("gene_id", F.lit("an exon has no transcript").alias("fault"))
    faults = twice.unionByName(orphan).unionByName(lost).limit(1).collect()
    if faults:
        raise ValueError(f"{faults[0]['fault']}: {faults[0]['gene_id']}")
    exons = merge_touching(parts, ["gene_id", "transcript_id", "chrom"]).drop("n")
    isoforms = exons.groupBy("gene_id", "transcript_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("exons")).groupBy("gene_id").agg(F.collect_list("exons").alias("isoforms"))
    genes = dense_index(genes, ["chrom", "start", "end", "gene_id"], "gene_ix").join(isoforms, "gene_id", "left")
    empty = F.array().cast("array<array<struct<start:int,end:int>>>")
    return genes.withColumn("isoforms", F.coalesce("isoforms", empty)), exons


# Intervals, lists, matrices


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """Distinct intervals (ix, chrom, start, end) in order of chrom, start, end."""
    rows = spark.read.text(path).where(~F.col("value").rlike("^(#|track|browser)") & (F.trim("value") != ""))
    f = F.split("value", "\t")
    return dense_index(rows.select(f[0].alias("chrom"), f[1].cast("int").alias("start"), f[2].cast("int").alias("end")).distinct(), ["chrom", "start", "end"])


def read_list(spark: SparkSession, path: str, name: str = "value") -> DataFrame:
    """The file's lines in order (name, place); blank ones are skipped, a repeated one is an error."""
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.trim("value").alias(name), F.monotonically_increasing_id().alias("place"))
    twice = rows.groupBy(name).agg(F.count("*").alias("n")).where("n > 1").first()
    if twice:
        raise ValueError(f"{twice[0]} occurs twice in {path}")
    return rows


def read_matrix(spark: SparkSession, path: str, header: bool = True, sep: str = "\t") -> tuple[list[str], DataFrame]:
    """A matrix of numbers with row names: column names and rows (name, values array<double>).

    A row with another number of values than the first one is an error.  Of a
    folder of parts the first line is that of the first part that has lines.
    """
    lines = spark.read.text(path).where("value <> ''")
    first = next((r for r in (spark.read.text(p).where("value <> ''").first() for p in sorted(lines.inputFiles())) if r), None)
    cells = first[0].split(sep) if first else []
    width = len(cells) - 1
    names = cells[1:] if header else [f"c{k}" for k in range(width)]
    rows = lines.where(F.col("value") != first[0]) if header and first else lines
    f = F.split("value", sep)
    rows = _error_if(rows, F.size(f) != width + 1, "a row has another number of values")
    return names, rows.select(f[0].alias("name"), F.transform(F.slice(f, 2, max(1, width)), lambda x: x.cast("double")).alias("values"))
