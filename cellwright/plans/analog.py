"""The engine's inputs as projections of the driver's tables.

Reads come from lineitem, intervals from events, genotypes from region and part
sizes.  Each projection has its SQL beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

N_SAMPLES = 5
OUT_MIN = 300


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def reads(spark: SparkSession, sf: str) -> DataFrame:
    """Reads: barcode, umi, feature, quality, allele code, splice class."""
    allele = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(15)
    splice = F.when(F.col("l_discount") == 0, 2).when(F.col("l_linestatus") == "O", 0).otherwise(1)
    return _table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("bc"), (F.col("l_orderkey") % 200).alias("umi"), (F.col("l_partkey") % 5).alias("feat"), F.col("l_quantity").cast("int").alias("qual"),
        allele.alias("allele"), splice.alias("splice"), (1 + F.col("l_partkey") % 50).alias("vix"), F.when(F.col("l_linestatus") == "O", "rna").otherwise("atac").alias("modality"), F.when(F.col("l_tax") == 0, 255).otherwise(F.col("l_quantity").cast("int")).alias("qual255"),
    )


READS = """reads AS (SELECT l_suppkey AS bc, l_orderkey % 200 AS umi, l_partkey % 5 AS feat, CAST(l_quantity AS INTEGER) AS qual,
 CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 15 END AS allele,
 CASE WHEN l_discount = 0 THEN 2 WHEN l_linestatus = 'O' THEN 0 ELSE 1 END AS splice, 1 + l_partkey % 50 AS vix,
 CASE WHEN l_linestatus = 'O' THEN 'rna' ELSE 'atac' END AS modality,
 CASE WHEN l_tax = 0 THEN 255 ELSE CAST(l_quantity AS INTEGER) END AS qual255 FROM lineitem)"""


def alignments(spark: SparkSession, sf: str) -> DataFrame:
    """Rows like alignments, for the read filters."""
    li = _table(spark, sf, "lineitem")
    flag = F.when(F.col("l_linenumber") % 4 == 0, 256).otherwise(0) + F.when(F.col("l_orderkey") % 50 == 0, 2048).otherwise(0)
    tag = lambda c: F.concat(F.lit("B"), c.cast("string"))
    return li.select(
        F.col("l_partkey").cast("int").alias("pos"), (F.col("l_partkey") + F.col("l_linenumber")).cast("int").alias("end"), flag.alias("flag"), F.col("l_quantity").cast("int").alias("mapq"),
        tag(F.col("l_suppkey") + 95).alias("cb"), F.when(F.col("l_orderkey") % 10 > 0, tag(F.col("l_orderkey"))).alias("ub"), F.col("l_linenumber").alias("nh"),
    )


ALIGNMENTS = """alignments AS (SELECT CAST(l_partkey AS INTEGER) AS pos, CAST(l_partkey + l_linenumber AS INTEGER) AS "end",
 (CASE WHEN l_linenumber % 4 = 0 THEN 256 ELSE 0 END) + (CASE WHEN l_orderkey % 50 = 0 THEN 2048 ELSE 0 END) AS flag,
 CAST(l_quantity AS INTEGER) AS mapq, 'B' || CAST(l_suppkey + 95 AS VARCHAR) AS cb,
 CASE WHEN l_orderkey % 10 > 0 THEN 'B' || CAST(l_orderkey AS VARCHAR) END AS ub, l_linenumber AS nh FROM lineitem)"""


def intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals: id, chrom, start, end, strand."""
    start = F.unix_timestamp(F.col("ts").cast("timestamp"))
    strand = F.when(F.col("event_type") == "click", "+").when(F.col("event_type") == "view", "-").otherwise(".")
    got = _table(spark, sf, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 25).alias("chrom"), start.alias("start"), strand.alias("strand"), "event_type", "user_id", "value")
    return got.withColumn("end", F.col("start") + 60 + F.floor("value"))


def peaks(spark: SparkSession, sf: str) -> DataFrame:
    return intervals(spark, sf).where("event_type = 'signup'").select("id", "chrom", (F.col("start") - 1800).alias("start"), (F.col("end") + 1800).alias("end"), "strand")


INTERVALS = """intervals AS (SELECT event_id AS id, user_id % 25 AS chrom, CAST(floor(epoch(ts)) AS BIGINT) AS s,
 CAST(floor(epoch(ts)) AS BIGINT) + 60 + CAST(floor(value) AS BIGINT) AS e,
 CASE event_type WHEN 'click' THEN '+' WHEN 'view' THEN '-' ELSE '.' END AS strand, event_type, user_id, value FROM events),
peaks AS (SELECT id, chrom, s - 1800 AS s, e + 1800 AS e, strand FROM intervals WHERE event_type = 'signup')"""


def genotypes(spark: SparkSession, sf: str) -> DataFrame:
    """vix (a part size), sample (a region key), alleles; some missing."""
    code = (7 * F.col("sample") + 3 * F.col("vix")) % 3
    alleles = F.when((F.col("vix") + F.col("sample")) % 11 == 0, F.array(F.lit(None).cast("int"), F.lit(None).cast("int"))).otherwise(F.array(F.when(code == 2, 1).otherwise(0), F.when(code >= 1, 1).otherwise(0)))
    sizes = _table(spark, sf, "part").select(F.col("p_size").cast("long").alias("vix")).distinct()
    cells = sizes.withColumn("sample", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(N_SAMPLES - 1).cast("long"))))
    known = _table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("sample"))
    cells = cells.join(known, "sample", "left_semi")
    return cells.select("vix", "sample", alleles.alias("alleles"))


GENOTYPES = """dosages AS (SELECT CAST(p.vix AS BIGINT) AS vix, CAST(r.r_regionkey AS BIGINT) AS sample,
 CASE WHEN (p.vix + r.r_regionkey) % 11 = 0 THEN NULL ELSE ((7 * r.r_regionkey + 3 * p.vix) % 3) / 2.0 END::DOUBLE AS dosage
 FROM region r, (SELECT DISTINCT p_size AS vix FROM part) p)"""


def observations(spark: SparkSession, sf: str) -> DataFrame:
    """One observation per molecule (bc, umi, modality) and variant: the least (allele, qual)."""
    code = F.when(F.col("allele") == 15, 2).otherwise(F.col("allele"))
    got = reads(spark, sf).groupBy("bc", "umi", "modality", "vix").agg(F.min(F.struct(code.alias("allele"), "qual")).alias("o"))
    return got.select("bc", "umi", "modality", "vix", "o.allele", "o.qual")


OBSERVATIONS = READS + """,
observations AS (SELECT bc, umi, modality, vix, CASE WHEN allele = 15 THEN 2 ELSE allele END AS allele, qual FROM
 (SELECT *, row_number() OVER (PARTITION BY bc, umi, modality, vix ORDER BY CASE WHEN allele = 15 THEN 2 ELSE allele END, qual) AS k FROM reads) WHERE k = 1)"""


#: Columns that name a read of aligned().
READ_KEY = ["o", "l", "p", "s"]


def aligned(spark: SparkSession, sf: str) -> DataFrame:
    """Reads with CIGAR, bases and qualities, placed on the gene of their supplier; one for each READ_KEY."""
    key = [F.col(c).alias(k) for c, k in zip(("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), READ_KEY, strict=True)]
    least = [F.min(F.col(c).cast(t)).alias(k) for c, t, k in (("l_quantity", "int", "q"), ("l_returnflag", "string", "flag"), ("l_linestatus", "string", "status"), ("l_tax", "double", "tax"), ("l_discount", "double", "discount"))]
    rows = _table(spark, sf, "lineitem").groupBy(*key).agg(*least)
    op = lambda name, length: F.struct(F.lit(name).alias("op"), length.cast("int").alias("len"))
    o, n, s, q = F.col("o"), F.col("l"), F.col("s"), F.col("q")
    middle = F.when(F.col("flag") == "R", op("N", 10 + s % 7)).when(F.col("flag") == "A", op("D", F.lit(2))).otherwise(op("I", F.lit(3)))
    slots = F.array(F.when(n % 3 == 0, op("S", n)), op("M", 31 - n - F.when(q % 3 == 0, 1).otherwise(0)), middle, op("=", 5 + q % 20), F.when(F.col("tax") == 0, op("X", F.lit(1))))
    rows = rows.withColumn("cigar", F.filter(slots, lambda c: c.isNotNull()))
    length = F.aggregate(F.filter("cigar", lambda c: c["op"].isin("M", "I", "S", "=", "X")), F.lit(0), lambda a, c: a + c["len"])
    rows = rows.withColumn("n_bases", length)
    qual = F.when(F.col("discount") > 0, F.transform(F.sequence(F.lit(0), F.col("n_bases") - 1), lambda k: ((k * 7 + s) % 42).cast("int")))
    seq = F.substr(F.lit("ACGTN" * 30), (1 + F.col("p") % 5).cast("int"), F.col("n_bases"))
    strand = F.when(F.col("status") == "O", "+").otherwise("-")
    return rows.select(*READ_KEY, (s % 3).cast("string").alias("chrom"), (s * 53 + n - 1).cast("int").alias("pos"), strand.alias("strand"), "cigar", seq.alias("seq"), qual.alias("qual"), (o % 200).alias("umi"))


_PLACED = """base AS (SELECT l_orderkey AS o, l_linenumber AS l, l_partkey AS p, l_suppkey AS s, min(CAST(l_quantity AS INTEGER)) AS q, min(l_returnflag) AS flag,
 min(l_linestatus) AS status, min(l_tax) AS tax, min(l_discount) AS discount FROM lineitem GROUP BY ALL),
ops AS (SELECT *, s * 53 + l - 1 AS pos, unnest([1, 2, 3, 4, 5]) AS k, unnest(['S', 'M', CASE flag WHEN 'R' THEN 'N' WHEN 'A' THEN 'D' ELSE 'I' END, '=', 'X']) AS op,
 unnest([CASE WHEN l % 3 = 0 THEN l END, 31 - l - CASE WHEN q % 3 = 0 THEN 1 ELSE 0 END, CASE flag WHEN 'R' THEN 10 + s % 7 WHEN 'A' THEN 2 ELSE 3 END, 5 + q % 20, CASE WHEN tax = 0 THEN 1 END]) AS len FROM base)"""
#: Operations of aligned() with the bases of reference (r) and query (u) they consume, and where they start.
BLOCKS = _PLACED + """,
sized AS (SELECT *, CASE WHEN op = 'I' OR op = 'S' THEN 0 ELSE len END AS r, CASE WHEN op = 'D' OR op = 'N' THEN 0 ELSE len END AS u FROM ops WHERE len IS NOT NULL),
blocks AS (SELECT *, pos + coalesce(sum(r) OVER w, 0) AS ref, coalesce(sum(u) OVER w, 0) AS query FROM sized WINDOW w AS (PARTITION BY o, l, p, s ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def genes(spark: SparkSession, sf: str) -> DataFrame:
    """A gene for each supplier, with one to three isoforms."""
    s = F.col("s_suppkey")
    exon = lambda a, b: F.struct((s * 53 + a).cast("int").alias("start"), (s * 53 + b).cast("int").alias("end"))
    isoforms = F.array(F.array(exon(0, 30), exon(40 + s % 7, 100)), F.when(s % 2 == 0, F.array(exon(0, 90))), F.when(s % 3 == 0, F.array(exon(0, 40), exon(60, 120))))
    strand = F.when(s % 5 < 3, "+").when(s % 5 == 3, "-").otherwise(".")
    return _table(spark, sf, "supplier").select(
        s.alias("gene_ix"), (s % 3).cast("string").alias("chrom"), (s * 53).cast("int").alias("start"), (s * 53 + 120).cast("int").alias("end"), strand.alias("strand"),
        F.filter(isoforms, lambda e: e.isNotNull()).alias("isoforms"),
    )


GENES = """genes AS (SELECT s_suppkey AS gene_ix, s_suppkey % 3 AS chrom, s_suppkey * 53 AS a, s_suppkey * 53 + 120 AS b,
 CASE WHEN s_suppkey % 5 < 3 THEN '+' WHEN s_suppkey % 5 = 3 THEN '-' ELSE '.' END AS strand FROM supplier),
exons AS (SELECT s_suppkey AS gene_ix, 1 AS iso, s_suppkey * 53 AS a, s_suppkey * 53 + 30 AS b FROM supplier
 UNION ALL SELECT s_suppkey, 1, s_suppkey * 53 + 40 + s_suppkey % 7, s_suppkey * 53 + 100 FROM supplier
 UNION ALL SELECT s_suppkey, 2, s_suppkey * 53, s_suppkey * 53 + 90 FROM supplier WHERE s_suppkey % 2 = 0
 UNION ALL SELECT s_suppkey, 3, s_suppkey * 53, s_suppkey * 53 + 40 FROM supplier WHERE s_suppkey % 3 = 0
 UNION ALL SELECT s_suppkey, 3, s_suppkey * 53 + 60, s_suppkey * 53 + 120 FROM supplier WHERE s_suppkey % 3 = 0)"""


def molecules(spark: SparkSession, sf: str) -> DataFrame:
    """RNA reads with genes and the bases at two sites (none for some)."""
    site = (F.col("l_partkey") % 5).cast("int")
    base = lambda k: F.struct((site + k).alias("site"), F.when(F.col("l_returnflag") == "R", "A").otherwise("G").alias("base"), F.when((F.col("l_linenumber") + k) % 2 == 0, 255).otherwise(F.col("l_quantity").cast("int") + k).alias("qual"))
    none = F.array().cast("array<struct<site:int,base:string,qual:int>>")
    splice = F.when(F.col("l_linestatus") == "O", 0).otherwise(1)
    return _table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("barcode"), (F.col("l_orderkey") % 200).alias("umi"), (F.col("l_partkey") % 3).cast("string").alias("chrom"), site.alias("pos"), (site + 50).alias("end"), F.lit("+").alias("strand"),
        F.array(F.struct((F.col("l_partkey") % 5).alias("gene_ix"), splice.alias("splice"))).alias("genes"), F.when(F.col("l_linenumber") == 4, none).otherwise(F.array(base(1), base(2))).alias("bases"),
    )


def mates(spark: SparkSession, sf: str) -> DataFrame:
    """Mate pairs whose reads share a site, at which they may disagree."""
    start = (F.col("l_partkey") % 50).cast("int")
    base = lambda k, letter, qual: F.struct((start + k).alias("site"), letter.alias("base"), qual.alias("qual"))
    own = F.when(F.col("l_returnflag") == "R", "A").otherwise("G")
    other = F.when(F.col("l_linestatus") == "O", "A").otherwise("T")
    q = F.col("l_quantity").cast("int")
    return _table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("barcode"), (F.col("l_partkey") % 3).cast("string").alias("chrom"), start.alias("start1"), (start + 10).alias("end1"), (start + 5).alias("start2"), (start + 20 + F.col("l_linenumber") % 2).alias("end2"),
        F.array(base(6, own, q)).alias("bases1"), F.array(base(6, other, q + 1), base(12, other, F.when(F.col("l_tax") == 0, 255).otherwise(q))).alias("bases2"),
    )


def bounded_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals of very different lengths: id, chrom, start, end."""
    return intervals(spark, sf).select("id", "chrom", "start", (F.col("end") + F.when(F.col("event_type") == "error", 3_000_000).otherwise(0)).alias("end"))
