"""The registry of the engine's queries and of their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import counts, dedup, genotypes, intervals, reads, splice
from ..operators.dictionary import dense_index, union_in_order
from ..operators.model import ambient, decide, em, likelihood
from . import analog as A

QUERIES: dict = {}
SQL: dict[str, str] = {}

HYPS = likelihood.hypotheses(A.N_SAMPLES)


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


def _round(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), places) + F.lit(0.0) for n in names})


# Filters, genotypes, dictionaries


@query(f"""WITH {A.ALIGNMENTS} SELECT pos, "end", flag, mapq, cb, ub, nh FROM alignments
WHERE "end" - pos > 1 AND flag & 2304 = 0 AND mapq >= 30 AND length(cb) >= 4 AND length(ub) >= 4 AND nh <= 5""")
def filter_reads(spark: SparkSession, sf: str) -> DataFrame:
    return reads.filter_reads(A.alignments(spark, sf), min_mapq=30, umi=True, max_nh=5)


@query(f"""WITH {A.GENOTYPES} SELECT vix, CAST(2 * count(*) FILTER (dosage IS NULL) AS BIGINT) AS n_miss, CAST(coalesce(sum(2 * dosage), 0) AS BIGINT) AS n_alt,
CAST(2 * count(*) AS BIGINT) AS n_total, CAST(row_number() OVER (ORDER BY vix) - 1 AS BIGINT) AS new_vix FROM dosages GROUP BY vix
HAVING count(*) FILTER (dosage IS NULL) = 0 AND sum(dosage) > 0 AND sum(2 * dosage) < 2 * count(*)""")
def variant_filter_missing_maf(spark: SparkSession, sf: str) -> DataFrame:
    return dense_index(genotypes.informative(genotypes.variant_stats(A.genotypes(spark, sf))), ["vix"], "new_vix")


@query(f"WITH {A.GENOTYPES} SELECT vix, sample, dosage FROM dosages")
def genotype_dosage(spark: SparkSession, sf: str) -> DataFrame:
    return genotypes.dosages(A.genotypes(spark, sf))


@query(f"WITH {A.GENOTYPES} SELECT vix, round(coalesce(avg(dosage), -1.0), 6) AS gamma_amb FROM dosages GROUP BY vix")
def gamma_ambient_mean(spark: SparkSession, sf: str) -> DataFrame:
    return _round(genotypes.ambient_mean(genotypes.dosages(A.genotypes(spark, sf))), "gamma_amb")


@query(f"WITH {A.READS} SELECT bc, CAST(row_number() OVER (ORDER BY bc) - 1 AS BIGINT) AS ix FROM (SELECT DISTINCT bc FROM reads)")
def dictionary_encode_barcodes(spark: SparkSession, sf: str) -> DataFrame:
    return dense_index(A.reads(spark, sf).select("bc").distinct(), ["bc"])


@query(f"""WITH {A.READS}, listed AS (SELECT s_suppkey AS bc, s_suppkey AS place FROM supplier WHERE s_acctbal > 5000),
rest AS (SELECT DISTINCT bc FROM reads WHERE splice = 2 AND bc NOT IN (SELECT bc FROM listed))
SELECT bc, CAST(row_number() OVER (ORDER BY source, place, bc) - 1 AS BIGINT) AS ix FROM
(SELECT bc, 0 AS source, place FROM listed UNION ALL SELECT bc, 1, 0 FROM rest)""")
def whitelist_union_barcodes(spark: SparkSession, sf: str) -> DataFrame:
    listed = spark.read.parquet(f"{sf}/supplier.parquet").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("bc"), F.col("s_suppkey").alias("place"))
    return union_in_order(listed, A.reads(spark, sf).where("splice = 2"), "bc", "place")


# Reads: CIGAR, bases at variants, splice classes, molecules and fragments


@query(f"WITH {A.BLOCKS} SELECT o, l, p, s, op, CAST(len AS INTEGER) AS len, CAST(ref AS INTEGER) AS ref, CAST(query AS INTEGER) AS query FROM blocks")
def cigar_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Where each CIGAR operation of each read starts in reference and query."""
    got = A.aligned(spark, sf).select(*A.READ_KEY, F.explode(reads.blocks(F.col("cigar"), F.col("pos"))).alias("b"))
    return got.select(*A.READ_KEY, "b.*")


@query(f"""WITH {A.BLOCKS} SELECT o, l, p, s, CAST(pos AS INTEGER) AS pos, CAST(pos + sum(r) AS INTEGER) AS "end" FROM blocks GROUP BY o, l, p, s, pos
HAVING (s % 3 = 1 AND pos + sum(r) >= 200 AND pos < 4000) OR s % 3 = 2""")
def region_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Reads that overlap a region string."""
    return reads.in_regions(reads.with_end(A.aligned(spark, sf)), "1:200-4_000,2").select(*A.READ_KEY, "pos", "end")


@query(f"""WITH {A.BLOCKS}, sites AS (SELECT DISTINCT p_size % 3 AS chrom, p_partkey * 3 AS site FROM part)
SELECT o, l, p, s, site, substr(repeat('ACGTN', 30), CAST(1 + p % 5 + query + site - ref AS BIGINT), 1) AS base,
CAST(CASE WHEN discount > 0 THEN ((query + site - ref) * 7 + s) % 42 ELSE 255 END AS INTEGER) AS qual
FROM blocks b JOIN sites v ON b.s % 3 = v.chrom AND site >= ref AND site < ref + len WHERE op IN ('M', '=', 'X')""")
def bases_at_variants(spark: SparkSession, sf: str) -> DataFrame:
    """The base and quality each read shows at each variant position."""
    sites = spark.read.parquet(f"{sf}/part.parquet").select((F.col("p_size") % 3).cast("string").alias("chrom"), (F.col("p_partkey") * 3).cast("int").alias("pos"))
    return reads.bases_at_variants(A.aligned(spark, sf), sites, A.READ_KEY).select(*A.READ_KEY, "site", "base", F.col("qual").cast("int").alias("qual"))


@query(f"""WITH {A.BLOCKS}, {A.GENES}, spans AS (SELECT o, l, p, s, CASE status WHEN 'O' THEN '+' ELSE '-' END AS strand, pos, pos + sum(r) AS e, sum(len) AS n FROM blocks GROUP BY o, l, p, s, status, pos),
hits AS (SELECT x.o, x.l, x.p, x.s, x.n, g.gene_ix FROM spans x JOIN genes g ON x.s % 3 = g.chrom AND g.a <= pos AND e <= g.b AND (g.strand = '.' OR g.strand = x.strand)),
introns AS (SELECT gene_ix, iso, lag(b) OVER w AS a, a AS b FROM exons WINDOW w AS (PARTITION BY gene_ix, iso ORDER BY a)),
extent AS (SELECT gene_ix, iso, min(a) AS a, max(b) AS b FROM exons GROUP BY ALL),
inside AS (SELECT h.o, h.l, h.p, h.s, h.gene_ix, x.iso, sum(greatest(0, least(k.ref + k.r, x.b) - greatest(k.ref, x.a))) = any_value(h.n) AS whole FROM hits h
 JOIN blocks k ON h.o = k.o AND h.l = k.l AND h.p = k.p AND h.s = k.s JOIN extent x ON x.gene_ix = h.gene_ix GROUP BY ALL),
crossed AS (SELECT h.o, h.l, h.p, h.s, h.gene_ix, i.iso, bool_or(k.op = 'N' AND k.ref = i.a AND k.ref + k.len = i.b) AS junction, bool_or(least(k.ref + k.r, i.b) > greatest(k.ref, i.a)) AS intronic FROM hits h
 JOIN blocks k ON h.o = k.o AND h.l = k.l AND h.p = k.p AND h.s = k.s JOIN introns i ON i.gene_ix = h.gene_ix AND i.a IS NOT NULL GROUP BY ALL),
each AS (SELECT n.*, coalesce(junction, false) AS junction, coalesce(intronic, false) AS intronic FROM inside n LEFT JOIN crossed USING (o, l, p, s, gene_ix, iso))
SELECT o, l, p, s, gene_ix, CAST(CASE WHEN bool_or(whole AND junction) THEN 0 WHEN bool_or(whole) AND bool_and(intronic OR NOT whole) THEN 1 ELSE 2 END AS INTEGER) AS splice
FROM each GROUP BY o, l, p, s, gene_ix""")
def splice_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Genes that contain each read on a fitting strand, with the read's splice class."""
    placed = reads.with_end(A.aligned(spark, sf)).withColumnRenamed("pos", "start").select(*A.READ_KEY, "chrom", "start", "end", "strand", "cigar")
    hits = intervals.overlap_join(placed, A.genes(spark, sf), width=4096, levels=3, stranded=True, min_fraction=1.0)
    hits = hits.select(*A.READ_KEY, "cigar", F.col("start").alias("pos"), F.col("r_gene_ix").alias("gene_ix"), F.col("r_isoforms").alias("isoforms"))
    return splice.with_genes(hits, A.READ_KEY).select(*A.READ_KEY, F.explode("genes").alias("g")).select(*A.READ_KEY, "g.gene_ix", "g.splice")


def _bases_text() -> Column:
    return F.array_join(F.transform("bases", lambda b: F.concat_ws(":", b["site"].cast("string"), b["base"], b["qual"].cast("string"))), ",")


@query("""WITH r AS (SELECT l_suppkey AS barcode, l_orderkey % 200 AS umi, l_partkey % 3 AS chrom, l_partkey % 5 AS pos, l_partkey % 5 AS gene, CASE l_linestatus WHEN 'O' THEN 0 ELSE 1 END AS splice,
 CASE WHEN l_linenumber = 4 THEN NULL WHEN l_returnflag = 'R' THEN 'A' ELSE 'G' END AS letter, CASE WHEN (l_linenumber + 1) % 2 = 0 THEN NULL ELSE CAST(l_quantity AS INTEGER) + 1 END AS q1, CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE CAST(l_quantity AS INTEGER) + 2 END AS q2 FROM lineitem),
c AS (SELECT barcode, umi, chrom, pos, gene, splice, letter, count(*) AS n, coalesce(max(q1), 255) AS q1, coalesce(max(q2), 255) AS q2 FROM r GROUP BY ALL),
k AS (SELECT *, rank() OVER (PARTITION BY barcode, umi ORDER BY n DESC) AS place FROM c), one AS (SELECT barcode, umi FROM k WHERE place = 1 GROUP BY ALL HAVING count(*) = 1)
SELECT k.barcode, k.umi, CAST(chrom AS VARCHAR) AS chrom, CAST(pos AS INTEGER) AS pos, gene, CAST(splice AS INTEGER) AS splice, n, CASE WHEN letter IS NULL THEN '' ELSE (pos + 1) || ':' || letter || ':' || q1 || ',' || (pos + 2) || ':' || letter || ':' || q2 END AS bases
FROM k JOIN one USING (barcode, umi) WHERE place = 1""")
def rna_molecules(spark: SparkSession, sf: str) -> DataFrame:
    """The most-supported reading of each barcode and UMI over all it shows, with merged qualities."""
    got = dedup.rna_molecules(A.molecules(spark, sf))
    return got.select("barcode", "umi", "chrom", "pos", F.col("genes")[0]["gene_ix"].alias("gene"), F.col("genes")[0]["splice"].alias("splice"), "n", _bases_text().alias("bases"))


@query("""WITH r AS (SELECT l_suppkey AS barcode, l_partkey % 3 AS chrom, l_partkey % 50 AS start1, l_partkey % 50 + 20 + l_linenumber % 2 AS end2, CASE l_returnflag WHEN 'R' THEN 'A' ELSE 'G' END AS own,
 CASE l_linestatus WHEN 'O' THEN 'A' ELSE 'T' END AS other, CAST(l_quantity AS INTEGER) AS q1, CASE WHEN l_tax = 0 THEN NULL ELSE CAST(l_quantity AS INTEGER) END AS q2 FROM lineitem),
c AS (SELECT barcode, chrom, start1, end2, own, other, count(*) AS n, max(q1) AS q1, coalesce(max(q2), 255) AS q2 FROM r GROUP BY ALL),
k AS (SELECT *, rank() OVER (PARTITION BY barcode, chrom, start1, end2 ORDER BY n DESC) AS place FROM c), one AS (SELECT barcode, chrom, start1, end2 FROM k WHERE place = 1 GROUP BY ALL HAVING count(*) = 1)
SELECT k.barcode, CAST(k.chrom AS VARCHAR) AS chrom, CAST(k.start1 AS INTEGER) AS start1, CAST(k.end2 AS INTEGER) AS end2, n, (start1 + 6) || ':' || own || ':' || q1 || ',' || (start1 + 12) || ':' || other || ':' || q2 AS bases
FROM k JOIN one USING (barcode, chrom, start1, end2) WHERE place = 1""")
def atac_fragments(spark: SparkSession, sf: str) -> DataFrame:
    """The most-supported reading of each barcode and fragment; at a shared site the first mate's base counts."""
    return dedup.atac_fragments(A.mates(spark, sf)).select("barcode", "chrom", "start1", "end2", "n", _bases_text().alias("bases"))


@query("""WITH g AS (SELECT l_partkey AS vix, l_suppkey AS sample, min(l_discount) AS a, min(l_tax) AS b FROM lineitem GROUP BY ALL)
SELECT vix, sample, round(CASE WHEN b = 0 THEN NULL ELSE ((1 - a) / 2 + 2 * ((1 - a) / 2)) / 2 END, 6) AS dosage FROM g""")
def probability_dosage(spark: SparkSession, sf: str) -> DataFrame:
    """Dosage of genotype probabilities (one missing: none)."""
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(F.col("l_partkey").alias("vix"), F.col("l_suppkey").alias("sample")).agg(F.min("l_discount").alias("a"), F.min("l_tax").alias("b"))
    half = (1 - F.col("a")) / 2
    gp = F.array(F.when(F.col("b") > 0, F.col("a")), half, half)
    return rows.select("vix", "sample", F.round(F.when(F.forall(gp, lambda x: x.isNotNull()), C.dosage_from_probabilities(gp)), 6).alias("dosage"))


@query("""SELECT DISTINCT l_quantity AS q, l_discount AS d, format('{:.6g}', l_quantity / 7) AS mid, format('{:.8g}', l_quantity * 1234567.8 / 3) AS large, CASE WHEN l_discount = 0 THEN 'NA' ELSE format('{:.4g}', l_discount / (3e5 * l_quantity)) END AS small FROM lineitem""")
def number_format(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers with 4 to 8 significant digits, as the text outputs have them."""
    q, d = F.col("l_quantity"), F.col("l_discount")
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_quantity", "l_discount").distinct()
    small = F.when(d != 0, d / (q * 3e5))
    return rows.select(q.alias("q"), d.alias("d"), C.format_significant(q / 7, 6).alias("mid"), C.format_significant(q * 1234567.8 / 3, 8).alias("large"), C.format_significant(small, 4).alias("small"))


# Intervals


@query(f"""WITH {A.INTERVALS}, x AS (SELECT id, s % 500000000 AS s, s % 500000000 + (e - s) AS e FROM intervals)
SELECT id, CASE WHEN s >> 14 = (e - 1) >> 14 THEN 4681 + (s >> 14) WHEN s >> 17 = (e - 1) >> 17 THEN 585 + (s >> 17)
WHEN s >> 20 = (e - 1) >> 20 THEN 73 + (s >> 20) WHEN s >> 23 = (e - 1) >> 23 THEN 9 + (s >> 23)
WHEN s >> 26 = (e - 1) >> 26 THEN 1 + (s >> 26) ELSE 0 END AS bin FROM x""")
def bin_ucsc_assign(spark: SparkSession, sf: str) -> DataFrame:
    start = F.col("start") % 500_000_000
    return A.intervals(spark, sf).select("id", C.ucsc_bin(start, start + F.col("end") - F.col("start")).cast("long").alias("bin"))


@query(f"WITH {A.INTERVALS} SELECT i.id, p.id AS peak FROM intervals i JOIN peaks p ON i.chrom = p.chrom AND i.s < p.e AND p.s < i.e")
def interval_overlap_join(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.overlap_join(A.intervals(spark, sf), A.peaks(spark, sf), width=4096).select("id", F.col("r_id").alias("peak"))


@query(f"""WITH {A.INTERVALS} SELECT i.id, p.id AS peak, least(i.e, p.e) - greatest(i.s, p.s) AS overlap FROM intervals i JOIN peaks p
ON i.chrom = p.chrom AND i.s < p.e AND p.s < i.e""")
def interval_overlap_len(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.overlap_join(A.intervals(spark, sf), A.peaks(spark, sf), width=256, levels=3).select("id", F.col("r_id").alias("peak"), F.col("overlap").cast("long").alias("overlap"))


@query(f"""WITH {A.INTERVALS} SELECT i.id, g.id AS gene FROM intervals i JOIN (SELECT id, chrom, s - 900 AS s, e + 900 AS e, strand FROM intervals WHERE event_type IN ('click', 'view')) g
ON i.chrom = g.chrom AND g.s <= i.s AND i.e <= g.e AND NOT (i.strand = '+' AND g.strand = '-') AND NOT (i.strand = '-' AND g.strand = '+')""")
def interval_containment_join_stranded(spark: SparkSession, sf: str) -> DataFrame:
    every = A.intervals(spark, sf)
    genes = every.where("event_type in ('click', 'view')").select("id", "chrom", (F.col("start") - 900).alias("start"), (F.col("end") + 900).alias("end"), "strand")
    return intervals.overlap_join(every, genes, width=2048, stranded=True, min_fraction=1.0).select("id", F.col("r_id").alias("gene"))


@query(f"WITH {A.INTERVALS} SELECT id, chrom FROM intervals i WHERE EXISTS (SELECT 1 FROM peaks p WHERE i.chrom = p.chrom AND i.s < p.e AND p.s < i.e)")
def interval_semi_join(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.overlap_filter(A.intervals(spark, sf), A.peaks(spark, sf), keep=True, longest=512).select("id", "chrom")


@query(f"WITH {A.INTERVALS} SELECT id, chrom FROM intervals i WHERE NOT EXISTS (SELECT 1 FROM peaks p WHERE i.chrom = p.chrom AND i.s < p.e AND p.s < i.e)")
def interval_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.overlap_filter(A.intervals(spark, sf), A.peaks(spark, sf), keep=False, longest=300).select("id", "chrom")


@query(f"""WITH {A.INTERVALS}, wide AS (SELECT id, chrom, s, e + CASE WHEN event_type = 'error' THEN 3000000 ELSE 0 END AS e FROM intervals)
SELECT id, chrom FROM wide i WHERE NOT EXISTS (SELECT 1 FROM peaks p WHERE i.chrom = p.chrom AND i.s < p.e AND p.s < i.e)""")
def long_interval_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals of very different lengths that overlap no peak."""
    return intervals.overlap_filter(A.bounded_intervals(spark, sf), A.peaks(spark, sf), keep=False, longest=512).select("id", "chrom")


@query(f"""WITH {A.INTERVALS}, cuts AS (SELECT id, chrom, 0 AS cut_no, s + 4 AS cut FROM intervals UNION ALL SELECT id, chrom, 1, e - 6 FROM intervals)
SELECT c.id, c.cut_no, p.id AS peak FROM cuts c JOIN peaks p ON c.chrom = p.chrom AND c.cut >= p.s AND c.cut < p.e - 1""")
def cut_site_point_join(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.cut_site_peaks(A.intervals(spark, sf), A.peaks(spark, sf), width=4096).select("id", "cut_no", F.col("r_id").alias("peak"))


@query(f"""WITH {A.INTERVALS}, a AS (SELECT chrom, s, e, CASE WHEN s > max(e) OVER w OR max(e) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM peaks
WINDOW w AS (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM a)
SELECT chrom, min(s) AS "start", max(e) AS "end", count(*) AS n FROM b GROUP BY chrom, island""")
def merge_touching_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.merge_touching(A.peaks(spark, sf), ["chrom"], width=1 << 20)


@query(f"""WITH {A.INTERVALS}, a AS (SELECT *, CAST(floor(value) AS BIGINT) % 2 AS contig, row_number() OVER (PARTITION BY user_id ORDER BY s, id) - 1 AS k FROM intervals)
SELECT x.user_id, CAST(x.k // 2 AS BIGINT) AS pair_no, x.id AS id1, y.id AS id2, x.s AS start1, y.e AS end2 FROM a x JOIN a y
ON x.user_id = y.user_id AND x.k % 2 = 0 AND y.k = x.k + 1 AND x.contig = y.contig""")
def mate_pairing(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.intervals(spark, sf).withColumn("contig", F.floor("value") % 2)
    return reads.pair_mates(rows, ["user_id"], ["start", "id"], "contig", ["id", "start", "end"]).select("user_id", "pair_no", "id1", "id2", "start1", "end2")


# Deduplication and counts

_MODES = f"""WITH {A.READS}, counted AS (SELECT bc, umi, feat, allele, splice, count(*) AS n FROM reads GROUP BY ALL),
ranked AS (SELECT *, rank() OVER (PARTITION BY bc, umi ORDER BY n DESC) AS r FROM counted),
modes AS (SELECT bc, umi, any_value(feat) AS feat, any_value(allele) AS allele, any_value(splice) AS splice, any_value(n) AS n FROM ranked WHERE r = 1 GROUP BY bc, umi HAVING count(*) = 1)"""


def _modes(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.unique_mode_of(A.reads(spark, sf), ["bc", "umi"], ["feat", "allele", "splice"])


@query(_MODES + " SELECT bc, umi, feat, allele, splice, n FROM modes")
def dedup_unique_mode(spark: SparkSession, sf: str) -> DataFrame:
    return _modes(spark, sf)


@query(f"WITH {A.READS} SELECT bc, umi, feat, allele, count(*) AS n, coalesce(max(nullif(qual255, 255)), 255) AS qual FROM reads GROUP BY bc, umi, feat, allele")
def dedup_max_quality(spark: SparkSession, sf: str) -> DataFrame:
    got = dedup.count_readings(A.reads(spark, sf), ["bc", "umi"], ["feat", "allele"], "qual255")
    return got.withColumnRenamed("qual255", "qual")


@query("""WITH sites AS (SELECT p_partkey AS vix, p_size % 3 AS chrom, p_size AS pos, CASE p_partkey % 2 WHEN 0 THEN 'A' ELSE 'G' END AS ref, CASE p_partkey % 2 WHEN 0 THEN 'G' ELSE 'T' END AS alt FROM part WHERE p_retailprice < 903),
alone AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY chrom, pos) AS k FROM sites) WHERE k = 1),
bases AS (SELECT l_suppkey AS bc, (l_partkey % 50) % 3 AS chrom, l_partkey % 50 AS site, CASE l_returnflag WHEN 'R' THEN 'A' WHEN 'A' THEN 'G' ELSE CASE WHEN l_linestatus = 'O' THEN 'N' ELSE 'T' END END AS base, CASE WHEN l_tax = 0 THEN 255 ELSE CAST(l_quantity AS INTEGER) END AS qual FROM lineitem)
SELECT bc, b.chrom, site, vix, qual, CASE WHEN base = ref THEN 0 WHEN base = alt THEN 1 ELSE 15 END AS allele FROM bases b JOIN alone a ON b.chrom = a.chrom AND b.site = a.pos WHERE base <> 'N' AND qual >= 30""")
def allele_call_join(spark: SparkSession, sf: str) -> DataFrame:
    odd = F.col("p_partkey") % 2
    size = F.col("p_size").cast("long")
    sites = spark.read.parquet(f"{sf}/part.parquet").where("p_retailprice < 903").select(F.col("p_partkey").alias("vix"), (size % 3).alias("chrom"), size.alias("pos"), F.when(odd == 0, "A").otherwise("G").alias("ref"), F.when(odd == 0, "G").otherwise("T").alias("alt"))
    base = F.when(F.col("l_returnflag") == "R", "A").when(F.col("l_returnflag") == "A", "G").when(F.col("l_linestatus") == "O", "N").otherwise("T")
    site = F.col("l_partkey") % 50
    bases = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_suppkey").alias("bc"), (site % 3).alias("chrom"), site.alias("site"), base.alias("base"), F.when(F.col("l_tax") == 0, 255).otherwise(F.col("l_quantity").cast("int")).alias("qual"))
    return reads.call_alleles(bases, sites).select("bc", "chrom", "site", "vix", "qual", "allele")


@query(_MODES + " SELECT bc, feat, count(*) FILTER (allele = 0) AS ref, count(*) FILTER (allele = 1) AS alt, count(*) FILTER (allele > 1) AS oth FROM modes GROUP BY bc, feat")
def allele_count_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return counts.allele_counts(_modes(spark, sf), ["bc", "feat"])


@query(_MODES + " SELECT bc, feat, count(*) FILTER (splice = 0) AS spl, count(*) FILTER (splice = 1) AS uns, count(*) FILTER (splice = 2) AS amb FROM modes GROUP BY bc, feat")
def splice_count_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return counts.splice_counts(_modes(spark, sf), ["bc", "feat"])


@query(f"""WITH {A.INTERVALS}, cuts AS (SELECT user_id, chrom, s + 4 AS cut FROM intervals UNION ALL SELECT user_id, chrom, e - 6 FROM intervals)
SELECT c.user_id AS bc, p.id AS peak, count(*) AS n FROM cuts c JOIN peaks p ON c.chrom = p.chrom AND c.cut >= p.s AND c.cut < p.e - 1 GROUP BY ALL""")
def peak_count_matrix(spark: SparkSession, sf: str) -> DataFrame:
    hits = intervals.cut_site_peaks(A.intervals(spark, sf), A.peaks(spark, sf), width=4096)
    return counts.peak_counts(hits.select(F.col("user_id").alias("bc"), F.col("r_id").alias("peak")), ["bc", "peak"])


@query(_MODES + """, cells AS (SELECT bc, feat, count(*) FILTER (allele = 0) AS ref, count(*) FILTER (allele = 1) AS alt, count(*) FILTER (allele > 1) AS oth FROM modes GROUP BY bc, feat)
SELECT 'ref' AS matrix, feat + 1 AS row_ix, bc + 1 AS col_ix, ref AS n FROM cells UNION ALL SELECT 'alt', feat + 1, bc + 1, alt FROM cells UNION ALL SELECT 'oth', feat + 1, bc + 1, oth FROM cells""")
def mtx_triplets_with_zeros(spark: SparkSession, sf: str) -> DataFrame:
    return counts.triplets(counts.allele_counts(_modes(spark, sf), ["bc", "feat"]), "feat", "bc", ["ref", "alt", "oth"])


def _stats_sql(modality: str, p: str) -> str:
    return f"""(SELECT bc AS barcode, count(*) AS n_{p}, count(DISTINCT feat) AS n_{p}_features, count(DISTINCT vix) AS n_{p}_variants,
 round(avg(CASE WHEN vix <= 5 THEN 1.0 ELSE 0.0 END), 6) AS {p}_mt, round(avg(CASE WHEN splice < 2 THEN 1.0 ELSE 0.0 END), 6) AS {p}_in_features FROM reads WHERE modality = '{modality}' AND qual >= 49 AND allele < 2 GROUP BY bc)"""


_STATS = ["n_rna", "n_rna_features", "n_rna_variants", "rna_mt", "rna_in_features", "n_atac", "n_atac_features", "n_atac_variants", "atac_mt", "atac_in_features"]


@query(f"WITH {A.READS} SELECT barcode, {', '.join(f'coalesce({c}, 0) AS {c}' for c in _STATS)} FROM {_stats_sql('rna', 'rna')} a FULL JOIN {_stats_sql('atac', 'atac')} b USING (barcode)")
def barcode_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.reads(spark, sf).where("qual >= 49 and allele < 2").select(F.col("bc").alias("barcode"), "feat", "vix", "modality", (F.col("vix") <= 5).alias("mito"), (F.col("splice") < 2).alias("hit"))
    sides = [counts.modality_stats(rows.where(F.col("modality") == m), m, "feat", "vix", "mito", "hit") for m in ("rna", "atac")]
    return _round(counts.barcode_stats(*sides), "rna_mt", "rna_in_features", "atac_mt", "atac_in_features")


@query(f"WITH {A.READS} SELECT count(*) AS n FROM reads GROUP BY bc ORDER BY n DESC, bc LIMIT 1 OFFSET 7")
def top_n_barcode_count(spark: SparkSession, sf: str) -> DataFrame:
    return counts.nth_count(A.reads(spark, sf), "bc", 7)


_ROLLED = f"""WITH {A.READS}, per AS (SELECT bc, count(*) FILTER (modality = 'rna') AS rna, count(*) FILTER (modality = 'atac') AS atac FROM reads GROUP BY bc),
rolled AS (SELECT *, CASE WHEN rna < {A.OUT_MIN} AND atac < {A.OUT_MIN} THEN 'Empty' ELSE CAST(bc AS VARCHAR) END AS droplet FROM per)"""


def _rolled(spark: SparkSession, sf: str) -> DataFrame:
    per = A.reads(spark, sf).groupBy(F.col("bc").alias("barcode")).agg(F.count_if(F.col("modality") == "rna").alias("rna"), F.count_if(F.col("modality") == "atac").alias("atac"))
    return counts.low_count_rollup(per, A.OUT_MIN)


@query(_ROLLED + " SELECT droplet, count(*) + CASE WHEN droplet = 'Empty' THEN 1 ELSE 0 END AS n_bc, CAST(sum(rna) AS BIGINT) AS rna, CAST(sum(atac) AS BIGINT) AS atac, droplet = 'Empty' AS is_ambient FROM rolled GROUP BY droplet")
def low_count_rollup_empty(spark: SparkSession, sf: str) -> DataFrame:
    return counts.droplets(_rolled(spark, sf))


def _collapsed(spark: SparkSession, sf: str) -> DataFrame:
    obs = A.observations(spark, sf).where("qual >= 25")
    molecules = obs.groupBy("bc", "umi", "modality").agg(F.array_sort(F.collect_list(F.struct("vix", "allele", F.least("qual", F.lit(93)).alias("qual")))).alias("vars"))
    return molecules.groupBy("bc", "modality", "vars").agg(F.count("*").alias("n"))


_COLLAPSED = f"""WITH {A.OBSERVATIONS}, molecules AS (SELECT bc, umi, modality, string_agg(vix || ':' || allele || ':' || least(qual, 93), ',' ORDER BY vix, allele, qual) AS vars FROM observations WHERE qual >= 25 GROUP BY bc, umi, modality),
collapsed AS (SELECT bc, modality, vars, count(*) AS n FROM molecules GROUP BY ALL)"""


@query(_COLLAPSED + " SELECT bc, modality, vars, n FROM collapsed")
def molecule_collapse(spark: SparkSession, sf: str) -> DataFrame:
    text = F.array_join(F.transform("vars", lambda v: F.concat_ws(":", v["vix"].cast("string"), v["allele"].cast("string"), v["qual"].cast("string"))), ",")
    return _collapsed(spark, sf).select("bc", "modality", text.alias("vars"), "n")


@query(f"""WITH {A.OBSERVATIONS}, m AS (SELECT bc, umi, modality, bool_or(allele < 2) AS informative FROM observations WHERE qual >= 25 GROUP BY ALL),
v AS (SELECT bc, count(DISTINCT vix) AS n_variants FROM observations WHERE qual >= 25 AND allele < 2 GROUP BY bc)
SELECT m.bc, count(*) AS n_molecules, count(*) FILTER (informative) AS n_informative, coalesce(any_value(n_variants), 0) AS n_variants FROM m LEFT JOIN v ON m.bc = v.bc GROUP BY m.bc""")
def informative_counts(spark: SparkSession, sf: str) -> DataFrame:
    collapsed = _collapsed(spark, sf).withColumn("some", F.exists("vars", lambda v: v["allele"] < 2))
    totals = collapsed.groupBy("bc").agg(F.sum("n").alias("n_molecules"), F.sum(F.when(F.col("some"), F.col("n")).otherwise(0)).alias("n_informative"))
    kinds = collapsed.select("bc", F.explode("vars").alias("v")).where("v.allele < 2").groupBy("bc").agg(F.count_distinct("v.vix").alias("n_variants"))
    return totals.join(kinds, "bc", "left").na.fill(0, ["n_variants"])


@query("""WITH s AS (SELECT CAST(row_number() OVER (ORDER BY r_regionkey) - 1 AS INTEGER) AS ix FROM region),
p AS (SELECT 0 AS h, CAST(NULL AS INTEGER) AS s1, CAST(NULL AS INTEGER) AS s2 UNION ALL SELECT 1, ix, NULL FROM s UNION ALL SELECT 2, a.ix, b.ix FROM s a JOIN s b ON a.ix < b.ix)
SELECT CAST(row_number() OVER (ORDER BY h, s1, s2) - 1 AS BIGINT) AS hs_ix, h, s1, s2 FROM p""")
def hypothesis_table(spark: SparkSession, sf: str) -> DataFrame:
    samples = dense_index(spark.read.parquet(f"{sf}/region.parquet").select("r_regionkey"), ["r_regionkey"])
    return likelihood.hypothesis_table(samples)


# The model

_GAMMA = A.GENOTYPES + """,
gammas AS (SELECT vix, 1 + sample AS t, dosage AS g FROM dosages UNION ALL SELECT vix, 0, avg(dosage) FROM dosages GROUP BY vix)"""
_PROB = "CASE WHEN o.allele > 1 OR g.g IS NULL THEN 1.0 ELSE (1 - pow(10.0, -o.qual / 10.0)) * (CASE WHEN o.allele = 1 THEN g.g ELSE 1 - g.g END) + pow(10.0, -o.qual / 10.0) / 2 END"
_MOLECULES = f"""WITH {A.OBSERVATIONS}, {_GAMMA},
molecules AS (SELECT o.bc, o.umi, o.modality, g.t, exp(sum(ln({_PROB}))) AS p FROM observations o JOIN gammas g ON o.vix = g.vix GROUP BY ALL)"""
_HYPS_SQL = """hyps AS (SELECT row_number() OVER (ORDER BY h, s1, s2) - 1 AS hs_ix, h, s1, s2 FROM (SELECT 0 AS h, CAST(NULL AS BIGINT) AS s1, CAST(NULL AS BIGINT) AS s2
 UNION ALL SELECT 1, r_regionkey, NULL FROM region UNION ALL SELECT 2, a.r_regionkey, b.r_regionkey FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey))"""
_ALPHA = 0.1
#: psi and its parts for each molecule and hypothesis.
_PSI = _MOLECULES + f""", {_HYPS_SQL},
parts AS (SELECT m.bc, m.umi, m.modality, k.hs_ix, k.h, m.p AS pa, CASE k.h WHEN 0 THEN 0 WHEN 1 THEN a.p ELSE (a.p + b.p) / 2 END AS pc FROM molecules m JOIN hyps k ON m.t = 0
 LEFT JOIN molecules a ON a.bc = m.bc AND a.umi = m.umi AND a.modality = m.modality AND a.t = k.s1 + 1
 LEFT JOIN molecules b ON b.bc = m.bc AND b.umi = m.umi AND b.modality = m.modality AND b.t = k.s2 + 1),
psi AS (SELECT *, CASE WHEN h = 0 THEN pa ELSE {_ALPHA} * pa + (1 - {_ALPHA}) * pc END AS psi FROM parts)"""


def _gammas(spark: SparkSession, sf: str) -> DataFrame:
    return genotypes.with_ambient(genotypes.gamma_arrays(genotypes.dosages(A.genotypes(spark, sf)), list(range(A.N_SAMPLES))))


def _molecules(spark: SparkSession, sf: str) -> DataFrame:
    observed = likelihood.observation_probabilities(A.observations(spark, sf), _gammas(spark, sf))
    return likelihood.molecule_probabilities(observed, ["bc", "umi", "modality"], A.N_SAMPLES + 1)


def _long(df: DataFrame, keys: list[str], array: str, place: str, value: str) -> DataFrame:
    return df.select(*keys, F.posexplode(array).alias(place, value)).withColumn(place, F.col(place).cast("long"))


@query(f"WITH {A.READS} SELECT qual, round(pow(10.0, -qual / 10.0), 9) AS error FROM (SELECT DISTINCT qual FROM reads)")
def phred_error(spark: SparkSession, sf: str) -> DataFrame:
    return A.reads(spark, sf).select("qual").distinct().select("qual", F.round(C.phred_error(F.col("qual")), 9).alias("error"))


@query(f"WITH {A.OBSERVATIONS}, {_GAMMA} SELECT DISTINCT o.vix, o.allele, o.qual, g.t, round({_PROB}, 6) AS p FROM observations o JOIN gammas g ON o.vix = g.vix")
def base_likelihood(spark: SparkSession, sf: str) -> DataFrame:
    seen = A.observations(spark, sf).select("vix", "allele", "qual").distinct()
    return _round(_long(likelihood.observation_probabilities(seen, _gammas(spark, sf)), ["vix", "allele", "qual"], "probs", "t", "p"), "p")


@query(_MOLECULES + " SELECT bc, umi, modality, t, round(ln(p), 6) + 0.0 AS log_p FROM molecules")
def molecule_likelihood(spark: SparkSession, sf: str) -> DataFrame:
    got = _long(_molecules(spark, sf), ["bc", "umi", "modality"], "probs", "t", "p")
    return _round(got.withColumn("log_p", F.ln("p")).drop("p"), "log_p")


@query(_PSI + " SELECT bc, hs_ix, round(sum(ln(psi)), 4) AS llk FROM psi GROUP BY bc, hs_ix")
def mixture_likelihood_fixed_alpha(spark: SparkSession, sf: str) -> DataFrame:
    got = likelihood.log_likelihoods(_molecules(spark, sf), "bc", HYPS, _ALPHA)
    return _round(_long(got, ["bc"], "llk", "hs_ix", "llk"), "llk", places=4)


@query(_PSI + " SELECT bc, hs_ix, round(sum(CASE WHEN h = 0 THEN 0 ELSE (pa - pc) / psi END), 4) + 0.0 AS d1, round(sum(CASE WHEN h = 0 THEN 0 ELSE -((pa - pc) / psi) * ((pa - pc) / psi) END), 4) + 0.0 AS d2 FROM psi GROUP BY bc, hs_ix")
def alpha_derivatives_fixed_alpha(spark: SparkSession, sf: str) -> DataFrame:
    got = likelihood.derivatives(_molecules(spark, sf), "bc", HYPS, _ALPHA)
    got = got.select("bc", F.posexplode(F.arrays_zip("d1", "d2")).alias("hs_ix", "d")).select("bc", F.col("hs_ix").cast("long").alias("hs_ix"), "d.d1", "d.d2")
    return _round(got, "d1", "d2", places=4)


_LAMBDA, _PI = (0.2, 0.7, 0.1), 0.2
_POSTERIOR = _PSI + f""", lp AS (SELECT bc, hs_ix, any_value(h) AS h, sum(ln(psi)) + ln(CASE any_value(h) WHEN 0 THEN {_LAMBDA[0]} WHEN 1 THEN {_LAMBDA[1]} * {_PI} ELSE {_LAMBDA[2]} * {_PI * _PI} / ({_PI * _PI} * 10) END) AS lp FROM psi GROUP BY bc, hs_ix),
top AS (SELECT bc, max(lp) AS top FROM lp GROUP BY bc), x AS (SELECT l.bc, any_value(top) + ln(sum(exp(lp - top))) AS lp_x FROM lp l JOIN top t ON l.bc = t.bc GROUP BY l.bc),
posterior AS (SELECT l.bc, hs_ix, h, lp, exp(lp - lp_x) AS pp FROM lp l JOIN x ON l.bc = x.bc)"""


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    import numpy as np

    llk = likelihood.log_likelihoods(_molecules(spark, sf), "bc", HYPS, _ALPHA)
    return em.posteriors(llk, HYPS, np.array(_LAMBDA), np.full(A.N_SAMPLES, _PI))


@query(_POSTERIOR + " SELECT bc, hs_ix, round(pp, 6) + 0.0 AS pp FROM posterior")
def e_step_posterior(spark: SparkSession, sf: str) -> DataFrame:
    return _round(_long(_scored(spark, sf), ["bc"], "pp", "hs_ix", "pp"), "pp")


@query(_POSTERIOR + """, s AS (SELECT 'lambda' AS parameter, h AS ix, sum(pp) + 1e-8 AS v FROM posterior GROUP BY h UNION ALL
SELECT 'pi', r_regionkey, coalesce(sum(pp), 0) + 1e-8 FROM region r LEFT JOIN (SELECT pp, unnest([s1, s2]) AS s FROM posterior JOIN hyps USING (hs_ix)) q ON q.s = r.r_regionkey GROUP BY r_regionkey)
SELECT parameter, CAST(ix AS INTEGER) AS ix, round(v / sum(v) OVER (PARTITION BY parameter), 6) AS value FROM s""")
def m_step_lambda_pi(spark: SparkSession, sf: str) -> DataFrame:
    lam, pi = em.m_step(_scored(spark, sf), HYPS, A.N_SAMPLES, 0)
    rows = [("lambda", k, float(v)) for k, v in enumerate(lam)] + [("pi", k, float(v)) for k, v in enumerate(pi)]
    return _round(spark.createDataFrame(rows, "parameter string, ix int, value double"), "value")


def _best_sql(where: str) -> str:
    return f"(SELECT bc, hs_ix FROM (SELECT bc, hs_ix, row_number() OVER (PARTITION BY bc ORDER BY round(lp, 6) DESC, hs_ix) AS k FROM posterior WHERE {where}) WHERE k = 1)"


@query(_POSTERIOR + f" SELECT a.bc, a.hs_ix AS best, b.hs_ix AS best_singlet, c.hs_ix AS best_doublet FROM {_best_sql('true')} a JOIN {_best_sql('h = 1')} b ON a.bc = b.bc JOIN {_best_sql('h = 2')} c ON a.bc = c.bc")
def best_hypothesis(spark: SparkSession, sf: str) -> DataFrame:
    scored = _scored(spark, sf).withColumn("lp", F.transform("lp", lambda x: F.round(x, 6)))
    got = decide.decide(scored, HYPS)
    return got.select("bc", *[F.col(c).cast("long").alias(c) for c in ("best", "best_singlet", "best_doublet")])


@query(_POSTERIOR + """, t AS (SELECT bc, round(sum(pp) FILTER (h = 0), 6) AS p0, round(sum(pp) FILTER (h = 1), 6) AS p1, round(sum(pp) FILTER (h = 2), 6) AS p2 FROM posterior GROUP BY bc)
SELECT bc, p0 + 0.0 AS pp0, p1 + 0.0 AS pp1, p2 + 0.0 AS pp2, CASE WHEN p1 > p0 AND p1 > p2 THEN 'Singlet' WHEN p2 > p0 AND p2 > p1 THEN 'Doublet' ELSE 'Empty' END AS best_type FROM t""")
def call_type(spark: SparkSession, sf: str) -> DataFrame:
    got = _round(decide.decide(_scored(spark, sf), HYPS).select("bc", "pp0", "pp1", "pp2"), "pp0", "pp1", "pp2")
    return got.withColumn("best_type", decide.call_type(F.col("pp0"), F.col("pp1"), F.col("pp2")))


@query(f"""WITH {A.OBSERVATIONS}, {_GAMMA}, d AS (SELECT g.vix, sum(coalesce(abs(g.g - a.g), 0)) / {A.N_SAMPLES} AS d FROM gammas g JOIN gammas a ON g.vix = a.vix AND a.t = 0 WHERE g.t > 0 GROUP BY g.vix),
m AS (SELECT bc, umi, modality, avg(CASE WHEN allele > 1 THEN 0 ELSE d END) AS info FROM observations o JOIN d ON o.vix = d.vix GROUP BY ALL) SELECT bc, round(sum(info), 6) AS info FROM m GROUP BY bc""")
def ambient_info(spark: SparkSession, sf: str) -> DataFrame:
    return _round(likelihood.ambient_information(A.observations(spark, sf), _gammas(spark, sf), ["bc", "umi", "modality"], "bc"), "info")


@query(f"""WITH {A.OBSERVATIONS}, {_GAMMA}, n AS (SELECT vix, allele, qual, count(*) AS n FROM observations WHERE allele <= 1 GROUP BY ALL),
x AS (SELECT n.*, pow(10.0, -qual / 10.0) AS tau, least(greatest(g.g, 1e-8), 1 - 1e-8) AS x FROM n JOIN gammas g ON n.vix = g.vix AND g.t = 0 WHERE g.g IS NOT NULL),
a AS (SELECT *, CASE WHEN allele = 1 THEN x ELSE 1 - x END AS a FROM x),
s AS (SELECT *, n * ((1 - tau) * a / ((1 - tau) * a + tau / 2)) * (allele - x) / (x * (1 - x)) AS slope FROM a)
SELECT CAST(g.t - 1 AS INTEGER) AS sample, round(sum(slope * coalesce(g.g, 0)), 3) + 0.0 AS gradient, round(sum(n * (1 - tau)), 4) AS weight FROM s JOIN gammas g ON s.vix = g.vix AND g.t > 0 GROUP BY g.t""")
def pi_amb_gradient(spark: SparkSession, sf: str) -> DataFrame:
    got = ambient.gradient_terms(ambient.allele_totals(A.observations(spark, sf)), _gammas(spark, sf), A.N_SAMPLES)
    got = got.select(F.posexplode("d").alias("sample", "gradient"), F.round("n", 4).alias("weight"))
    return _round(got, "gradient", places=3)


@query("""WITH v AS (SELECT s_suppkey AS k, s_acctbal / 9000.0 AS x FROM supplier), o AS (SELECT *, row_number() OVER (ORDER BY x DESC, k) AS r, sum(x) OVER (ORDER BY x DESC, k ROWS UNBOUNDED PRECEDING) AS c FROM v),
e AS (SELECT *, (c - 1) / r AS excess FROM o), t AS (SELECT arg_max(excess, r) AS theta FROM e WHERE x > excess)
SELECT k, round(greatest(0, x - theta), 6) + 0.0 AS x FROM v, t""")
def simplex_projection(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("k"), (F.col("s_acctbal") / 9000.0).alias("x"))
    return _round(ambient.simplex_projection(rows, "k", "x"), "x")


def _model_input(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Distinct molecules (droplet, modality, probs, n) of test droplets, and droplets."""
    rolled = _rolled(spark, sf)
    test = rolled.where("droplet <> 'Empty'").select(F.col("barcode").alias("bc"), "droplet")
    molecules = _molecules(spark, sf).join(test, "bc").groupBy("droplet", "modality", "probs").agg(F.count("*").alias("n"))
    return molecules, counts.droplets(rolled)


@query()
def alpha_newton_mmle(spark: SparkSession, sf: str) -> DataFrame:
    """Alpha of every droplet, hypothesis and modality, with the first priors."""
    molecules, _ = _model_input(spark, sf)
    got = em.fit_alpha(molecules, HYPS, ["rna", "atac"], {"rna": 0.1, "atac": 0.1}, 1e-8)
    zipped = F.arrays_zip("alpha_rna", "alpha_atac")
    return got.select("droplet", F.posexplode(zipped).alias("hs_ix", "a")).select("droplet", "hs_ix", F.round("a.alpha_rna", 4).alias("alpha_rna"), F.round("a.alpha_atac", 4).alias("alpha_atac"))


def _pi_amb(spark: SparkSession, sf: str):
    import numpy as np

    low = _rolled(spark, sf).where("droplet = 'Empty'").select(F.col("barcode").alias("bc"))
    totals = ambient.allele_totals(A.observations(spark, sf).join(low, "bc", "left_semi")).orderBy("vix", "allele", "qual").toPandas()
    known = genotypes.gamma_arrays(genotypes.dosages(A.genotypes(spark, sf)), list(range(A.N_SAMPLES))).orderBy("vix").toPandas()
    gamma = np.array([[np.nan if g is None else g for g in row] for row in known["gammas"]], float).T
    at = {v: k for k, v in enumerate(known["vix"])}
    vix = totals["vix"].map(at).to_numpy(int) if len(totals) else np.zeros(0, int)
    return ambient.fit_pi_amb(vix, totals["allele"].to_numpy(float), 10.0 ** (-totals["qual"].to_numpy(float) / 10), totals["n"].to_numpy(float), gamma)


@query()
def pi_amb_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Fractions of the samples in the ambient pool."""
    pi, _ = _pi_amb(spark, sf)
    return spark.createDataFrame([(k, float(p)) for k, p in enumerate(pi)], "sample int, pi_amb double")


@query()
def em_fit_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The call of every test droplet after a full fit."""
    molecules, droplets = _model_input(spark, sf)
    row = droplets.agg(F.sum(F.when(F.col("is_ambient"), F.col("n_bc")).otherwise(0)).alias("ambient"), F.count_if(~F.col("is_ambient")).alias("test")).first()
    scored, _ = em.fit(molecules, A.N_SAMPLES, row["ambient"] or 0, row["test"], ["rna", "atac"], max_iter=20)
    got = decide.decide(scored, HYPS)
    alpha = lambda m: F.round(F.col(f"alpha_{m}")[F.col("best")], 4).alias(f"best_{m}_ambient")
    return got.select("droplet", "best_type", "best", "best_singlet", "best_doublet", alpha("rna"), alpha("atac"), *[F.round(f"pp{k}", 6).alias(f"pp{k}") for k in range(3)])


@query("SELECT user_id AS barcode, round(avg(CASE WHEN lower(event_type) IN ('chrm', 'chrmt', 'm', 'mt') OR lower(substr(event_type, 1, 1)) = 'm' THEN 1.0 ELSE 0.0 END), 6) AS mt, count(*) AS n FROM (SELECT user_id, CASE WHEN event_type = 'view' THEN 'chrM' WHEN event_type = 'error' THEN 'MT' ELSE 'chr1' END AS event_type FROM events) GROUP BY user_id")
def mito_predicate_fraction(spark: SparkSession, sf: str) -> DataFrame:
    chrom = F.when(F.col("event_type") == "view", "chrM").when(F.col("event_type") == "error", "MT").otherwise("chr1")
    rows = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("barcode"), C.is_mito(chrom).alias("mt"))
    return _round(rows.groupBy("barcode").agg(F.avg(F.col("mt").cast("double")).alias("mt"), F.count("*").alias("n")), "mt")
