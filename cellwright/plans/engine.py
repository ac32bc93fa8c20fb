"""The two runs: counts only, and counts with the fit of the model.

One lazy plan a modality: scan, filters, interval joins, deduplication, calls.
All groupings start with the barcode.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.columns import format_significant, is_mito, log_sum_exp
from ..operators import counts, dedup, genotypes, intervals, reads, splice
from ..operators.dictionary import dense_index, union_in_order
from ..operators.model import ambient, decide, em, likelihood
from ..scratch import Scratch
from ..sources import bam, sinks, text

_STAT = ["n_rna", "n_atac", "n_features", "n_peaks", "n_rna_info", "n_atac_info", "n_rna_variants", "n_atac_variants", "rna_pct_mt", "atac_pct_mt", "FRIG", "FRIP"]
SUMMARY = ["Barcode", "n_rna_molecules", "n_atac_molecules", "n_features", "n_peaks", "n_rna_info", "n_atac_info", "n_rna_variants", "n_atac_variants", "rna_pct_mt", "atac_pct_mt", "FRIG", "FRIP", "best_type", "best_sample", "best_rna_ambient", "rna_ambient_info", "best_atac_ambient", "atac_ambient_info", "best_singlet", "best_doublet", "PP0", "PP1", "PP2", "LLK0", "LLK1", "LLK2"]


@dataclass
class Inputs:
    variants: DataFrame
    genotypes: DataFrame
    samples: list[str]
    genes: DataFrame | None = None
    peaks: DataFrame | None = None
    exclude: DataFrame | None = None
    whitelist: DataFrame | None = None


class Engine:
    """A run over one configuration."""

    def __init__(self, spark: SparkSession, config: EngineConfig):
        self.spark, self.config = spark, config
        self.scratch = Scratch(spark, "engine")

    def inputs(self) -> Inputs:
        c = self.config
        if c.vcf is None:
            raise ValueError("a VCF is needed")
        listed = [r[0] for r in text.read_list(self.spark, c.samples, "sample").collect()] if c.samples else None
        variants, cells = text.read_vcf(self.spark, c.vcf, listed, c.genotype_field, c.region)
        cells = self.scratch.table(cells, "genotypes")
        kept = genotypes.informative(genotypes.variant_stats(cells), c.max_miss, c.maf_cut).select("vix") if c.genotype_field == "GT" else cells.groupBy("vix").agg(F.avg("dosage").alias("g")).where("g > 0 and g < 1").select("vix")
        # Dense indices again, in the file's order.
        renumbered = dense_index(variants.join(kept, "vix").withColumnRenamed("vix", "old"), ["old"], "vix")
        renumbered = self.scratch.table(renumbered, "variants")
        cells = cells.join(renumbered.select(F.col("old").alias("vix"), F.col("vix").alias("new")), "vix").drop("vix").withColumnRenamed("new", "vix")
        have = text.vcf_samples(self.spark, c.vcf)
        names = [s for s in have if listed is None or s in listed]
        got = Inputs(renumbered.drop("old"), cells, names)
        if c.gtf:
            got.genes = self.scratch.table(text.annotation(text.read_gtf(self.spark, c.gtf, c.tx_basic))[0], "genes")
        if c.peaks:
            got.peaks = self.scratch.table(text.read_bed(self.spark, c.peaks), "peaks")
        if c.exclude:
            got.exclude = text.read_bed(self.spark, c.exclude)
        if c.bc_wl:
            got.whitelist = text.read_list(self.spark, c.bc_wl, "barcode")
        return got

    def _bases(self, aligned: DataFrame, given: Inputs, keys: list[str]) -> DataFrame:
        """keys and bases: array<struct<site, base, qual>> in order of site."""
        sites = given.variants.select("chrom", "pos")
        found = reads.bases_at_variants(aligned, sites, keys).groupBy(*keys, "site").agg(F.min(F.struct("base", "qual")).alias("b"))
        return found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("site"), F.col("b.base"), F.col("b.qual")))).alias("bases"))

    def _called(self, df: DataFrame, given: Inputs, keys: list[str]) -> DataFrame:
        """keys and vars: array<struct<vix, allele, qual>> in order of vix."""
        spread = df.select(*keys, "chrom", F.inline("bases"))
        called = reads.call_alleles(spread, given.variants, self.config.min_phredq)
        return called.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("vix", "allele", "qual"))).alias("vars"))

    def molecules(self, given: Inputs) -> DataFrame:
        """RNA molecules: barcode, umi, place, genes, vars, n."""
        c = self.config
        raw = reads.with_end(bam.read_alignments(self.spark, c.rna_bam, c.rna_bc_tag, c.rna_umi_tag, c.rna_nh_tag))
        raw = reads.in_regions(reads.filter_reads(raw, c.rna_mapq, True, c.max_nh), c.region)
        raw = raw.select(F.col("cb").alias("barcode"), F.col("ub").alias("umi"), "seqno", "chrom", F.col("pos"), "end", F.when(F.col("flag").bitwiseAND(16) > 0, "-").otherwise("+").alias("strand"), "cigar", "seq", "qual")
        keys = ["barcode", "umi", "seqno"]
        got = raw.drop("cigar", "seq", "qual")
        no_genes = F.array().cast("array<struct<gene_ix:bigint,splice:int>>")
        if given.genes is not None:
            hits = intervals.overlap_join(raw.withColumnRenamed("pos", "start").drop("seq", "qual"), given.genes, levels=3, stranded=True, min_fraction=1.0)
            hits = hits.select(*keys, "cigar", F.col("start").alias("pos"), F.col("r_gene_ix").alias("gene_ix"), F.col("r_isoforms").alias("isoforms"))
            got = got.join(splice.with_genes(hits, keys), keys, "left").withColumn("genes", F.coalesce("genes", no_genes))
        else:
            got = got.withColumn("genes", no_genes)
        got = got.join(self._bases(raw, given, keys), keys, "left").withColumn("bases", F.coalesce("bases", F.array().cast("array<struct<site:int,base:string,qual:int>>")))
        got = got.where((F.size("genes") > 0) | (F.size("bases") > 0))
        kept = self.scratch.table(dedup.rna_molecules(got), "molecules")
        called = self._called(kept, given, ["barcode", "umi"])
        empty = F.array().cast("array<struct<vix:bigint,allele:int,qual:int>>")
        return self.scratch.table(kept.join(called, ["barcode", "umi"], "left").withColumn("vars", F.coalesce("vars", empty)).drop("bases"), "rna")

    def fragments(self, given: Inputs) -> DataFrame:
        """ATAC fragments: barcode, chrom, coordinates, vars, peak_hits (indices, one a cut site), n."""
        c = self.config
        raw = reads.with_end(bam.read_alignments(self.spark, c.atac_bam, c.atac_bc_tag, c.rna_umi_tag, c.atac_nh_tag))
        raw = reads.in_regions(reads.filter_reads(raw, c.atac_mapq, False, 0), c.region)
        if given.exclude is not None:
            raw = intervals.overlap_filter(raw.withColumnRenamed("pos", "start"), given.exclude, keep=False).withColumnRenamed("start", "pos")
        if c.max_nh > 0:
            raw = raw.where(F.when(F.col("nh").isNull(), F.raise_error(F.lit("a read has no hit count tag"))).otherwise(F.col("nh") <= c.max_nh))
        raw = raw.withColumnRenamed("cb", "barcode")
        keys = ["barcode", "qname", "seqno"]
        none = F.array().cast("array<struct<site:int,base:string,qual:int>>")
        read = raw.select(*keys, "chrom", "pos", "end").join(self._bases(raw, given, keys), keys, "left").withColumn("bases", F.coalesce("bases", none))
        numbered = reads.pair_mates(read.withColumn("mate", F.struct("pos", "end", "bases")), ["barcode", "qname"], ["seqno"], "chrom", ["mate"])
        mates = F.array_sort(F.array("mate1", "mate2"))
        pairs = numbered.select("barcode", F.col("chrom1").alias("chrom"), mates.alias("m"))
        pairs = pairs.select("barcode", "chrom", *[F.col("m")[k][f].alias(f"{n}{k + 1}") for k in (0, 1) for f, n in (("pos", "start"), ("end", "end"), ("bases", "bases"))])
        kept = self.scratch.table(dedup.atac_fragments(pairs), "fragments")
        keys = ["barcode", "chrom", "start1", "end1", "start2", "end2"]
        got = kept.join(self._called(kept, given, keys), keys, "left").withColumn("vars", F.coalesce("vars", F.array().cast("array<struct<vix:bigint,allele:int,qual:int>>"))).drop("bases")
        if given.peaks is not None:
            spans = kept.select(*keys).withColumns({"start": F.col("start1"), "end": F.col("end2")})
            hits = intervals.cut_site_peaks(spans, given.peaks, c.parity).groupBy(*keys).agg(F.array_sort(F.collect_list("r_ix")).alias("peak_hits"))
            got = got.join(hits, keys, "left")
        else:
            got = got.withColumn("peak_hits", F.lit(None).cast("array<bigint>"))
        return self.scratch.table(got.withColumn("peak_hits", F.coalesce("peak_hits", F.array().cast("array<bigint>"))), "atac")

    def stats(self, given: Inputs, rna: DataFrame | None, atac: DataFrame | None) -> DataFrame:
        """Per-barcode statistics; a missing modality counts 0 and has -1 as FRIG or FRIP."""
        sides = []
        if rna is not None:
            frig = F.lit(0.0) if self.config.parity else F.avg((F.size("genes") > 0).cast("double"))
            genes = rna.select("barcode", F.explode("genes").alias("g")).groupBy("barcode").agg(F.count_distinct("g.gene_ix").alias("n_features"))
            variants = rna.select("barcode", F.explode("vars").alias("v")).groupBy("barcode").agg(F.count_distinct("v.vix").alias("n_rna_variants"))
            base = rna.groupBy("barcode").agg(F.count("*").alias("n_rna"), F.count_if(F.size("vars") > 0).alias("n_rna_info"), F.avg(is_mito(F.col("chrom")).cast("double")).alias("rna_pct_mt"), frig.alias("FRIG"))
            sides.append(base.join(genes, "barcode", "left").join(variants, "barcode", "left"))
        if atac is not None:
            found = atac.select("barcode", F.explode("peak_hits").alias("p")).groupBy("barcode").agg(F.count_distinct("p").alias("n_peaks"))
            variants = atac.select("barcode", F.explode("vars").alias("v")).groupBy("barcode").agg(F.count_distinct("v.vix").alias("n_atac_variants"))
            base = atac.groupBy("barcode").agg(F.count("*").alias("n_atac"), F.count_if(F.size("vars") > 0).alias("n_atac_info"), F.avg(is_mito(F.col("chrom")).cast("double")).alias("atac_pct_mt"), F.avg((F.size("peak_hits") > 0).cast("double")).alias("FRIP"))
            sides.append(base.join(found, "barcode", "left").join(variants, "barcode", "left"))
        got = sides[0] if len(sides) == 1 else sides[0].join(sides[1], "barcode", "full_outer")
        absent = ({"FRIG"} if rna is None else set()) | ({"FRIP"} if atac is None else set())
        for name in _STAT:
            if name not in got.columns:
                got = got.withColumn(name, F.lit(-1.0 if name in absent else 0))
        return got.na.fill(0).select("barcode", *_STAT)

    def barcodes(self, given: Inputs, *molecules: DataFrame | None) -> DataFrame:
        seen = None
        for m in molecules:
            if m is not None:
                seen = m.select("barcode") if seen is None else seen.union(m.select("barcode"))
        listed = given.whitelist if given.whitelist is not None else self.spark.createDataFrame([], "barcode string, place long")
        return self.scratch.table(union_in_order(listed, seen, "barcode", "place"), "barcodes")

    def write_counts(self, given: Inputs, rna: DataFrame | None, atac: DataFrame | None) -> None:
        out, index = self.config.out, self.barcodes(given, rna, atac)
        n, n_variants = index.count(), given.variants.count()
        sinks.barcodes(index, f"{out}.barcodes.txt.gz")
        sinks.variants(given.variants, f"{out}.var.txt.gz")
        alleles = lambda m: counts.allele_counts(m.select("barcode", F.inline("vars")), ["barcode", "vix"]).join(index, "barcode")
        if rna is not None:
            sinks.matrices(alleles(rna), f"{out}.rna.ac", ["ref", "alt", "oth"], "vix", "ix", n_variants, n)
            if given.genes is not None:
                sinks.genes(given.genes, f"{out}.gene.txt.gz")
                sinks.matrices(counts.gene_counts(rna).join(index, "barcode"), f"{out}.gc", ["spl", "uns", "amb"], "gene_ix", "ix", given.genes.count(), n)
        if atac is not None:
            sinks.matrices(alleles(atac), f"{out}.atac.ac", ["ref", "alt", "oth"], "vix", "ix", n_variants, n)
            if given.peaks is not None:
                sinks.peaks(given.peaks, f"{out}.peaks.txt.gz")
                hits = counts.peak_counts(atac.select("barcode", F.explode("peak_hits").alias("peak")), ["barcode", "peak"])
                sinks.matrix(hits.join(index, "barcode"), f"{out}.atac.peaks.mtx.gz", "peak", "ix", "n", given.peaks.count(), n)

    def _features(self, column: Column) -> Column:
        """Whether a molecule's number of features suits mdl_reads."""
        return {"intra": F.size(column) > 0, "inter": F.size(column) == 0, "all": F.lit(True)}[self.config.mdl_reads]

    def fit(self, given: Inputs, rna: DataFrame | None, atac: DataFrame | None, stats: DataFrame) -> DataFrame:
        """Fit the model, write its tables, and return the summary."""
        c, out, m = self.config, self.config.out, len(given.samples)
        hyps = likelihood.hypotheses(m)
        per = stats.select("barcode", F.col("n_rna").alias("rna"), F.col("n_atac").alias("atac"))
        rolled = self.scratch.table(counts.low_count_rollup(per, c.out_min), "rolled")
        modalities, parts = [], []
        for name, df, features in (("rna", rna, "genes"), ("atac", atac, "peak_hits")):
            if df is not None:
                modalities.append(name)
                used = df.where((F.size("vars") > 0) & self._features(F.col(features)))
                feature = F.when(F.size(features) == 1, F.col("genes")[0]["gene_ix"]) if name == "rna" else F.get("peak_hits", F.lit(0))
                capped = F.transform("vars", lambda v: F.struct(v["vix"].alias("vix"), F.least(v["allele"], F.lit(2)).alias("allele"), F.when(v["qual"] == 255, 255).otherwise(F.least(v["qual"], F.lit(93))).alias("qual")))
                parts.append(used.select("barcode", F.lit(name).alias("modality"), feature.alias("feature"), capped.alias("vars")))
        every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        distinct = every.join(rolled.select("barcode", "droplet"), "barcode").groupBy("droplet", "modality", "feature", "vars").agg(F.count("*").alias("n"))
        distinct = self.scratch.table(distinct, "distinct")
        dosage = given.genotypes.select("vix", "sample", "dosage")
        gammas = self.scratch.table(genotypes.gamma_arrays(dosage, given.samples), "gammas")
        pi_amb = self._pi_amb(distinct, gammas)
        wide = self.scratch.table(genotypes.with_ambient(gammas, pi_amb.tolist()), "wide")
        test = distinct.where("droplet <> 'Empty'").withColumn("id", F.xxhash64("droplet", "modality", "feature", "vars"))
        keys = ["droplet", "modality", "feature", "vars", "n"]
        observed = likelihood.observation_probabilities(test.select(*keys, F.inline("vars")), wide)
        molecules = likelihood.molecule_probabilities(observed, keys, m + 1).select("droplet", "modality", "probs", "n")
        groups = counts.droplets(rolled).agg(F.sum(F.when(F.col("is_ambient"), F.col("n_bc")).otherwise(0)).alias("ambient"), F.count_if(~F.col("is_ambient")).alias("test")).first()
        scored, pars = em.fit(molecules, m, groups["ambient"] or 1, groups["test"] or 0, modalities, c.amb_prior_w, c.eps, c.max_iter, pi_amb)
        info = {x: likelihood.ambient_information(test.where(F.col("modality") == x).select("droplet", "id", F.inline("vars")), wide, ["droplet", "id"], "droplet") for x in modalities}
        self._write_model(given, hyps, scored, pars, modalities)
        summary = self._summary(given, hyps, decide.decide(scored, hyps), stats, rolled, info, modalities, pars)
        sinks.table(summary, f"{out}.summary.txt", SUMMARY, ["Barcode"], ["\t".join(SUMMARY)], compress=False)
        return summary

    def _pi_amb(self, distinct: DataFrame, gammas: DataFrame) -> np.ndarray:
        seen = distinct.where("droplet = 'Empty'").select("n", F.inline("vars")).where("allele <= 1")
        totals = seen.groupBy("vix", "allele", "qual").agg(F.sum("n").alias("n")).orderBy("vix", "allele", "qual").toPandas()
        known = gammas.orderBy("vix").toPandas()
        gamma = np.array([[np.nan if g is None else g for g in row] for row in known["gammas"]], float).T
        at = {v: k for k, v in enumerate(known["vix"])}
        qual = totals["qual"].to_numpy(float) if len(totals) else np.zeros(0)
        tau = np.where(qual == 255, 0.01, 10.0 ** (-qual / 10))
        vix = totals["vix"].map(at).to_numpy(int) if len(totals) else np.zeros(0, int)
        return ambient.fit_pi_amb(vix, totals["allele"].to_numpy(float), tau, totals["n"].to_numpy(float), gamma, self.config.eps)[0]

    def _write_model(self, given: Inputs, hyps: list, scored: DataFrame, pars: em.Parameters, modalities: list[str]) -> None:
        out, spark = self.config.out, self.spark
        name = lambda s: None if s is None else given.samples[s]
        rows = spark.createDataFrame([(h.ix, h.h, name(h.s1), name(h.s2)) for h in hyps], "ix int, H int, s1 string, s2 string")
        sinks.table(rows, f"{out}.samples.txt", ["H", "s1", "s2"], ["ix"], ["H\ts1\ts2"], compress=False)
        lam = spark.createDataFrame([(k, float(x)) for k, x in enumerate(pars.lam)], "h int, v double")
        sinks.table(lam, f"{out}.lambda.txt.gz", ["h", format_significant(F.col("v"), 8)], ["h"], ["\tLambda"])
        pi = spark.createDataFrame([(k, s, float(pars.pi[k]), float(pars.pi_amb[k])) for k, s in enumerate(given.samples)], "k int, s string, p double, a double")
        sinks.table(pi, f"{out}.pi.txt.gz", ["s", format_significant(F.col("p"), 8), format_significant(F.col("a"), 8)], ["k"], ["\tPi\tPi_amb"])
        prior = spark.createDataFrame([(0, "prior_value", *[float(pars.prior[m]) for m in modalities]), (1, "prior_weight", *[float(pars.prior_weight) for _ in modalities])], "k int, n string, " + ", ".join(f"{m} double" for m in modalities))
        sinks.table(prior, f"{out}.alpha_prior.txt.gz", ["n", *[format_significant(F.col(m), 8) for m in modalities]], ["k"], ["\t" + "\t".join(m.upper() for m in modalities)])
        sinks.dense(scored, f"{out}.sample_llk.txt.gz", "droplet", "lp")
        for m in modalities:
            sinks.dense(scored, f"{out}.alpha_{m}.txt.gz", "droplet", f"alpha_{m}")

    def _summary(self, given: Inputs, hyps: list, calls: DataFrame, stats: DataFrame, rolled: DataFrame, info: dict, modalities: list[str], pars: em.Parameters) -> DataFrame:
        label = {h.ix: "Empty" if h.h == 0 else ":".join(given.samples[s] for s in h.samples) for h in hyps}
        names = F.array(*[F.lit(label[h.ix]) for h in hyps])
        chosen = F.when(F.col("best_type") == "Singlet", F.col("best_singlet")).when(F.col("best_type") == "Doublet", F.col("best_doublet")).otherwise(F.lit(0))
        tests = rolled.where("droplet <> 'Empty'").select("barcode", "droplet")
        got = tests.join(calls, "droplet").join(stats, "barcode")
        for m in ("rna", "atac"):
            if m in modalities:
                got = got.join(info[m].withColumnRenamed("info", f"{m}_info"), "droplet", "left").withColumn(f"{m}_info", F.coalesce(f"{m}_info", F.lit(0.0)))
                got = got.withColumn(f"best_{m}", F.when(F.col("best_type") != "Empty", F.get(f"alpha_{m}", chosen)))
            else:
                got = got.withColumns({f"{m}_info": F.lit(None).cast("double"), f"best_{m}": F.lit(None).cast("double")})
        llk = {k: log_sum_exp([F.col("lp")[h.ix] for h in hyps if h.h == k]) for k in range(3)}
        four, eight = lambda c: format_significant(F.col(c), 4), lambda c: format_significant(c, 8)
        whole = [F.col(c).cast("string") for c in _STAT[:8]]
        return got.select(
            F.col("barcode").alias("Barcode"), *[w.alias(n) for w, n in zip(whole, SUMMARY[1:9], strict=True)], *[four(c).alias(c) for c in _STAT[8:]],
            "best_type", F.get(names, chosen).alias("best_sample"), eight(F.col("best_rna")).alias("best_rna_ambient"), eight(F.col("rna_info")).alias("rna_ambient_info"),
            eight(F.col("best_atac")).alias("best_atac_ambient"), eight(F.col("atac_info")).alias("atac_ambient_info"), F.get(names, F.col("best_singlet")).alias("best_singlet"), F.get(names, F.col("best_doublet")).alias("best_doublet"),
            *[eight(F.col(f"pp{k}")).alias(f"PP{k}") for k in range(3)], *[eight(llk[k]).alias(f"LLK{k}") for k in range(3)],
        )

    def run(self) -> DataFrame | None:
        """The run the configuration asks for; the summary, or None for counts only."""
        given = self.inputs()
        rna = self.molecules(given) if self.config.rna_bam else None
        atac = self.fragments(given) if self.config.atac_bam else None
        if rna is None and atac is None:
            raise ValueError("RNA or ATAC alignments are needed")
        stats = self.scratch.table(self.stats(given, rna, atac), "stats")
        if not self.config.no_counts_o:
            self.write_counts(given, rna, atac)
        return None if self.config.counts_only else self.fit(given, rna, atac, stats)

