"""Splice classes of reads against genes.

For each isoform of a gene the read's operations that consume query or
reference are walked.  The isoform is fully overlapped if the reference bases
it shares with the read are as many as those operations' lengths (so clips and
insertions rule it out).  A skipped stretch (N) whose ends are an exon's end and
the next one's start is a junction.

0 spliced: a fully overlapped isoform has a junction.  1 unspliced: there are
fully overlapped isoforms, and the read reaches an intron of each.  2: neither.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import QUERY_OPS, REFERENCE_OPS
from .reads import blocks

SPLICED, UNSPLICED, AMBIGUOUS = 0, 1, 2


def _shared(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a2, b2) - F.greatest(a1, b1))


def isoform_class(cigar: Column, pos: Column, exons: Column) -> Column:
    """struct<full, junction, intronic> of a read against an isoform's exons (sorted, disjoint)."""
    walked = F.filter(blocks(cigar, pos), lambda b: b["op"].isin(*set(QUERY_OPS + REFERENCE_OPS)))
    ref_len = lambda b: F.when(b["op"].isin(*REFERENCE_OPS), b["len"]).otherwise(F.lit(0))
    introns = F.zip_with(F.slice(exons, F.lit(1), F.greatest(F.lit(0), F.size(exons) - 1)), F.slice(exons, F.lit(2), F.greatest(F.lit(0), F.size(exons) - 1)), lambda a, b: F.struct(a["end"].alias("start"), b["start"].alias("end")))
    first, last = F.element_at(exons, 1)["start"], F.element_at(exons, -1)["end"]
    length = F.aggregate(walked, F.lit(0), lambda n, b: n + b["len"])
    inside = F.aggregate(walked, F.lit(0), lambda n, b: n + _shared(b["ref"], b["ref"] + ref_len(b), first, last))
    in_introns = F.aggregate(walked, F.lit(0), lambda n, b: F.aggregate(introns, n, lambda m, i: m + _shared(b["ref"], b["ref"] + ref_len(b), i["start"], i["end"])))
    junction = F.exists(walked, lambda b: (b["op"] == "N") & F.exists(introns, lambda i: (i["start"] == b["ref"]) & (i["end"] == b["ref"] + b["len"])))
    return F.struct((inside == length).alias("full"), junction.alias("junction"), (in_introns > 0).alias("intronic"))


def gene_class(cigar: Column, pos: Column, isoforms: Column) -> Column:
    """The read's class against a gene with isoforms array<array<struct<start, end>>>."""
    each = F.filter(F.transform(F.filter(isoforms, lambda e: F.size(e) > 0), lambda e: isoform_class(cigar, pos, e)), lambda c: c["full"])
    spliced = F.exists(each, lambda c: c["junction"])
    unspliced = (F.size(each) > 0) & F.forall(each, lambda c: c["intronic"])
    return F.when(spliced, F.lit(SPLICED)).when(unspliced, F.lit(UNSPLICED)).otherwise(F.lit(AMBIGUOUS))


def with_genes(hits: DataFrame, keys: list[str]) -> DataFrame:
    """hits: reads joined to genes that contain them (gene_ix, isoforms); keys and genes, sorted."""
    classed = hits.select(*keys, F.struct(F.col("gene_ix"), gene_class(F.col("cigar"), F.col("pos"), F.col("isoforms")).alias("splice")).alias("g"))
    return classed.groupBy(*keys).agg(F.array_sort(F.collect_list("g")).alias("genes"))
