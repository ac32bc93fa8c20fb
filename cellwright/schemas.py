"""Schemas of the normalised tables.  Coordinates are 0-based and half-open."""

from __future__ import annotations

CIGAR = "array<struct<op:string,len:int>>"
ALIGNMENTS = f"qname string, flag int, chrom string, pos int, mapq int, cigar {CIGAR}, seq string, qual array<int>, cb string, ub string, nh int, seqno long"
VARIANTS = "vix long, chrom string, pos int, id string, ref string, alt string"
GENOTYPES = "vix long, sample string, alleles array<int>, dosage double"
GTF = "seqname string, source string, feature string, start int, end int, score string, strand string, frame string, attrs array<struct<key:string,value:string>>"
GENES = "gene_ix long, gene_id string, gene_name string, gene_type string, chrom string, start int, end int, strand string"
EXONS = "gene_id string, transcript_id string, chrom string, start int, end int"
REGIONS = "ix long, chrom string, start int, end int"
