"""Column expressions of the droplet engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Contig names of the mitochondrion, in lower case.
MITO = ("chrmt", "chrm", "m", "mt")
#: CIGAR operations that consume the query, and the reference.
QUERY_OPS = ("M", "I", "S", "=", "X")
REFERENCE_OPS = ("M", "D", "N", "=", "X")
MISSING_QUAL = 255
#: Error of a base whose quality is missing.
DEFAULT_TAU = 0.01
REF, ALT, OTHER = 0, 1, 15


def is_mito(chrom: Column) -> Column:
    return F.coalesce(F.lower(chrom).isin(*MITO), F.lit(False))


def phred_error(qual: Column) -> Column:
    """10 ** (-q / 10); the default error where the quality is missing."""
    return F.when(qual.isNull() | (qual == MISSING_QUAL), F.lit(DEFAULT_TAU)).otherwise(F.pow(F.lit(10.0), -qual.cast("double") / 10))


def base_probability(gamma: Column, allele: Column, tau: Column) -> Column:
    """P(observed base | source): 1 for other alleles and for a missing genotype."""
    p = F.when(allele == ALT, gamma).otherwise(1 - gamma)
    return F.when((allele > 1) | gamma.isNull() | (gamma < 0), F.lit(1.0)).otherwise((1 - tau) * p + tau / 2)


def overlap_length(a1: Column, a2: Column, sa: Column | None, b1: Column, b2: Column, sb: Column | None) -> Column:
    """Bases shared by [a1, a2) and [b1, b2); 0 on opposite strands; '.' fits both."""
    length = F.greatest(F.lit(0), F.least(a2, b2) - F.greatest(a1, b1))
    if sa is None or sb is None:
        return length
    opposite = ((sa == "+") & (sb == "-")) | ((sa == "-") & (sb == "+"))
    return F.when(opposite, F.lit(0)).otherwise(length)


def ucsc_bin(start: Column, end: Column) -> Column:
    """The smallest of the 37,449 bins (6 levels, 16 kb to 512 Mb) that holds [start, end)."""
    last = end - 1
    out = None
    offset, shift = 4681, 14
    while shift <= 26:
        a, b = F.shiftright(start, shift), F.shiftright(last, shift)
        out = F.when(a == b, a + offset) if out is None else out.when(a == b, a + offset)
        offset, shift = (offset - 1) // 8, shift + 3
    return out.otherwise(F.lit(0))


def ucsc_bins(start: Column, end: Column) -> Column:
    """All bins that overlap [start, end), as an array."""
    last, parts = end - 1, [F.array(F.lit(0).cast("long"))]
    for offset, shift in ((1, 26), (9, 23), (73, 20), (585, 17), (4681, 14)):
        parts.append(F.sequence((F.shiftright(start, shift) + offset).cast("long"), (F.shiftright(last, shift) + offset).cast("long")))
    return F.concat(*parts)


def allele_call(base: Column, ref: Column, alt: Column) -> Column:
    return F.when(base == ref, F.lit(REF)).when(base == alt, F.lit(ALT)).otherwise(F.lit(OTHER))


def best_quality(qual: Column) -> Column:
    """Aggregate: the largest quality; a missing one (255) yields to any other."""
    return F.coalesce(F.max(F.nullif(qual, F.lit(MISSING_QUAL))), F.lit(MISSING_QUAL))


def log_sum_exp(columns: list[Column]) -> Column:
    top = F.greatest(*columns) if len(columns) > 1 else columns[0]
    total = None
    for c in columns:
        e = F.exp(c - top)
        total = e if total is None else total + e
    return F.when(top == float("-inf"), F.lit(float("-inf"))).otherwise(top + F.ln(total))


def dosage_from_alleles(alleles: Column) -> Column:
    """The mean allele index; null if any allele is missing or there is none."""
    whole = (F.size(alleles) > 0) & ~F.exists(alleles, lambda a: a.isNull() | (a < 0))
    return F.when(whole, F.aggregate(alleles, F.lit(0.0), lambda s, a: s + a) / F.size(alleles))


def dosage_from_probabilities(gp: Column) -> Column:
    """The mean allele of 3 genotype probabilities, half their weighted sum; of 1, itself; else null."""
    three = (gp[1] + 2 * gp[2]) / 2
    return F.when(F.size(gp) == 3, three).when(F.size(gp) == 1, gp[0])


def format_significant(x: Column, digits: int) -> Column:
    """%.{digits}g, and NA for null and NaN."""
    return F.when(x.isNull() | F.isnan(x.cast("double")), F.lit("NA")).otherwise(_general(x.cast("double"), digits))


def _general(x: Column, digits: int) -> Column:
    """C's %g: fixed or scientific, without trailing zeros."""
    sci = F.format_string(f"%.{digits - 1}e", x)
    exponent = F.regexp_extract(sci, "e([+-][0-9]+)$", 1).cast("int")
    trim = lambda s: F.when(F.contains(s, F.lit(".")), F.regexp_replace(s, r"\.?0+$", "")).otherwise(s)
    fixed = None
    for e in range(-4, digits):
        text = F.format_string(f"%.{digits - 1 - e}f", x)
        fixed = F.when(exponent == e, text) if fixed is None else fixed.when(exponent == e, text)
    scientific = F.concat(trim(F.regexp_extract(sci, "^(.*)e", 1)), F.regexp_extract(sci, "(e.*)$", 1))
    return F.when(x == 0, F.lit("0")).when((exponent >= -4) & (exponent < digits), trim(fixed)).otherwise(scientific)
