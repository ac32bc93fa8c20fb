"""Interval joins by bins.

A plain overlap condition plans as a nested loop.  Here both sides get bins of
``width`` bases, the join is an equi-join on contig and bin, and the condition
``bin = first bin that both have`` lets each pair through once, so no distinct
follows.  Intervals of the right side that span many bins go to a coarser level
(16 times the width, and so on), so none is in more than 17 bins.  Spark picks
broadcast or shuffle by the sizes it sees, and splits skewed bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import overlap_length

WIDTH = 16_384


def _div(x: Column, width: int) -> Column:
    return F.floor(x / width)


def overlap_join(left: DataFrame, right: DataFrame, width: int = WIDTH, levels: int = 1, stranded: bool = False, min_fraction: float | None = None, chrom: str = "chrom", start: str = "start", end: str = "end", strand: str = "strand") -> DataFrame:
    """All pairs of overlapping intervals [start, end) of one contig.

    The right side's columns get the prefix r_.  ``overlap`` is the number of
    shared bases.  stranded drops pairs on opposite strands.  min_fraction keeps
    pairs that share that part of the left interval (1: contained).  Empty
    intervals overlap nothing.
    """
    right = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    a1, a2, b1, b2 = F.col(start), F.col(end), F.col(f"r_{start}"), F.col(f"r_{end}")
    level = F.lit(0)
    for k in range(1, levels):
        level = F.when(_div(b2 - 1, width * 16 ** (k - 1)) - _div(b1, width * 16 ** (k - 1)) >= 16, F.lit(k)).otherwise(level)
    scale = F.element_at(F.array(*[F.lit(width * 16**k) for k in range(levels)]), level + 1)
    right = right.where(b2 > b1).withColumn("__level", level)
    right = right.withColumn("__bin", F.explode(F.sequence(F.floor(b1 / scale), F.floor((b2 - 1) / scale))))
    numbered = lambda k: lambda b: F.struct(F.lit(k).alias("level"), b.alias("bin"))
    bins = [F.transform(F.sequence(_div(a1, width * 16**k), _div(a2 - 1, width * 16**k)), numbered(k)) for k in range(levels)]
    left = left.where(a2 > a1).withColumn("__at", F.explode(F.concat(*bins) if levels > 1 else bins[0]))
    first = F.greatest(F.floor(a1 / scale), F.floor(b1 / scale))
    on = (F.col(chrom) == F.col(f"r_{chrom}")) & (F.col("__at.level") == F.col("__level")) & (F.col("__at.bin") == F.col("__bin")) & (a1 < b2) & (b1 < a2) & (F.col("__bin") == first)
    got = left.join(right, on).drop("__at", "__bin", "__level")
    got = got.withColumn("overlap", overlap_length(a1, a2, F.col(strand) if stranded else None, b1, b2, F.col(f"r_{strand}") if stranded else None))
    if stranded:
        got = got.where("overlap > 0")
    if min_fraction is not None:
        got = got.where(F.col("overlap") >= min_fraction * (a2 - a1))
    return got


def overlap_filter(left: DataFrame, right: DataFrame, keep: bool, longest: int = WIDTH, chrom: str = "chrom", start: str = "start", end: str = "end") -> DataFrame:
    """The left rows that overlap some right interval (keep), or none.

    A left interval of at most ``longest`` bases is known by the bin of its start:
    the right side covers the bins of all starts that can reach it.  Longer ones
    are known by wider bins in the same way, 16 times the width at each level, up
    to the length of any 32-bit interval; a longer one is an error.  So the left
    rows are neither exploded nor numbered, and one semi or anti join on contig,
    level and bin does.
    """
    a1, a2, b1, b2 = F.col(start), F.col(end), F.col("__b1"), F.col("__b2")
    widths = [longest]
    while widths[-1] < 1 << 32:
        widths.append(widths[-1] * 16)
    right = right.select(F.col(chrom).alias("__chrom"), F.col(start).alias("__b1"), F.col(end).alias("__b2")).where(b2 > b1)
    numbered = lambda k: lambda b: F.struct(F.lit(k).alias("level"), b.alias("bin"))
    bins = [F.transform(F.sequence(_div(b1 - w, w), _div(b2 - 1, w)), numbered(k)) for k, w in enumerate(widths)]
    binned = right.withColumn("__at", F.explode(F.concat(*bins)))
    level = place = None
    for k, w in enumerate(widths):
        fits = a2 - a1 <= w
        level = F.when(fits, F.lit(k)) if k == 0 else level.when(fits, F.lit(k))
        place = F.when(fits, _div(a1, w)) if k == 0 else place.when(fits, _div(a1, w))
    too_long = F.when(a2 - a1 > widths[-1], F.raise_error(F.lit("an interval is longer than 32-bit coordinates allow")).cast("int"))
    meets = (F.col(chrom) == F.col("__chrom")) & (a1 < b2) & (b1 < a2) & (a2 > a1)
    on = meets & (level.otherwise(too_long) == F.col("__at.level")) & (place == F.col("__at.bin"))
    return left.join(binned, on, "left_semi" if keep else "left_anti")


def point_join(points: DataFrame, right: DataFrame, at: str, width: int = WIDTH, chrom: str = "chrom", start: str = "start", end: str = "end") -> DataFrame:
    """Pairs of a point and an interval with start <= point < end; only intervals are exploded."""
    right = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]).where(F.col(f"r_{end}") > F.col(f"r_{start}"))
    right = right.withColumn("__bin", F.explode(F.sequence(_div(F.col(f"r_{start}"), width), _div(F.col(f"r_{end}") - 1, width))))
    inside = (F.col(at) >= F.col(f"r_{start}")) & (F.col(at) < F.col(f"r_{end}"))
    return points.join(right, (F.col(chrom) == F.col(f"r_{chrom}")) & (_div(F.col(at), width) == F.col("__bin")) & inside).drop("__bin")


def cut_sites(fragments: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Two rows a fragment: its cut sites, start + 4 and end - 6 (column cut, number cut_no)."""
    return fragments.select("*", F.posexplode(F.array(F.col(start) + 4, F.col(end) - 1 - 5)).alias("cut_no", "cut"))


def cut_site_peaks(fragments: DataFrame, peaks: DataFrame, parity: bool = True, width: int = WIDTH) -> DataFrame:
    """A row for each cut site in a peak.  With parity a peak's last base takes none."""
    if parity:
        peaks = peaks.withColumn("end", F.col("end") - 1)
    got = point_join(cut_sites(fragments), peaks, "cut", width)
    return got.withColumn("r_end", F.col("r_end") + 1) if parity else got


def merge_touching(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", width: int | None = None) -> DataFrame:
    """Unions of overlapping or touching intervals within each key, with the number merged (n).

    Rows without start or end are left out.  Without width a key's rows are one
    task: right for keys with few rows each, as transcripts.  With width, for keys
    as contigs, a task gets the rows of a key that start in one bin of so many
    bases; how far the bins before reach, and where their last union begins,
    come from a running maximum over one row a bin.
    """
    df = df.where(F.col(start).isNotNull() & F.col(end).isNotNull())
    if width is None:
        order = Window.partitionBy(*keys).orderBy(start, end)
        reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
        marked = df.withColumn("__first", F.when(reach.isNull() | (F.col(start) > reach), F.col(start)))
        return _unions(marked.withColumn("__first", F.max("__first").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))), keys, start, end)
    binned = df.withColumn("__bin", _div(F.col(start), width))
    in_bin = Window.partitionBy(*keys, "__bin").orderBy(start, end)
    before = in_bin.rowsBetween(Window.unboundedPreceding, -1)
    ends = _carried(binned.groupBy(*keys, "__bin").agg(F.max(end).alias("__end")), keys, "__end", "__reach")
    reach = F.greatest(F.col("__reach"), F.max(end).over(before))
    marked = _by_bin(binned, ends, keys).withColumn("__first", F.when(reach.isNull() | (F.col(start) > reach), F.col(start)))
    firsts = _carried(marked.groupBy(*keys, "__bin").agg(F.max("__first").alias("__last")), keys, "__last", "__open")
    own = F.max("__first").over(in_bin.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return _unions(_by_bin(marked.withColumn("__own", own), firsts, keys).withColumn("__first", F.coalesce("__own", "__open")), keys, start, end)


def _carried(bins: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """For each bin of a key the largest value of the bins before it."""
    earlier = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    return bins.select(*keys, "__bin", F.max(value).over(earlier).alias(name))


def _by_bin(df: DataFrame, bins: DataFrame, keys: list[str]) -> DataFrame:
    """df with the columns of its bin; null keys are equal."""
    names = [*keys, "__bin"]
    bins = bins.withColumnsRenamed({c: f"__r{k}" for k, c in enumerate(names)})
    on = F.lit(True)
    for k, c in enumerate(names):
        on = on & F.col(c).eqNullSafe(F.col(f"__r{k}"))
    return df.join(bins, on).drop(*[f"__r{k}" for k in range(len(names))])


def _unions(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """A row for each start of a union (column __first)."""
    return df.groupBy(*keys, "__first").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("__first")
