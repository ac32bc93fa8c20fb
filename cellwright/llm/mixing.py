"""Mixing sources to target weights by subset-sum budget fitting.

The size of a document is its number of words.  Sources, in code point order
with null last, weigh 3, 1, 2, 3, 1, 2, ... and share ``share`` times all
words; no target exceeds ``most`` times its source's size, and what is cut off
is shared again by weight (water filling).

A source takes every document floor(target / size) times.  The rest of its
budget is fitted from a histogram of document sizes: an even share of each
size first, then large single sizes, and what is left, at most ``window``
words, by a bounded knapsack over the sizes still at hand.  Which documents of
a size are taken again is decided by a seeded hash: sizes are cut into 4096
hash parts, whole parts are taken by a prefix sum, and only the part at the
border is ranked.  So no task holds all documents of a source or of a size.

Nulls and empty texts: null texts and texts without words have size 0 and are
taken 0 words; null sources form one source, null ids are ids like others.  A
source without words has target 0.  Very long texts are counted in Spark, and only
sizes reach the knapsack, which holds four bytes for each word of the budget that
is left.  Ties: documents of one size are ranked by hash, then id, then the hash of
their other columns.  Identical repeated rows are separate documents; which of
them is repeated is no matter.  An empty table gives an empty result.  ``mixed``
keeps all columns of docs, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._base import Own, Scratch, content, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)


def fit(budget: int, sizes: Sequence[int], counts: Sequence[int], window: int = 1 << 16) -> list[int]:
    """How many documents of each size to take so that their words come to budget.

    Never more than the budget; exact wherever the knapsack reaches it.  Where an
    even share of each size leaves it short, the knapsack alone fits a budget of at
    most 2 ** 24 words and 2 ** 33 bit operations: as near as any choice can come.
    """
    whole = sum(s * c for s, c in zip(sizes, counts, strict=True))
    if budget >= whole:
        return list(counts)
    words = lambda take: sum(s * t for s, t in zip(sizes, take, strict=True))
    take = _knapsack(budget, sizes, counts, [budget * c // whole for c in counts], window)
    if words(take) < budget <= 1 << 24 and budget * sum(c.bit_length() for c in counts) <= 1 << 33:
        take = max(take, _knapsack(budget, sizes, counts, [0] * len(sizes), budget), key=words)
    return take


def _knapsack(budget: int, sizes: Sequence[int], counts: Sequence[int], share: list[int], window: int) -> list[int]:
    """share of the counts, and what more brings their words nearest to the budget from below."""
    take = list(share)
    rest = budget - sum(s * t for s, t in zip(sizes, take, strict=True))
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    for i in order:
        if rest <= window:
            break
        more = min(counts[i] - take[i], max(0, (rest - window // 2) // sizes[i]))
        take[i] += more
        rest -= more * sizes[i]
    # Bit b of reached: b words can be made up; step_of[b]: the step that first did.  Counts are split into powers of two.
    reached, steps, limit = 1, [], (1 << rest + 1) - 1
    step_of = np.full(rest + 1, -1, np.int32)
    for i in order:
        left, n = min(counts[i] - take[i], rest // sizes[i]), 1
        while left > 0 and not reached >> rest & 1:
            n = min(n, left)
            new = reached << n * sizes[i] & limit & ~reached
            if new:
                bits = np.frombuffer(new.to_bytes(rest // 8 + 1, "little"), np.uint8)
                some = np.flatnonzero(bits)
                at, bit = np.nonzero(np.unpackbits(bits[some, None], axis=1, bitorder="little"))
                step_of[some[at] * 8 + bit] = len(steps)
                steps.append((i, n))
                reached |= new
            left, n = left - n, 2 * n
    at = reached.bit_length() - 1
    while at:
        i, n = steps[step_of[at]]
        take[i] += n
        at -= n * sizes[i]
    return take


def targets(sizes: DataFrame, share: float, most: float) -> DataFrame:
    """Source table (key, source, source_size) with each source's target.

    One row per source goes through single-partition windows here.
    """
    everything = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(everything.orderBy(F.col("source").isNull(), "source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), F.pmod(rank - 1, F.lit(len(WEIGHTS))) + 1)
    w = sizes.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    by = everything.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    w = w.withColumn("level", (share * F.sum("source_size").over(everything) - before) / after).withColumn("place", F.row_number().over(by))
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place", "level"))).over(everything)["level"]
    return w.withColumn("level", first).select("key", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), "cap")).alias("target"))


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, seed: int = 7, window: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row of docs: doc_id, mark, size, source_size, target, copies, taken.

    mark is a hash of id, text and source; it tells which row is meant.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    source = F.col(source_col).cast("string")
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(F.lit(seed), F.col(id_col), text_col, source_col).alias("mark"),
        source.alias("source"),
        F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source)).alias("key"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    narrow = scratch.table(narrow.withColumn("part", F.shiftrightunsigned("mark", 52)), "sizes")
    sources = targets(narrow.groupBy("key", "source").agg(F.sum("size").alias("source_size")), share, most)
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = sources.withColumn("times", times).withColumn("rest", F.round(F.col("target") - F.col("times") * F.col("source_size")).cast("long"))
    sources = scratch.table(sources, "sources")

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size")
        take = fit(int(rows["rest"].iloc[0]), rows["size"].tolist(), rows["n"].tolist(), window)
        return pd.DataFrame({"key": rows["key"], "size": rows["size"], "take": take})

    sized = narrow.where("size > 0")
    counts = sized.groupBy("key", "size").agg(F.count("*").alias("n")).join(sources.select("key", "rest"), "key")
    take = counts.groupBy("key").applyInPandas(fitted, "key string, size long, take long").where("take > 0")
    parts = sized.groupBy("key", "size", "part").agg(F.count("*").alias("n")).join(take, ["key", "size"])
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("key", "size", "part", (F.col("take") - before).alias("upto")).where("upto > 0")
    rank = F.row_number().over(Window.partitionBy("key", "size", "part").orderBy("mark", "doc_id"))
    got = narrow.join(parts, ["key", "size", "part"], "left").withColumn("more", F.coalesce((rank <= F.col("upto")).cast("long"), F.lit(0)))
    got = got.join(sources, "key").withColumn("copies", F.when(F.col("size") > 0, F.col("times") + F.col("more")).otherwise(0))
    return got.select("doc_id", "mark", "size", "source_size", F.col("target").cast("double").alias("target"), "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of docs, each as many times as the mix takes it."""
    own = Own(docs)
    names = [own.name(c) for c in (id_col, text_col, source_col)]
    copies = mix(own.df, id_col=names[0], text_col=names[1], source_col=names[2], **options).where("copies > 0")
    # Equal rows have one mark; the k-th of them meets the k-th answer.
    k = F.row_number().over(Window.partitionBy("doc_id", "mark").orderBy(F.desc("copies")))
    copies = copies.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__m"), k.alias("__n"), F.col("copies").cast("int").alias("__copies"))
    rows = own.df.withColumn("__mark", F.xxhash64(F.lit(options.get("seed", 7)), *names))
    rows = rows.withColumn("__k", F.row_number().over(Window.partitionBy(names[0], "__mark").orderBy(content(own.df))))
    on = F.col(names[0]).eqNullSafe(F.col("__id")) & (F.col("__mark") == F.col("__m")) & (F.col("__k") == F.col("__n"))
    return own.back(rows.join(copies, on).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: 150 % of their words, no source over twice its size."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
