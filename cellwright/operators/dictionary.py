"""Dense indices from 0 in an explicit order.

A window over the whole table would put all rows in one task.  Instead the rows
are sorted over all partitions and written with their place in their partition;
the partitions' counts (one row each) give each one's first index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import Scratch


def dense_index(df: DataFrame, order: list[Column | str], out: str = "ix") -> DataFrame:
    """df with an index from 0 in the given order, which must be total."""
    placed = Scratch(df.sparkSession, "index").table(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("__at", 33)
    counts = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    first = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    got = placed.withColumn("__part", part).join(counts.select("__part", first.alias("__first")), "__part")
    return got.withColumn(out, F.col("__first") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__at", "__part", "__first")


def union_in_order(listed: DataFrame, observed: DataFrame, key: str, order: str) -> DataFrame:
    """A whitelist in its order, then what else was observed, by name: key, ix."""
    rest = observed.select(key).distinct().join(listed.select(key), key, "left_anti")
    both = listed.select(key, F.lit(0).alias("__source"), F.col(order).cast("long").alias("__order")).unionByName(rest.select(key, F.lit(1).alias("__source"), F.lit(0).cast("long").alias("__order")))
    return dense_index(both, ["__source", "__order", key]).select(key, "ix")
