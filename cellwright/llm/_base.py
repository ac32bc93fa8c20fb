"""Shared plumbing: the scratch area, Arrow mapping and column helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch, dropped_after, shared_dir

__all__ = ["Own", "Scratch", "arrow_map", "content", "dropped_after", "partitions", "quoted", "shared_dir", "sliced", "table", "utf8", "with_hot"]

#: Rows and bytes of a batch that Python works on at once.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


class Own:
    """A DataFrame's own columns under names that no operator uses (own0, own1, ...).

    Operators work on ``df``, to which they may add columns of any other name,
    and ``back`` gives the own columns their names again.
    """

    def __init__(self, df: DataFrame, replaced: Iterable[str] = ()):
        """replaced: names of columns that the operator will add; df loses its columns of these names."""
        gone = {n.lower() for n in replaced}
        self.names = [c for c in df.columns if c.lower() not in gone]
        self.df = df.select(*[F.col(quoted(c)).alias(f"own{k}") for k, c in enumerate(self.names)])

    def name(self, column: str) -> str:
        """What a column is called in ``df``."""
        lower = [c.lower() for c in self.names]
        return f"own{self.names.index(column) if column in self.names else lower.index(column.lower())}"

    def __getitem__(self, column: str) -> Column:
        return F.col(self.name(column))

    def back(self, df: DataFrame, *more: Column | str) -> DataFrame:
        """df's own columns by their names, and more columns."""
        return df.select(*[F.col(f"own{k}").alias(c) for k, c in enumerate(self.names)], *more)


def content(df: DataFrame) -> Column:
    """A hash of all columns that have one (all types but maps and variants)."""
    some = [f.name for f in df.schema if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    return F.xxhash64(F.lit(0), *[F.col(quoted(c)) for c in some])


def sliced(batch: pa.RecordBatch, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most so many rows and bytes (or a single longer row)."""
    if batch.num_rows <= 1 or batch.num_rows <= rows and batch.nbytes <= size:
        yield batch
        return
    half = batch.num_rows // 2
    for part in (batch.slice(0, half), batch.slice(half)):
        yield from sliced(part, rows, size)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch | None], schema) -> DataFrame:
    """mapInArrow with a function of one batch of bounded rows and bytes."""

    def run(batches):
        for whole in batches:
            for batch in sliced(whole):
                out = fn(batch)
                if out is None:
                    continue
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    return df.mapInArrow(run, schema)


def utf8(texts: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding."""
    return texts.cast(pa.binary()).to_pylist() if texts.type != pa.large_string() else texts.cast(pa.large_binary()).to_pylist()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_hot(rows: DataFrame, facts: DataFrame, key: str, *by: str) -> DataFrame:
    """Rows with the facts of their key (one row a key), of which one may hold a third of all rows.

    Facts go to up to 32 salted copies, of which a row meets one; by tells rows
    of a key apart.
    """
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*by), F.lit(32)))
    spread = salted.select(key, "__salt").distinct().join(facts, key)
    return salted.join(spread, [key, "__salt"]).drop("__salt")
