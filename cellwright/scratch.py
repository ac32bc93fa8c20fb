"""Tables written in the shared folder to cut lineage.

A written table survives the loss of an executor, unlike a cached or locally
checkpointed one.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_scopes: list[list[Scratch]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Where it is unset, a local master (tests) gets a temporary folder, which the
    session remembers; on a cluster, executors would each write to a disk of
    their own, so it is an error there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("cellwright.scratch.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="cellwright-")
        spark.conf.set("cellwright.scratch.dir", found)
    return found.rstrip("/")


class Scratch:
    """A folder of tables for one run of an operator."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
        if _scopes:
            _scopes[-1].append(self)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and return it as read back."""
        out = f"{self.path}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(out)
        return self.spark.read.schema(df.schema).parquet(out)

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads; the whole folder without names."""
        jvm = self.spark._jvm
        for name in names or ("",):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
            with contextlib.suppress(Exception):  # a leftover costs disk, never results
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def dropped_after() -> Iterator[None]:
    """Delete, at the end, the folders that operators make inside.

    For whoever writes the operators' results to a place of their own first.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for made in _scopes.pop():
            made.drop()
