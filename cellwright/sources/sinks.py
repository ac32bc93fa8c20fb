"""Writers of the count matrices, feature tables and model results.

Rows are written by Spark, sorted over partitions: the parts of a folder, in
order of their names, are the file, and gzip parts may be put one after the other
as they are.  Header lines come first by their place in the sort, so no file is
touched twice.  ``single`` gathers a file to one part, in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import format_significant


def text_file(lines: DataFrame, path: str, order: list[str], header: list[str] | None = None, compress: bool = True, single: bool = False) -> None:
    """Write column ``line`` in the given order as a text file (a folder of ordered parts; one if single)."""
    lines = lines.select(F.lit(1).alias("__h"), *[F.col(c).alias(f"__o{k}") for k, c in enumerate(order)], "line")
    if header:
        types = dict(lines.dtypes)
        top = lines.sparkSession.createDataFrame([(k, h) for k, h in enumerate(header)], "k int, line string")
        top = top.select(F.lit(0).alias("__h"), *[F.when(F.lit(k == 0), F.col("k")).cast(types[f"__o{k}"]).alias(f"__o{k}") if k == 0 and types[f"__o{k}"] != "string" else F.when(F.lit(k == 0), F.lpad(F.col("k").cast("string"), 4, "0")).cast(types[f"__o{k}"]).alias(f"__o{k}") for k in range(len(order))], "line")
        lines = top.unionByName(lines)
    ordered = lines.orderBy("__h", *[f"__o{k}" for k in range(len(order))]).select("line")
    (ordered.coalesce(1) if single else ordered).write.mode("overwrite").option("compression", "gzip" if compress else "none").text(path)


def table(df: DataFrame, path: str, columns: list[Column | str], order: list[str], header: list[str] | None = None, compress: bool = True) -> None:
    """Tab-separated columns (nulls as NA)."""
    cells = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("NA")) for c in columns]
    text_file(df.select(*order, F.concat_ws("\t", *cells).alias("line")), path, order, header, compress)


def matrix(counts: DataFrame, path: str, row: str, column: str, value: str, rows: int, columns: int, kind: str = "integer") -> None:
    """A MatrixMarket file of counts with indices from 0; explicit zeros are written."""
    n = counts.count()
    line = F.concat_ws(" ", (F.col(row) + 1).cast("string"), (F.col(column) + 1).cast("string"), F.col(value).cast("string"))
    head = [f"%%MatrixMarket matrix coordinate {kind} general", "%", f"{rows} {columns} {n}"]
    text_file(counts.select(row, column, line.alias("line")), path, [column, row], head)


def matrices(counts: DataFrame, prefix: str, names: list[str], row: str, column: str, rows: int, columns: int) -> None:
    """One file <prefix>.<name>.mtx.gz for each count column; all share the cells of counts."""
    for name in names:
        matrix(counts, f"{prefix}.{name}.mtx.gz", row, column, name, rows, columns)


def dense(df: DataFrame, path: str, name: str, array: str, header: list[str] | None = None, digits: int = 8) -> None:
    """Row names and an array of numbers, %.{digits}g."""
    cells = F.transform(array, lambda x: format_significant(x, digits))
    text_file(df.select(name, F.concat(F.col(name), F.lit("\t"), F.array_join(cells, "\t")).alias("line")), path, [name], header)


def genes(df: DataFrame, path: str) -> None:
    table(df, path, ["chrom", F.col("start") + 1, "end", "strand", "gene_type", "gene_name", "gene_id"], ["gene_ix"])


def variants(df: DataFrame, path: str) -> None:
    table(df, path, ["chrom", F.col("pos") + 1, "id", "ref", "alt"], ["vix"])


def peaks(df: DataFrame, path: str) -> None:
    table(df, path, ["chrom", "start", "end"], ["ix"])


def barcodes(df: DataFrame, path: str) -> None:
    table(df, path, ["barcode"], ["ix"])
