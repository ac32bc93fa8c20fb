"""BAM and SAM text as DataFrames.

``read_bam`` is a Python data source with one input partition per file and
contig group.  A BAM file is a chain of BGZF blocks; each partition walks the
blocks' headers, inflates one block at a time and yields Arrow batches, so its
memory is that of a block and a batch.  With an index (.bai beside the file) a
partition starts at the first block of its contig; without one there is one
partition a file.  Tags other than the barcode's, UMI's and hit count's are skipped.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..schemas import ALIGNMENTS

# Fixed values of the format: operation and base letters by code.
OPS = "MIDNSHP=X"
BASES = "=ACMGRSVTWYHKDBN"
_PAIRS = [BASES[b >> 4] + BASES[b & 15] for b in range(256)]
_TAG_SIZE = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_TAG_CODE = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I"}


class Blocks:
    """The inflated bytes of a BGZF file from a virtual offset."""

    def __init__(self, path: str, voffset: int = 0):
        self.file = open(path, "rb")  # noqa: SIM115
        self.file.seek(voffset >> 16)
        self.data, self.at = b"", 0
        self.block = voffset >> 16
        if voffset & 0xFFFF:
            self._next()
            self.at = voffset & 0xFFFF

    def _next(self) -> bool:
        self.block = self.file.tell()
        head = self.file.read(18)
        if len(head) < 18:
            return False
        if head[:4] != b"\x1f\x8b\x08\x04":
            raise ValueError("not a BGZF block")
        extra = struct.unpack_from("<H", head, 10)[0]
        fields = head[12:18] + self.file.read(max(0, extra - 6))
        at, size = 0, None
        while at + 4 <= extra:
            length = struct.unpack_from("<H", fields, at + 2)[0]
            if fields[at : at + 2] == b"BC":
                size = struct.unpack_from("<H", fields, at + 4)[0] + 1
            at += 4 + length
        if size is None:
            raise ValueError("a block without its size")
        body = self.file.read(size - 12 - extra)
        self.data, self.at = zlib.decompress(body[:-8], -15), 0
        return True

    def read(self, n: int) -> bytes:
        parts = []
        while n > 0:
            if self.at == len(self.data):
                if not self._next():
                    break
                continue
            part = self.data[self.at : self.at + n]
            self.at += len(part)
            n -= len(part)
            parts.append(part)
        return b"".join(parts)

    def close(self) -> None:
        self.file.close()


def read_header(blocks: Blocks) -> list[tuple[str, int]]:
    """Contigs (name, length) in order."""
    if blocks.read(4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    blocks.read(struct.unpack("<i", blocks.read(4))[0])
    out = []
    for _ in range(struct.unpack("<i", blocks.read(4))[0]):
        name = blocks.read(struct.unpack("<i", blocks.read(4))[0])[:-1].decode()
        out.append((name, struct.unpack("<i", blocks.read(4))[0]))
    return out


def _tags(data: bytes, at: int) -> Iterator[tuple[str, object]]:
    while at + 3 <= len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(0, at)
            yield name, data[at:end].decode()
            at = end + 1
        elif kind == "B":
            count = struct.unpack_from("<i", data, at + 1)[0]
            at += 5 + count * _TAG_SIZE[chr(data[at])]
        else:
            if kind in _TAG_CODE:
                yield name, struct.unpack_from(_TAG_CODE[kind], data, at)[0]
            elif kind == "A":
                yield name, chr(data[at])
            at += _TAG_SIZE[kind]


def decode(data: bytes, contigs: list[tuple[str, int]], cb: str, ub: str, nh: str, seqno: int) -> tuple:
    """A row of schemas.ALIGNMENTS from a record's bytes."""
    tid, pos, l_name, mapq, _, n_cigar, flag, l_seq = struct.unpack_from("<iiBBHHHi", data)
    at = 32
    name = data[at : at + l_name - 1].decode()
    at += l_name
    codes = struct.unpack_from(f"<{n_cigar}I", data, at)
    cigar = [{"op": OPS[c & 15], "len": c >> 4} for c in codes]
    at += 4 * n_cigar
    seq = "".join(_PAIRS[b] for b in data[at : at + (l_seq + 1) // 2])[:l_seq]
    at += (l_seq + 1) // 2
    qual = list(data[at : at + l_seq])
    tags = dict(_tags(data, at + l_seq))
    number = tags.get(nh)
    text = lambda t: str(tags[t]) if t in tags else None
    return name, flag, contigs[tid][0] if tid >= 0 else None, pos, mapq, cigar, seq, qual, text(cb), text(ub), int(number) if number is not None else None, seqno


def index_starts(path: str) -> list[int | None]:
    """From a .bai index, the least virtual offset of each contig's records."""
    with open(path, "rb") as f:
        data = f.read()
    if data[:4] != b"BAI\x01":
        raise ValueError("not a BAI index")
    at, out = 8, []
    for _ in range(struct.unpack_from("<i", data, 4)[0]):
        least = None
        bins = struct.unpack_from("<i", data, at)[0]
        at += 4
        for _ in range(bins):
            number, chunks = struct.unpack_from("<Ii", data, at)
            at += 8
            for k in range(chunks):
                begin = struct.unpack_from("<Q", data, at + 16 * k)[0]
                if number != 37450 and (least is None or begin < least):
                    least = begin
            at += 16 * chunks
        at += 4 + 8 * struct.unpack_from("<i", data, at)[0]
        out.append(least)
    return out


class _Part(InputPartition):
    def __init__(self, path: str, voffset: int | None, tid: int | None):
        self.path, self.voffset, self.tid = path, voffset, tid


class BamReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.paths = [p for p in options["path"].split(",") if p]
        self.tags = [options.get(k, d) for k, d in (("cb", "CB"), ("ub", "UB"), ("nh", "NH"))]
        self.require_index = options.get("requireindex", "false").lower() == "true"
        self.schema = schema

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in self.paths:
            path = path.removeprefix("file://")
            index = next((p for p in (f"{path}.bai", path.removesuffix(".bam") + ".bai") if os.path.exists(p)), None)
            if index is None:
                if self.require_index:
                    raise FileNotFoundError(f"{path} has no index")
                out.append(_Part(path, None, None))
                continue
            out += [_Part(path, start, tid) for tid, start in enumerate(index_starts(index)) if start is not None]
        return out

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        blocks = Blocks(partition.path)
        contigs = read_header(blocks)
        if partition.voffset is not None:
            blocks.close()
            blocks = Blocks(partition.path, partition.voffset)
        rows, number = [], (partition.tid or 0) << 40
        while len(head := blocks.read(4)) == 4:
            data = blocks.read(struct.unpack("<i", head)[0])
            tid = struct.unpack_from("<i", data)[0]
            if partition.tid is not None and tid != partition.tid:
                break
            rows.append(decode(data, contigs, *self.tags, number))
            number += 1
            if len(rows) == 4096:
                yield self._batch(rows, schema)
                rows = []
        blocks.close()
        if rows:
            yield self._batch(rows, schema)

    @staticmethod
    def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


class BamSource(DataSource):
    """Format ``bam``; options path (comma-separated), cb, ub, nh, requireindex."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return ALIGNMENTS

    def reader(self, schema: StructType) -> BamReader:
        return BamReader(self.options, schema)


def read_bam(spark: SparkSession, path: str, cb: str = "CB", ub: str = "UB", nh: str = "NH", require_index: bool = False) -> DataFrame:
    spark.dataSource.register(BamSource)
    return spark.read.format("bam").options(path=path, cb=cb, ub=ub, nh=nh, requireindex=str(require_index)).load()


def read_sam(spark: SparkSession, path: str, cb: str = "CB", ub: str = "UB", nh: str = "NH") -> DataFrame:
    """SAM text: splittable, with column functions only.  seqno orders rows within a file's parts."""
    lines = spark.read.text(path).where(~F.col("value").startswith("@"))
    f = F.split("value", "\t")
    tag = lambda t: F.nullif(F.regexp_extract("value", f"\t{t}:[A-Za-z]:([^\t]*)", 1), F.lit(""))
    ops = F.transform(F.regexp_extract_all(f[5], F.lit("([0-9]+)([MIDNSHP=X])"), F.lit(0)), lambda x: F.struct(F.regexp_extract(x, "[A-Z=]", 0).alias("op"), F.regexp_extract(x, "[0-9]+", 0).cast("int").alias("len")))
    qual = F.when(f[10] == "*", F.transform(F.sequence(F.lit(1), F.length(f[9])), lambda _: F.lit(255))).otherwise(F.transform(F.split(f[10], ""), lambda c: F.ascii(c) - 33))
    return lines.select(
        f[0].alias("qname"), f[1].cast("int").alias("flag"), F.nullif(f[2], F.lit("*")).alias("chrom"), (f[3].cast("int") - 1).alias("pos"), f[4].cast("int").alias("mapq"),
        ops.alias("cigar"), f[9].alias("seq"), qual.alias("qual"), tag(cb).alias("cb"), tag(ub).alias("ub"), tag(nh).cast("int").alias("nh"), F.monotonically_increasing_id().alias("seqno"),
    )


def read_alignments(spark: SparkSession, path: str, cb: str = "CB", ub: str = "UB", nh: str = "NH") -> DataFrame:
    """By the path's ending: .bam, .sam, else Parquet of schemas.ALIGNMENTS (the fast path)."""
    if path.endswith(".bam"):
        return read_bam(spark, path, cb, ub, nh)
    if path.endswith((".sam", ".sam.gz")):
        return read_sam(spark, path, cb, ub, nh)
    return spark.read.parquet(path)
