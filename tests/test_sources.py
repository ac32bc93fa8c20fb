"""Readers and writers."""

import gzip
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from cellwright.sources import bam, sinks, text


def _block(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def _record(name, flag, tid, pos, mapq, cigar, seq, qual, tags):
    codes = struct.pack(f"<{len(cigar)}I", *[n << 4 | bam.OPS.index(o) for o, n in cigar])
    half = [bam.BASES.index(c) for c in seq] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(half[::2], half[1::2], strict=True))
    extra = b"".join(k.encode() + (b"Z" + v.encode() + b"\0" if isinstance(v, str) else b"C" + bytes([v])) for k, v in tags.items()) + b"XBBs" + struct.pack("<ihh", 2, -1, 5)
    body = struct.pack("<iiBBHHHiiii", tid, pos, len(name) + 1, mapq, 0, len(cigar), flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + codes + packed + bytes(qual) + extra
    return struct.pack("<i", len(body)) + body


ROWS = [
    ("r1", 0, 0, 10, 60, [("M", 4), ("N", 100), ("M", 3)], "ACGTNAC", [30] * 7, {"CB": "ACGT-1", "UB": "AAAA", "NH": 1}),
    ("r2", 16, 0, 20, 30, [("S", 2), ("M", 2)], "ACGT", [255] * 4, {"CB": "ACGT-1"}),
    ("r3", 0, 1, 5, 0, [("M", 5)], "AAAAA", [2] * 5, {}),
]


@pytest.fixture
def bam_file(tmp_path):
    contigs = [("chr1", 1000), ("chr2", 500)]
    head = b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", 2) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in contigs)
    first, data = _block(head), b"".join(_record(*r) for r in ROWS)
    starts = [sum(len(_record(*r)) for r in ROWS[:k]) for k in (0, 2)]
    cut = len(_record(*ROWS[0])) - 9  # a record across two blocks
    blocks = [_block(data[:cut]), _block(data[cut:])]
    (tmp_path / "x.bam").write_bytes(first + b"".join(blocks) + _block(b""))
    offsets = [len(first) << 16, (len(first) + len(blocks[0])) << 16 | (starts[1] - cut)]
    index = b"BAI\x01" + struct.pack("<i", 2) + b"".join(struct.pack("<i", 1) + struct.pack("<Ii", 4681, 1) + struct.pack("<QQ", o, o + 1) + struct.pack("<i", 0) for o in offsets)
    return tmp_path / "x.bam", index


def test_bam_with_and_without_index(spark, bam_file):
    path, index = bam_file
    expected = [(r[0], r[1], ["chr1", "chr2"][r[2]], r[3], r[4], r[5], r[6], r[7], r[8].get("CB"), r[8].get("UB"), r[8].get("NH")) for r in ROWS]
    for k in range(2):
        if k:
            (path.parent / "x.bam.bai").write_bytes(index)
        df = bam.read_bam(spark, str(path))
        assert df.rdd.getNumPartitions() == 1 + k
        got = [(r.qname, r.flag, r.chrom, r.pos, r.mapq, [(c.op, c.len) for c in r.cigar], r.seq, r.qual, r.cb, r.ub, r.nh) for r in df.orderBy("seqno").collect()]
        assert got == expected
    path.with_suffix(".bam.bai").unlink()
    with pytest.raises(Exception, match="no index"):
        bam.read_bam(spark, str(path), require_index=True).collect()


def test_sam_agrees(spark, tmp_path):
    lines = ["@HD\tVN:1.6"] + ["\t".join(map(str, [r[0], r[1], ["chr1", "chr2"][r[2]], r[3] + 1, r[4], "".join(f"{n}{o}" for o, n in r[5]), "*", 0, 0, r[6], "*" if r[7][0] == 255 else "".join(chr(q + 33) for q in r[7]), *[f"{k}:{'i' if isinstance(v, int) else 'Z'}:{v}" for k, v in r[8].items()]])) for r in ROWS]
    (tmp_path / "x.sam").write_text("\n".join(lines) + "\n")
    got = bam.read_alignments(spark, str(tmp_path / "x.sam")).orderBy("seqno").collect()
    assert [(r.qname, r.pos, [(c.op, c.len) for c in r.cigar], r.qual, r.cb, r.ub, r.nh) for r in got] == [(r[0], r[3], r[5], r[7], r[8].get("CB"), r[8].get("UB"), r[8].get("NH")) for r in ROWS]


VCF = """##fileformat=VCFv4.2
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\ts3
1\t11\tv0\tA\tG\t.\tfail\t.\tGT:GP\t0/1:0,1,0\t1|1:0,0,1\t0/0:1,0,0
1\t12\tv1\tAC\tG\t.\t.\t.\tGT\t0/1\t1/1\t0/0
1\t13\tv2\tA\tG,T\t.\t.\t.\tGT\t0/1\t1/1\t0/0
2\t5\tv3\tC\tT\t.\t.\t.\tGP:GT\t0.5:./1\t0.5,0.5:1\t.:0
"""


def test_vcf(spark, tmp_path):
    with gzip.open(tmp_path / "x.vcf.gz", "wt") as f:
        f.write(VCF)
    variants, cells = text.read_vcf(spark, str(tmp_path / "x.vcf.gz"), ["s2", "s1"])
    assert [tuple(r) for r in variants.orderBy("vix").collect()] == [(0, "1", 10, "v0", "A", "G"), (1, "2", 4, "v3", "C", "T")]
    assert {(r.vix, r.sample): r.dosage for r in cells.collect()} == {(0, "s1"): 0.5, (0, "s2"): 1.0, (1, "s1"): None, (1, "s2"): 1.0}
    gp = {(r.vix, r.sample): r.dosage for r in text.read_vcf(spark, str(tmp_path / "x.vcf.gz"), field="GP")[1].collect()}
    assert gp == {(0, "s1"): 0.5, (0, "s2"): 1.0, (0, "s3"): 0.0, (1, "s1"): 0.5, (1, "s2"): None, (1, "s3"): None}
    assert text.read_vcf(spark, str(tmp_path / "x.vcf.gz"), regions="2:1-9")[0].count() == 1
    with pytest.raises(ValueError, match="not in the file"):
        text.read_vcf(spark, str(tmp_path / "x.vcf.gz"), ["nobody"])


GTF = """#!genome
1\th\tgene\t1\t300\t.\t+\t.\tgene_id "g1"; gene_name "Name with space"; gene_type "protein_coding";
1\th\ttranscript\t1\t300\t.\t+\t.\tgene_id "g1"; transcript_id "t1"; tag "x"; tag "basic";
1\th\texon\t1\t90\t.\t+\t.\tgene_id "g1"; transcript_id "t1"; exon_id "e1"; tag "basic";
1\th\tutr\t91\t100\t.\t+\t.\tgene_id "g1"; transcript_id "t1"; tag "basic";
1\th\tUTR\t150\t160\t.\t+\t.\tgene_id "g1"; transcript_id "t1";
1\th\texon\t201\t300\t.\t+\t.\tgene_id "g1"; transcript_id "t1"; exon_id "e2"; tag "basic";
1\th\ttranscript\t1\t50\t.\t+\t.\tgene_id "g1"; transcript_id "t2";
"""


def test_gtf(spark, tmp_path):
    (tmp_path / "x.gtf").write_text(GTF)
    rows = text.read_gtf(spark, str(tmp_path / "x.gtf"))
    assert rows.count() == 7 and text.read_gtf(spark, str(tmp_path / "x.gtf"), basic_only=True).count() == 5
    genes, exons = text.annotation(rows)
    g = genes.first()
    assert (g.gene_id, g.gene_name, g.gene_type, g.start, g.end, g.strand, g.gene_ix) == ("g1", "Name with space", "protein_coding", 0, 300, "+", 0)
    assert [[tuple(e) for e in i] for i in g.isoforms] == [[(0, 100), (200, 300)]] and exons.count() == 2
    (tmp_path / "y.gtf").write_text(GTF.replace('transcript_id "t2"', 'transcript_id "t2"').replace('gene_id "g1"; transcript_id "t2"', 'gene_id "g9"; transcript_id "t2"'))
    with pytest.raises(ValueError, match="no gene"):
        text.annotation(text.read_gtf(spark, str(tmp_path / "y.gtf")))


def test_bed_lists_and_matrices(spark, tmp_path):
    (tmp_path / "p.bed").write_text("track x\n2\t5\t9\n1\t7\t8\tname\n1\t7\t8\n")
    assert [tuple(r) for r in text.read_bed(spark, str(tmp_path / "p.bed")).select("ix", "chrom", "start", "end").orderBy("ix").collect()] == [(0, "1", 7, 8), (1, "2", 5, 9)]
    (tmp_path / "l.txt").write_text("b\n\na\n")
    assert [r[0] for r in text.read_list(spark, str(tmp_path / "l.txt")).orderBy("place").collect()] == ["b", "a"]
    (tmp_path / "l.txt").write_text("b\nb\n")
    with pytest.raises(ValueError, match="twice"):
        text.read_list(spark, str(tmp_path / "l.txt"))
    (tmp_path / "m.txt").write_text("\tx\ty\nr1\t1\t2.5\nr2\t3\t4\n")
    names, rows = text.read_matrix(spark, str(tmp_path / "m.txt"))
    assert names == ["x", "y"] and [tuple(r) for r in rows.collect()] == [("r1", [1, 2.5]), ("r2", [3, 4])]
    (tmp_path / "m.txt").write_text("\tx\ty\nr1\t1\n")
    with pytest.raises(Exception, match="another number"):
        text.read_matrix(spark, str(tmp_path / "m.txt"))[1].collect()


def read_text(path):
    files = sorted(path.glob("part-*"))
    return [line for f in files for line in (gzip.open(f, "rt") if f.suffix == ".gz" else open(f)).read().splitlines()]


def test_matrix_and_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 5), (0, 1, 0), (0, 0, 7)], "r long, c long, n long").repartition(3)
    sinks.matrix(df, str(tmp_path / "m.mtx.gz"), "r", "c", "n", 2, 2)
    assert read_text(tmp_path / "m.mtx.gz") == ["%%MatrixMarket matrix coordinate integer general", "%", "2 2 3", "1 1 7", "2 1 5", "1 2 0"]
    sinks.table(df.withColumn("x", F.lit(None).cast("string")), str(tmp_path / "t.txt"), ["r", F.col("n") + 1, "x"], ["n"], ["r\tn\tx"], compress=False)
    assert read_text(tmp_path / "t.txt") == ["r\tn\tx", "0\t1\tNA", "1\t6\tNA", "0\t8\tNA"]
    rows = spark.createDataFrame([("b", [0.5, float("nan")]), ("a", [1e-9, 3.0])], "name string, v array<double>")
    sinks.dense(rows, str(tmp_path / "d.txt.gz"), "name", "v", ["\tx\ty"])
    assert read_text(tmp_path / "d.txt.gz") == ["\tx\ty", "a\t1e-09\t3", "b\t0.5\tNA"]


def test_matrix_in_parts(spark, tmp_path):
    """Parts in order of their names are the file, header first; a single part is an option."""
    df = spark.range(4000).selectExpr("id % 40 AS r", "id div 40 AS c", "id AS n").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.matrix(df, str(tmp_path / "m.mtx.gz"), "r", "c", "n", 40, 100)
        lines = df.selectExpr("r", "c", "concat_ws(' ', r, c, n) AS line")
        sinks.text_file(lines, str(tmp_path / "one.txt"), ["c", "r"], compress=False, single=True)
        rows = df.selectExpr("format_string('%04d', n) AS name", "array(double(r), double(c)) AS v")
        sinks.dense(rows, str(tmp_path / "d.txt.gz"), "name", "v", ["\tx\ty"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "m.mtx.gz").glob("part-*"))) > 1
    expected = [f"{n % 40 + 1} {n // 40 + 1} {n}" for n in range(4000)]
    assert read_text(tmp_path / "m.mtx.gz") == ["%%MatrixMarket matrix coordinate integer general", "%", "40 100 4000", *expected]
    assert len(list((tmp_path / "one.txt").glob("part-*"))) == 1
    assert read_text(tmp_path / "one.txt") == [f"{n % 40} {n // 40} {n}" for n in range(4000)]
    names, back = text.read_matrix(spark, str(tmp_path / "d.txt.gz"))
    assert names == ["x", "y"] and back.count() == 4000
