"""Whole runs over small files, the options and the stream."""

import gzip
import random

import pytest

from cellwright.cli import parse
from cellwright.config import EngineConfig
from cellwright.plans.engine import SUMMARY, Engine
from cellwright.streaming import molecules as stream


def lines(path):
    parts = sorted(path.glob("part-*"))
    return [line for p in parts for line in (gzip.open(p, "rt") if p.suffix == ".gz" else open(p)).read().splitlines()]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    """Two samples, 40 SNPs, 6 droplets with cells of one sample each and 30 with ambient reads."""
    folder, rng = tmp_path_factory.mktemp("run"), random.Random(5)
    code = [(k % 3, (k // 3) % 3) for k in range(1, 41)]
    code = [(a, b) if (a, b) not in ((0, 0), (2, 2)) else (0, 2) for a, b in code]
    gt = ["0/0", "0/1", "1/1"]
    rows = [f"chr1\t{1000 * (k + 1)}\tv{k}\tA\tG\t.\t.\t.\tGT\t{gt[a]}\t{gt[b]}" for k, (a, b) in enumerate(code)]
    (folder / "x.vcf").write_text("##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\n" + "\n".join(rows) + "\n")
    gtf = ['chr1\th\tgene\t1\t60000\t.\t+\t.\tgene_id "g1"; gene_name "G"; gene_type "t";', 'chr1\th\ttranscript\t1\t60000\t.\t+\t.\tgene_id "g1"; transcript_id "t1";', 'chr1\th\texon\t1\t60000\t.\t+\t.\tgene_id "g1"; transcript_id "t1"; exon_id "e";']
    (folder / "x.gtf").write_text("\n".join(gtf) + "\n")
    (folder / "p.bed").write_text("chr1\t0\t30000\n")
    (folder / "no.bed").write_text("chr1\t70000\t80000\n")
    rna, atac = ["@HD"], ["@HD"]

    def read(name, pos, base, tags, flag=0, strand="M"):
        return "\t".join(map(str, [name, flag, "chr1", pos + 1, 60, "50M", "*", 0, 0, "C" * 25 + base + "C" * 24, "I" * 50, *tags]))

    n = 0
    for d in range(36):
        bc = f"BARCODE{d:02}"
        for m in range(150 if d < 6 else 12):
            k = rng.randrange(40)
            who = d % 2 if d < 6 and rng.random() < 0.9 else rng.randrange(2)
            base = "G" if rng.random() < code[k][who] / 2 else "A"
            site = 1000 * (k + 1) - 1
            for copy in range(1 + m % 2):
                rna.append(read(f"r{n}", site - 25, base, [f"CB:Z:{bc}", f"UB:Z:UMI{m:04}"]))
                n += 1
            shift = rng.randrange(20)
            for copy in range(1 + m % 2):
                atac.append(read(f"a{n}", site - 25, base, [f"CB:Z:{bc}"], 0x63))
                atac.append(read(f"a{n}", site + 100 + shift, "C", [f"CB:Z:{bc}"], 0x93))
                n += 1
    atac.append(read("lone", 100, "C", ["CB:Z:BARCODE00"]))
    rna.append(read("short", 100, "C", ["CB:Z:BC", "UB:Z:UMI1"]))
    (folder / "rna.sam").write_text("\n".join(rna) + "\n")
    (folder / "atac.sam").write_text("\n".join(atac) + "\n")
    (folder / "wl.txt").write_text("BARCODE03\nBARCODE01\n")
    return folder


def config(files, **more):
    at = lambda n: str(files / n)
    return EngineConfig(**({"rna_bam": at("rna.sam"), "atac_bam": at("atac.sam"), "vcf": at("x.vcf"), "gtf": at("x.gtf"), "peaks": at("p.bed"), "exclude": at("no.bed"), "out_min": 50, "bc_wl": at("wl.txt"), "max_iter": 5} | more))


def test_full_run(spark, files, tmp_path):
    summary = {r.Barcode: r for r in Engine(spark, config(files, out=str(tmp_path / "o"))).run().collect()}
    assert sorted(summary) == [f"BARCODE{d:02}" for d in range(6)]
    assert summary and list(summary["BARCODE00"].asDict()) == SUMMARY
    assert all(r.best_type == "Singlet" and r.best_sample == f"s{1 + int(b[-2:]) % 2}" for b, r in summary.items())
    assert summary["BARCODE00"].n_rna_molecules == "150"
    assert lines(tmp_path / "o.barcodes.txt.gz")[:3] == ["BARCODE03", "BARCODE01", "BARCODE00"]
    for name in ("rna.ac.ref", "rna.ac.alt", "rna.ac.oth", "atac.ac.ref", "gc.spl", "gc.uns", "gc.amb", "atac.peaks"):
        head = lines(tmp_path / f"o.{name}.mtx.gz")
        rows, columns, n = map(int, head[2].split())
        assert head[0].startswith("%%MatrixMarket") and n == len(head) - 3 and columns == 36
    cells = {n: [x.split()[:2] for x in lines(tmp_path / f"o.rna.ac.{n}.mtx.gz")[3:]] for n in ("ref", "alt", "oth")}
    assert cells["ref"] == cells["alt"] == cells["oth"]
    assert lines(tmp_path / "o.gene.txt.gz") == ["chr1\t1\t60000\t+\tt\tG\tg1"]
    assert len(lines(tmp_path / "o.var.txt.gz")) == 40 and lines(tmp_path / "o.var.txt.gz")[0].startswith("chr1\t1000\tv0\tA\tG")
    assert lines(tmp_path / "o.summary.txt")[0].split("\t") == SUMMARY
    assert lines(tmp_path / "o.samples.txt") == ["H\ts1\ts2", "0\tNA\tNA", "1\ts1\tNA", "1\ts2\tNA", "2\ts1\ts2"]
    for name, n in (("lambda", 4), ("pi", 3), ("alpha_prior", 3), ("sample_llk", 6), ("alpha_rna", 6), ("alpha_atac", 6)):
        assert len(lines(tmp_path / f"o.{name}.txt.gz")) == n


def test_counts_of_one_modality(spark, files, tmp_path):
    engine = Engine(spark, config(files, out=str(tmp_path / "o"), atac_bam=None, counts_only=True, bc_wl=None))
    assert engine.run() is None
    assert lines(tmp_path / "o.barcodes.txt.gz")[0] == "BARCODE00" and not (tmp_path / "o.atac.peaks.mtx.gz").exists()
    given = engine.inputs()
    rna = engine.molecules(given)
    stats = {r.barcode: r for r in engine.stats(given, rna, None).collect()}
    assert stats["BARCODE00"].n_rna == 150 and stats["BARCODE00"].n_atac == 0 and stats["BARCODE00"].FRIP == -1 and stats["BARCODE00"].FRIG == 0


def test_options():
    got = parse(["-r", "x.bam", "--vcf", "y", "-x", "7", "-C", "-h", "0.001", "--mdl-reads", "all"])
    assert (got.rna_bam, got.vcf, got.out_min, got.counts_only, got.eps, got.mdl_reads) == ("x.bam", "y", 7, True, 0.001, "all")
    for bad in ({"out_min": 0}, {"eps": 1}, {"rna_mapq": 256}, {"rna_bc_tag": "CBX"}, {"mdl_reads": "some"}, {"amb_prior_w": 0}, {"max_iter": 1 << 16}, {"threads": 0}):
        with pytest.raises(ValueError, match="must"):
            EngineConfig(**bad)
    with pytest.warns(UserWarning, match="no effect"):
        EngineConfig(amb_eps=0.1)


def test_stream(spark, tmp_path):
    rows = [("2024-01-01 00:01:00", "b", "u", s) for s in "AAB"] + [("2024-01-01 00:02:00", "b", "v", s) for s in "AB"] + [("2024-01-01 05:00:00", "b", "w", "A")]
    df = spark.createDataFrame(rows, "ts string, bc string, umi string, s string").selectExpr("cast(ts as timestamp) ts", "bc", "umi", "s")
    df.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = []
    query = stream.molecules_to(stream.counted_readings(source, "ts", ["bc", "umi"], ["s"]), ["bc", "umi"], ["s"], lambda d, _: got.extend(d.collect()), str(tmp_path / "cp"))
    query.processAllAvailable()
    query.stop()
    assert [(r.umi, r.s, r.n) for r in got] == [("u", "A", 2)]
