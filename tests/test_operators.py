"""Hand fixtures of single operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellwright.functions import columns as C
from cellwright.operators import counts, dedup, genotypes, intervals, reads, splice
from cellwright.operators.dictionary import dense_index
from cellwright.operators.model import ambient, decide, em, likelihood


def test_unique_mode_and_ties(spark):
    df = spark.createDataFrame([("b", "u", s) for s in "AAAB"] + [("b", "v", s) for s in "AABB"], "bc string, umi string, s string")
    assert [tuple(r) for r in dedup.unique_mode_of(df, ["bc", "umi"], ["s"]).collect()] == [("b", "u", "A", 3)]


def test_quality_merge(spark):
    df = spark.createDataFrame([(1, 20), (1, 255), (1, 35), (2, 255), (2, 255)], "k int, q int")
    assert dict(df.groupBy("k").agg(C.best_quality(F.col("q"))).collect()) == {1: 35, 2: 255}


def test_molecules_merge_bases(spark):
    base = lambda site, b, q: (site, b, q)
    rows = [
        ("c", "u", "1", 10, 20, "+", [base(12, "A", 20), base(15, "G", 255)], []),
        ("c", "u", "1", 10, 20, "+", [base(12, "A", 33), base(15, "G", 255)], []),
        ("c", "u", "1", 10, 20, "+", [base(12, "C", 40), base(15, "G", 30)], []),
        ("c", "v", "1", 10, 20, "+", [], [(3, 0)]),
        ("c", "w", "1", 10, 20, "+", [], [(3, 0)]),
        ("c", "w", "1", 11, 20, "+", [], [(3, 0)]),
    ]
    schema = "barcode string, umi string, chrom string, pos int, end int, strand string, bases array<struct<site:int,base:string,qual:int>>, genes array<struct<gene_ix:bigint,splice:int>>"
    got = {r.umi: r for r in dedup.rna_molecules(spark.createDataFrame(rows, schema)).collect()}
    assert sorted(got) == ["u", "v"]
    assert [tuple(b) for b in got["u"].bases] == [(12, "A", 33), (15, "G", 255)] and got["u"].n == 2
    assert got["v"].bases == [] and got["v"].n == 1


def test_fragments_take_the_first_mates_base(spark):
    schema = "barcode string, chrom string, start1 int, end1 int, start2 int, end2 int, bases1 array<struct<site:int,base:string,qual:int>>, bases2 array<struct<site:int,base:string,qual:int>>"
    rows = [("c", "1", 100, 150, 140, 250, [(145, "A", 30)], [(145, "G", 40), (200, "T", 20)])]
    got = dedup.atac_fragments(spark.createDataFrame(rows, schema)).first()
    assert [tuple(b) for b in got.bases] == [(145, "A", 30), (200, "T", 20)] and got.n == 1


def test_pairing(spark):
    rows = [("q", 1, "1", 100, 150), ("q", 2, "1", 200, 250), ("r", 3, "1", 1, 50), ("s", 4, "1", 1, 50), ("s", 5, "2", 9, 50), ("t", 6, "1", 1, 2), ("t", 7, "1", 3, 4), ("t", 8, "1", 5, 6)]
    df = spark.createDataFrame(rows, "qname string, seqno int, chrom string, start int, end int")
    got = reads.pair_mates(df, ["qname"], ["seqno"], "chrom", ["start", "end"]).orderBy("qname").collect()
    assert [(r.qname, r.start1, r.end1, r.start2, r.end2) for r in got] == [("q", 100, 150, 200, 250), ("t", 1, 2, 3, 4)]


@pytest.mark.parametrize(("peak", "parity", "count"), [((90, 300), True, 2), ((90, 150), True, 1), ((90, 105), True, 0), ((90, 105), False, 1)])
def test_cut_sites(spark, peak, parity, count):
    fragment = spark.createDataFrame([("1", 100, 250)], "chrom string, start int, end int")
    peaks = spark.createDataFrame([("1", *peak)], "chrom string, start int, end int")
    assert intervals.cut_site_peaks(fragment, peaks, parity).count() == count


def test_containment(spark):
    read = spark.createDataFrame([("1", 10, 60, "+"), ("1", 10, 60, "-")], "chrom string, start int, end int, strand string")
    gene = lambda end: spark.createDataFrame([("1", 0, end, "+")], "chrom string, start int, end int, strand string")
    for end, n in ((60, 1), (59, 0)):
        assert intervals.overlap_join(read, gene(end), stranded=True, min_fraction=1.0, levels=2).count() == n


def test_overlaps_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    make = lambda n, longest: [(str(int(c)), int(s), int(s + 1 + w)) for c, s, w in zip(rng.integers(0, 3, n), rng.integers(0, 5000, n), rng.integers(0, longest, n), strict=True)]
    a, b = make(120, 90), make(80, 3000)
    schema = "chrom string, start int, end int"
    expected = sorted((x, y) for x in a for y in b if x[0] == y[0] and x[1] < y[2] and y[1] < x[2])
    got = intervals.overlap_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), width=32, levels=3)
    assert sorted(((r.chrom, r.start, r.end), (r.r_chrom, r.r_start, r.r_end)) for r in got.collect()) == expected
    hit = {x for x, _ in expected}
    for longest in (16, 4096):
        kept = intervals.overlap_filter(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), True, longest)
        assert sorted(map(tuple, kept.collect())) == sorted(x for x in a if x in hit)
        rest = intervals.overlap_filter(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), False, longest)
        assert sorted(map(tuple, rest.collect())) == sorted(x for x in a if x not in hit)


def _cigar(text):
    import re

    return [(op, int(n)) for n, op in re.findall(r"([0-9]+)([MIDNSHP=X])", text)]


def test_splice_classes(spark):
    rows = [(_cigar(c), p) for c, p in (("50M100N50M", 50), ("100M", 50), ("50M", 10), ("5S45M", 120))]
    df = spark.createDataFrame(rows, "cigar array<struct<op:string,len:int>>, pos int")
    isoforms = F.array(F.array(F.struct(F.lit(0).alias("start"), F.lit(100).alias("end")), F.struct(F.lit(200).alias("start"), F.lit(300).alias("end"))))
    assert [r[0] for r in df.select(splice.gene_class(F.col("cigar"), F.col("pos"), isoforms)).collect()] == [0, 1, 2, 2]


def test_bases_and_alleles(spark):
    df = spark.createDataFrame([(1, "1", 10, _cigar("2S3M2I4M5N2M1D2M"), "TTACGTTACGTAACC", [30] * 15)], "k int, chrom string, pos int, cigar array<struct<op:string,len:int>>, seq string, qual array<int>")
    sites = spark.createDataFrame([("1", p) for p in (9, 10, 12, 13, 16, 17, 22, 24, 25, 26, 27)], "chrom string, pos int")
    got = sorted((r.site, r.base) for r in reads.bases_at_variants(df, sites, ["k"]).collect())
    assert got == [(10, "A"), (12, "G"), (13, "A"), (16, "T"), (22, "A"), (25, "C"), (26, "C")]
    bases = spark.createDataFrame([("1", 5, b, q) for b, q in (("A", 30), ("G", 30), ("T", 30), ("N", 30), ("G", 29), ("G", 255))], "chrom string, site int, base string, qual int")
    variants = lambda rows: spark.createDataFrame(rows, "vix long, chrom string, pos int, ref string, alt string")
    assert sorted(r.allele for r in reads.call_alleles(bases, variants([(0, "1", 5, "A", "G")])).collect()) == [0, 1, 1, 15]
    assert reads.call_alleles(bases, variants([(0, "1", 5, "A", "G"), (1, "1", 5, "A", "T")])).count() == 0


def test_columns(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()[0]
    for s, e, b in ((0, 1, 4681), (0, 16385, 585), (0, 1 << 27, 0)):
        assert one(C.ucsc_bin(F.lit(s), F.lit(e))) == b
        assert b in one(C.ucsc_bins(F.lit(s), F.lit(e)))
    assert one(C.base_probability(F.lit(1.0), F.lit(1), C.phred_error(F.lit(30)))) == pytest.approx(0.9995)
    assert one(C.base_probability(F.lit(1.0), F.lit(0), C.phred_error(F.lit(30)))) == pytest.approx(0.0005)
    assert one(C.base_probability(F.lit(None).cast("double"), F.lit(0), F.lit(0.1))) == 1
    assert [one(C.is_mito(F.lit(c))) for c in ("chrM", "MT", "chrMT", "m", "chr1")] == [True] * 4 + [False]
    assert one(C.log_sum_exp([F.lit(-1000.0), F.lit(-1000.0)])) == pytest.approx(-1000 + np.log(2))
    for x, d in ((0.0001234, 4), (123456.789, 4), (12.0, 8), (1e-9, 8), (0.1 + 0.2, 8), (-2.5e10, 4), (0.0, 4), (99999.5, 5)):
        assert one(C.format_significant(F.lit(x), d)) == f"%.{d}g" % x
    assert one(C.format_significant(F.lit(float("nan")), 4)) == "NA"
    for a, d in (([0, 1], 0.5), ([1], 1.0), ([None, 1], None), ([], None)):
        assert one(C.dosage_from_alleles(F.array(*[F.lit(v).cast("int") for v in a]).cast("array<int>"))) == d
    for g, d in (([0.1, 0.2, 0.7], 0.8), ([0.4], 0.4), ([0.5, 0.5], None)):
        got = one(C.dosage_from_probabilities(F.array(*map(F.lit, g))))
        assert got == (None if d is None else pytest.approx(d))


def test_rollup(spark):
    df = spark.createDataFrame([("a", 99, 99), ("b", 100, 0), ("c", 1, 2)], "barcode string, rna int, atac int")
    got = {r.droplet: r.n_bc for r in counts.droplets(counts.low_count_rollup(df, 100)).collect()}
    assert got == {"Empty": 3, "b": 1}


def test_dense_index(spark):
    got = dense_index(spark.range(1000).repartition(7).selectExpr("id * 3 AS k"), ["k"]).collect()
    assert all(r.ix * 3 == r.k for r in got) and len(got) == 1000
    assert dense_index(spark.range(0), ["id"]).count() == 0


def test_hypotheses_and_simplex(spark):
    assert [(h.h, h.s1, h.s2) for h in likelihood.hypotheses(3)] == [(0, None, None), (1, 0, None), (1, 1, None), (1, 2, None), (2, 0, 1), (2, 0, 2), (2, 1, 2)]
    with pytest.raises(ValueError, match="two samples"):
        likelihood.hypotheses(1)
    assert ambient.project_to_simplex(np.array([0.6, 0.6])) == pytest.approx([0.5, 0.5])
    assert ambient.project_to_simplex(np.array([1.5, 0])) == pytest.approx([1, 0])


def test_genotype_filter(spark):
    rows = [(0, "a", [0, 0]), (0, "b", [0, 0]), (1, "a", [0, None]), (1, "b", [0, 1]), (2, "a", [0, 1]), (2, "b", [1, 1])]
    kept = genotypes.informative(genotypes.variant_stats(spark.createDataFrame(rows, "vix int, sample string, alleles array<int>")))
    assert [r.vix for r in kept.collect()] == [2]


def test_ties_are_empty(spark):
    df = spark.createDataFrame([(0.2, 0.7, 0.1), (0.4, 0.4, 0.2), (0.1, 0.2, 0.7), (0.8, 0.1, 0.1)], "a double, b double, c double")
    assert [r[0] for r in df.select(decide.call_type(*map(F.col, "abc"))).collect()] == ["Singlet", "Empty", "Doublet", "Empty"]


def _simulated(rng, droplets, per, gamma, pi_amb):
    """Molecule probabilities and truth by droplet."""
    m, v = gamma.shape
    hyps, pool = likelihood.hypotheses(m), pi_amb @ gamma
    rows, truth = [], {}
    for d in range(droplets):
        h = hyps[0] if d % 5 == 0 else hyps[1 + d % m] if d % 5 < 4 else hyps[1 + m + d % (len(hyps) - 1 - m)]
        alpha = 1.0 if h.h == 0 else rng.beta(1, 9)
        truth[f"d{d:03}"] = h, alpha
        probs = []
        for _ in range(per):
            sites = rng.integers(0, v, 3)
            g = pool if rng.random() < alpha else gamma[rng.choice(h.samples)]
            base = np.where(rng.random(3) < 0.001, rng.random(3) < 0.5, rng.random(3) < g[sites])
            full = np.vstack([pool, gamma])[:, sites]
            probs.append(np.prod(0.999 * np.where(base, full, 1 - full) + 0.0005, axis=1).tolist())
        rows += [(f"d{d:03}", "rna", p, 1) for p in probs]
    return rows, truth


def test_simulation_recovers_the_truth(spark, monkeypatch):
    rng = np.random.default_rng(7)
    gamma = rng.choice([0, 0.5, 1.0], (4, 300), p=[0.5, 0.3, 0.2])
    rows, truth = _simulated(rng, 60, 150, gamma, np.full(4, 0.25))
    molecules = spark.createDataFrame(rows, "droplet string, modality string, probs array<double>, n int")
    scored, pars = em.fit(molecules, 4, 100, 60, ["rna"], max_iter=10)
    hyps = likelihood.hypotheses(4)
    got = {r.droplet: r for r in decide.decide(scored, hyps).collect()}
    right = [truth[d][0].ix == r.best for d, r in got.items()]
    assert sum(right) >= 0.95 * len(right)
    errors = [r.alpha_rna[r.best] - truth[d][1] for d, r in got.items() if truth[d][0].ix == r.best and truth[d][0].h]
    assert np.sqrt(np.mean(np.square(errors))) < 0.06
    assert pars.lam.sum() == pytest.approx(1) and pars.pi.sum() == pytest.approx(1)
    # The distributed steps give the same weights as those on the driver.
    monkeypatch.setattr(em, "DRIVER_CELLS", 0)
    again = em.fit(molecules, 4, 100, 60, ["rna"], max_iter=2)[1]
    monkeypatch.setattr(em, "DRIVER_CELLS", 10**9)
    assert em.fit(molecules, 4, 100, 60, ["rna"], max_iter=2)[1].lam == pytest.approx(again.lam)
    # A droplet too large to gather is fitted by sums.
    few = molecules.where("droplet in ('d001', 'd004')")
    small, large = ({r.droplet: r for r in em.fit_alpha(few, hyps, ["rna"], {"rna": 0.1}, 1e-8, most_rows=n).collect()} for n in (10**6, 10))
    for d in small:
        assert small[d].llk == pytest.approx(large[d].llk, rel=1e-6)


def test_pi_amb_is_found():
    rng = np.random.default_rng(3)
    gamma = rng.choice([0, 0.5, 1.0], (3, 400))
    truth = np.array([0.6, 0.3, 0.1])
    x = truth @ gamma
    vix = np.repeat(np.arange(400), 2)
    allele = np.tile([0, 1], 400)
    n = np.stack([rng.binomial(500, 1 - x), rng.binomial(500, x)], 1).ravel()
    pi, pool = ambient.fit_pi_amb(vix, allele, np.full(800, 0.001), n, gamma)
    assert pi == pytest.approx(truth, abs=0.03) and len(pool) == 400


@pytest.mark.parametrize("width", [1, 7, 64, 10_000])
def test_merge_by_bins_equals_merge_by_keys(spark, width):
    """Unions over bin borders, touching, nested, empty and repeated intervals; a null key is a key; negative starts."""
    rng = random.Random(width)
    rows = [(rng.choice(["a", "b", None]), s, s + rng.choice([0, 1, 3, 20, 150])) for s in (rng.randrange(-200, 900) for _ in range(160))]
    rows += [("c", -5, 700), ("c", 0, 1), ("c", 700, 710), ("c", 711, 712), ("d", None, 4), ("d", 3, None)]
    df = spark.createDataFrame(rows, "chrom string, start int, end int")
    expected = []
    for key in {r[0] for r in rows}:
        open_ = None
        for _, s, e in sorted(r for r in rows if r[0] == key and None not in r[1:]):
            if open_ and s <= open_[2]:
                open_[2], open_[3] = max(open_[2], e), open_[3] + 1
            else:
                open_ = [key, s, e, 1]
                expected.append(open_)
    for got in (intervals.merge_touching(df, ["chrom"], width=width), intervals.merge_touching(df, ["chrom"])):
        assert sorted(map(list, got.collect()), key=str) == sorted(expected, key=str)
