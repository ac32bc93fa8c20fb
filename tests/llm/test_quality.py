import math
import random

from pyspark.sql import functions as F

from cellwright.llm import quality as q


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    fitted = F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(3)) > 0
    held = labels.where(~fitted).select("doc_id", F.col("quality").alias("good"), "toxic")
    got = q.by_source(docs, labels.where(fitted)).join(held, "doc_id").collect()
    share = lambda right: sum(right) / len(right)
    assert share([(r.quality >= 0.5) == (r.good == 1) for r in got]) > 0.95
    assert share([(r.toxicity >= 0.5) == (r.toxic == 1) for r in got]) > 0.95
    assert share([r.kept for r in got if r.good == 1 and r.toxic == 0]) > 0.97


def test_sites_shrink(spark, documents):
    rng = random.Random(6)
    good, bad = ["the", "of", "and", "house"], ["buy", "cheap", "pills", "now"]
    text = lambda w: " ".join(rng.choice(w) for _ in range(30))
    rows = [(k, text(good if k % 2 else bad), "mixed") for k in range(40)] + [(k, text(bad), "spam") for k in range(40, 80)] + [(k, text(good), "fine") for k in range(80, 120)]
    rows += [(200, "unheard words only", "spam"), (201, "unheard words only", "fine"), (202, "unheard words only", "new"), (203, None, None), (204, "", "new")]
    docs = documents(rows)
    labels = spark.createDataFrame([(k, int(rows[k][1].split()[0] in good), 0) for k in range(120)] + [(None, 1, 0), (3, None, 1), (999, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in q.by_source(docs, labels).collect()}
    assert len(got) == len(rows)
    assert got[200].quality < got[202].quality < got[201].quality
    assert not got[203].kept and not got[204].kept
    assert all(got[k].kept == (rows[k][1].split()[0] in good) for k in range(120))


def strengths(sites):
    """Method of moments over lists of evidence, from the definition."""
    every = [x for s in sites for x in s]
    n, k = len(every), len(sites)
    if k < 2 or n <= k:
        return float("inf")
    mean = sum(every) / n
    means = [sum(s) / len(s) for s in sites]
    within = sum((x - m) ** 2 for s, m in zip(sites, means, strict=True) for x in s) / (n - k)
    between = sum(len(s) * (m - mean) ** 2 for s, m in zip(sites, means, strict=True))
    spread = (between - (k - 1) * within) / (n - sum(len(s) ** 2 for s in sites) / n)
    return float("inf") if spread <= 1e-9 else max(1.0, within / spread)


def posteriors(rows, evidence):
    """The posterior odds of each row, from evidence of all, by plain loops."""
    hosts, paths = {}, {}
    for r, e in zip(rows, evidence, strict=True):
        hosts.setdefault(r.source, []).append(e)
        paths.setdefault((r.source, r.lang), []).append(e)
    mean = sum(evidence) / len(evidence)
    host_k, path_k = strengths(list(hosts.values())), strengths(list(paths.values()))
    shrunk = lambda k, prior, rest: prior if k == float("inf") else (k * prior + sum(rest)) / (k + len(rest))
    bounded = lambda p: min(1 - 1e-9, max(1e-9, p))
    logit = lambda p: math.log(p / (1 - p))
    out = []
    for r, e in zip(rows, evidence, strict=True):
        left = lambda site: (lambda x: (x.remove(e), x)[1])(list(site))  # noqa: B023, E731
        site = bounded(shrunk(path_k, shrunk(host_k, mean, left(hosts[r.source])), left(paths[r.source, r.lang])))
        out.append((site, 1 / (1 + math.exp(-(logit(bounded(e)) + logit(site) - logit(bounded(mean)))))))
    return out


def test_posteriors_from_the_evidence(spark, sf):
    got = q.op6_hierarchical_quality(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(got) == len(texts)
    good, toxic = posteriors(got, [r.good_evidence for r in got]), posteriors(got, [r.toxic_evidence for r in got])
    for r, g, t in zip(got, good, toxic, strict=True):
        assert abs(r.good_site - g[0]) < 1e-6 and abs(r.quality - g[1]) < 1e-6 and abs(r.toxic_site - t[0]) < 1e-6 and abs(r.toxicity - t[1]) < 1e-6
        assert r.kept == (r.quality >= 0.5 and r.toxicity < 0.5 and bool(texts[r.doc_id]))


def test_each_text_is_scored_once(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    plan = q.by_source(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "documents.parquet" not in plan


def test_empty_tables_and_extra_columns(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert q.by_source(documents([]), none).count() == 0
    docs = documents([(1, "a b"), (1, "a b")]).withColumns({c: F.lit("old") for c in ("kept", "Quality", "n", "toxic", "__good", "__host", "__path", "__toxic", "__evidence", "own1")})
    assert len(q.by_source(docs, none).collect()) == 2
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    kept = q.keep(docs, labels)
    assert kept.columns == docs.columns and [(r.Quality, r["__good"], r["__host"], r.own1) for r in kept.collect()] == [("old",) * 4] * 2


def test_very_long_text_and_null_ids(spark, documents):
    docs = documents([(1, "good words here " * 20), (2, "buy pills now " * 20), (None, "good words here " * 200_000), (None, None)])
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    got = q.by_source(docs, labels).collect()
    assert len(got) == 4 and sum(r.kept for r in got if not r.text) == 0
