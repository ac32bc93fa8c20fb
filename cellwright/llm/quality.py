"""Quality by hierarchical empirical Bayes.

Two logistic models over hashed words and style features, trained on labelled
documents, give each document's evidence: the probability that its quality is
good, and that it is toxic.  At most ``max_rows`` labelled documents (those of
least id hash) are fitted; this is the only sample.  Spark counts how often each
hashed word goes with a label, and only words that do reach the driver.  The
labels of these documents, bounded by ``max_rows``, are broadcast, so the texts
are not shuffled.  Each text is scored once: the evidence is written to a table
that both the sums over sites and the decisions read.

Hosts and paths (here: source, and source and language) get posteriors from all
documents.  With mean p over all documents, a host of n documents whose
evidence sums to s has the mean (k p + s) / (k + n), and a path of a host shrinks
to its host's mean in the same way.  The strengths k come from the variance
between sites beyond what sampling explains (method of moments); where there is
none, k is infinite and sites say nothing.  A document's own evidence is left
out of its site's posterior.  The odds of the site against those of all
documents multiply the odds of the document.

The site sums are grouped aggregations with partial sums, so a host with a third
of all rows is no hot spot, and only joins with the (small) site table follow.

A document is kept if it is more likely good than not and more likely not toxic
than toxic.

Nulls and empty texts: null or empty texts are rejected; null hosts form one host,
null ids are scored like others but have no labels.  Very long texts are scored
whole.  Labels that are null, or of documents that are not there, are ignored;
without labels of both kinds the model's answer is the only kind's.  Ties: of
labels with equal hashes those of least quality and toxicity are fitted first; a
quality of exactly 0.5 is kept, a toxicity of 0.5 is not.  Repeated rows are
documents of their own with equal evidence.  An empty table gives an empty result.
Columns with the names of new ones are replaced (by ``keep``: kept); all other
columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import Own, Scratch, arrow_map, table, utf8

BITS = 18
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_KEEP = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in _LOWER)
_UPPER, _DIGIT = bytes(range(65, 91)), b"0123456789"
_PLAIN = bytes(b for b in range(256) if b in b" \t\r\n.,;:'-?()\"" or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
STYLE = 9
PREFIXES = (5, 7)
BINS = 12
#: The least association of a bucket that a model uses.
LEAST = 40.0


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word) >> (64 - BITS)
        return value


_buckets = _Buckets()


def features(text: bytes | None) -> tuple[np.ndarray, list[float]]:
    """The buckets of the text's words, and its style."""
    text = text or b""
    size = len(text) or 1
    words = text.translate(_KEEP).split()
    distinct = set(words)
    lines = text.split(b"\n")
    tokens = text.split()
    style = [
        len(text.translate(None, _PLAIN)) / size,
        1 - len(text.translate(None, _UPPER)) / size if text else 0.0,
        1 - len(text.translate(None, _DIGIT)) / size if text else 0.0,
        len(distinct) / (len(words) or 1),
        1 - len(set(lines)) / len(lines),
        1 - len(set(tokens)) / (len(tokens) or 1),
        min(1.0, sum(map(len, words)) / (len(words) or 1) / 20),
        min(1.0, np.log1p(len(words)) / 10),
        float(not words),
    ]
    found = set(map(_buckets.__getitem__, distinct))
    for n in PREFIXES:
        found.update(map(_buckets.__getitem__, {b"^" + w[:n] for w in distinct if len(w) > n}))
    return np.sort(np.fromiter(found, np.int32, len(found))), style


@dataclass
class Model:
    """A logistic model: weights of buckets and of style bins, and the intercept."""

    edges: np.ndarray
    style: np.ndarray
    words: np.ndarray
    intercept: float

    def logit(self, buckets: np.ndarray, style: list[float]) -> float:
        bins = (np.asarray(style)[:, None] > self.edges).sum(1)
        return float(self.intercept + self.words[buckets].sum() + self.style[np.arange(STYLE), bins].sum())


def association(n: float, n1: float, total: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The likelihood ratio statistic G2 of each bucket's presence with a label.

    Of n rows n1 have the label; total rows have the bucket, a of them the label.
    """
    g = np.zeros(len(total))
    for seen, whole, share in ((a, total, n1 / n), (total - a, total, 1 - n1 / n), (n1 - a, n - total, n1 / n), (n - n1 - total + a, n - total, 1 - n1 / n)):
        expected = whole * share
        g += np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0)
    return 2 * g


def train(rows: list[tuple[np.ndarray, list[float]]], labels: np.ndarray, epochs: int = 150, decay: float = 0.3, least: float = LEAST) -> Model:
    """Logistic regression by full-batch gradient steps with per-weight rates (AdaGrad).

    Buckets take part whose presence goes with the label (G2 of at least
    ``least``).  Each style feature is cut into bins at the rows' quantiles.
    """
    n = len(rows)
    x = np.array([s for _, s in rows]) if n else np.zeros((1, STYLE))
    edges = np.quantile(x, np.arange(1, BINS) / BINS, axis=0).T
    share = (labels.sum() + 0.5) / (n + 1)
    intercept = float(np.log(share / (1 - share)))
    style, words = np.zeros((STYLE, BINS)), np.zeros(1 << BITS)
    if 0 < labels.sum() < n:
        total, a = np.zeros(1 << BITS), np.zeros(1 << BITS)
        for (buckets, _), label in zip(rows, labels, strict=True):
            total[buckets] += 1
            a[buckets] += label
        strong = association(n, labels.sum(), total, a) >= least
        some = [b[strong[b]] for b, _ in rows]
        of, flat = np.repeat(np.arange(n), [len(b) for b in some]), np.concatenate(some)
        bins = (x[:, :, None] > edges).sum(2)
        place = bins + np.arange(STYLE) * BINS
        g_words, g_style, g_0 = np.full(1 << BITS, 1e-8), np.full(STYLE * BINS, 1e-8), 1e-8
        flat_style = style.ravel()
        for _ in range(epochs):
            z = intercept + flat_style[place].sum(1) + np.bincount(of, words[flat], n)
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels
            d = np.bincount(flat, error[of], 1 << BITS) + decay * words
            g_words += d * d
            words -= 0.1 * d / np.sqrt(g_words)
            d = np.bincount(place.ravel(), np.repeat(error, STYLE), STYLE * BINS) + decay * flat_style
            g_style += d * d
            flat_style -= 0.2 * d / np.sqrt(g_style)
            d = error.sum()
            g_0 += d * d
            intercept -= 0.2 * d / np.sqrt(g_0)
    return Model(edges, style, words, float(intercept))


def fitted(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> tuple[Model, Model]:
    """The models for good quality and for toxicity."""
    marks = labels.where("quality is not null and toxic is not null").select(F.col(id_col).alias("__id"), F.col("quality").cast("int").alias("__quality"), F.col("toxic").cast("int").alias("__toxicity"))
    marks = marks.orderBy(F.xxhash64("__id"), "__quality", "__toxicity").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).cast("string").alias("__text")).join(F.broadcast(marks), F.col("__doc") == F.col("__id")).select("__text", "__quality", "__toxicity")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [features(t) for t in utf8(batch.column(0))]
        words = pa.array([f[0] for f in found], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([words, pa.array([f[1] for f in found], pa.list_(pa.float64())), batch.column(1), batch.column(2)], ["words", "style", "quality", "toxic"])

    scratch = Scratch(docs.sparkSession, "labelled")
    seen = scratch.table(arrow_map(rows, run, "words array<int>, style array<double>, quality int, toxic int"), "features")
    positive = [F.sum((F.col(c) > 0).cast("long")).alias(c) for c in ("quality", "toxic")]
    whole = seen.agg(F.count("*").alias("n"), *positive).first()
    counts = seen.select(F.explode("words").alias("word"), "quality", "toxic").groupBy("word").agg(F.count("*").alias("n"), *positive).toPandas()
    used = np.zeros(1 << BITS, bool)
    for c in ("quality", "toxic") if whole["n"] else ():
        g = association(whole["n"], whole[c], counts["n"].to_numpy(float), counts[c].to_numpy(float))
        used[counts["word"].to_numpy(int)] |= g >= LEAST

    def strong(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [np.asarray(w, np.int32) for w in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array([w[used[w]].tobytes() for w in words], pa.binary()), *batch.columns[1:]], ["words", "style", "quality", "toxic"])

    got = arrow_map(seen, strong, "words binary, style array<double>, quality int, toxic int").toPandas()
    scratch.drop()
    # A fixed order, for equal sums in every run.
    got = got.assign(order=got["style"].map(tuple)).sort_values(["quality", "toxic", "words", "order"]) if len(got) else got
    found = [(np.frombuffer(w, np.int32), list(s)) for w, s in zip(got["words"], got["style"], strict=True)]
    return train(found, (got["quality"].to_numpy() > 0).astype(float)), train(found, (got["toxic"].to_numpy() > 0).astype(float))


def evidence(spark: SparkSession, models: tuple[Model, Model], text: Column) -> Column:
    """A struct of good and toxic: probabilities from the text alone."""
    shared = spark.sparkContext.broadcast(models)

    def score(texts: pd.Series) -> pd.DataFrame:
        good, toxic = shared.value
        out = np.empty((len(texts), 2))
        for k, t in enumerate(texts):
            f = features(t.encode() if t else None)
            out[k] = good.logit(*f), toxic.logit(*f)
        p = 1 / (1 + np.exp(-np.clip(out, -30, 30)))
        return pd.DataFrame({"good": p[:, 0], "toxic": p[:, 1]})

    return F.pandas_udf(score, "good double, toxic double")(text.cast("string"))


def _strength(sites: DataFrame, total: str, squares: str, n: str) -> float:
    """The prior's weight in documents: sampling variance over the variance between sites."""
    row = sites.agg(F.sum(n).alias("n"), F.sum(total).alias("s"), F.sum(squares).alias("q"), F.sum(F.col(n) * F.col(n)).alias("n2"), F.count("*").alias("k"), F.sum(F.col(total) * F.col(total) / F.col(n)).alias("between")).first()
    if not row["n"] or row["k"] < 2 or row["n"] <= row["k"]:
        return float("inf")
    mean = row["s"] / row["n"]
    within = max(0.0, row["q"] - row["between"]) / (row["n"] - row["k"])
    spread = (row["between"] - row["n"] * mean * mean - (row["k"] - 1) * within) / (row["n"] - row["n2"] / row["n"])
    return float("inf") if spread <= 1e-9 else max(1.0, within / spread)


def _shrunk(k: float, prior: Column, total: Column, n: Column) -> Column:
    return prior if k == float("inf") else (k * prior + total) / (k + n)


NEW = ["good_evidence", "toxic_evidence", "good_site", "toxic_site", "quality", "toxicity", "kept"]


def scored(docs: DataFrame, models: tuple[Model, Model], host: Callable[[Own], Column], path: Callable[[Own], Column], text_col: str = "text", dropped: tuple[str, ...] = ()) -> DataFrame:
    """docs with evidence, site posteriors, quality, toxicity and kept.

    New columns: good_evidence, toxic_evidence (from the text), good_site,
    toxic_site (of the path, without the document), quality, toxicity, kept.
    Columns of docs with these names are replaced.  host and path make a row's
    sites from its columns.  dropped: columns that the result need not have.
    """
    spark = docs.sparkSession
    own = Own(docs, NEW)
    text = own[text_col].cast("string")
    name = lambda c: F.when(c.isNull(), "n").otherwise(F.concat(F.lit("s"), c.cast("string")))
    empty = F.coalesce(F.length(text), F.lit(0)) == 0
    got = own.df.withColumns({"__host": name(host(own)), "__path": name(path(own)), "__empty": empty, "__evidence": evidence(spark, models, text)})
    got = got.select("*", F.col("__evidence.good").alias("__good"), F.col("__evidence.toxic").alias("__toxic")).drop("__evidence")
    left = [c for c in own.names if c not in dropped]
    got = got.drop(*[own.name(c) for c in dropped if c in own.names])
    scratch = Scratch(spark, "quality")
    rows = scratch.table(got, "evidence")
    sums = [f(c).alias(f"__{p}{c}") for c in ("__good", "__toxic") for p, f in (("s", F.sum), ("q", lambda c: F.sum(F.col(c) * F.col(c))))]
    paths = rows.groupBy("__host", "__path").agg(F.count("*").alias("__n"), *sums)
    paths = scratch.table(paths, "paths")
    hosts = paths.groupBy("__host").agg(F.sum("__n").alias("__hn"), *[F.sum(f"__{p}{c}").alias(f"__h{p}{c}") for c in ("__good", "__toxic") for p in "sq"])
    whole = hosts.agg(F.sum("__hn").alias("n"), F.sum("__hs__good").alias("good"), F.sum("__hs__toxic").alias("toxic")).first()
    got = rows.join(paths.join(hosts, "__host"), ["__host", "__path"])
    logit = lambda p: F.ln(p / (1 - p))
    bounded = lambda p: F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    out = {}
    for c, of in (("good", "quality"), ("toxic", "toxicity")):
        mean = F.lit(min(1 - 1e-9, max(1e-9, (whole[c] or 0.0) / (whole["n"] or 1))))
        host_k, path_k = _strength(hosts, f"__hs__{c}", f"__hq__{c}", "__hn"), _strength(paths, f"__s__{c}", f"__q__{c}", "__n")
        of_host = _shrunk(host_k, mean, F.col(f"__hs__{c}") - F.col(f"__{c}"), F.col("__hn") - 1)
        of_path = bounded(_shrunk(path_k, of_host, F.col(f"__s__{c}") - F.col(f"__{c}"), F.col("__n") - 1))
        z = logit(bounded(F.col(f"__{c}"))) + logit(of_path) - logit(mean)
        out |= {f"{c}_site": of_path, of: 1 / (1 + F.exp(-z))}
    kept = (out["quality"] >= 0.5) & (out["toxicity"] < 0.5) & ~F.col("__empty")
    names = [F.col(own.name(c)).alias(c) for c in left]
    return got.select(*names, F.col("__good").alias("good_evidence"), F.col("__toxic").alias("toxic_evidence"), *[out[c].alias(c) for c in NEW[2:-1]], kept.alias("kept"))


def _sites(source: str, lang: str) -> tuple[Callable[[Own], Column], Callable[[Own], Column]]:
    """Host and path from the columns of source and language."""
    return lambda own: own[source], lambda own: F.to_json(F.struct(own[source].cast("string").alias("source"), own[lang].cast("string").alias("lang")))


def by_source(docs: DataFrame, labels: DataFrame, dropped: tuple[str, ...] = (), **options) -> DataFrame:
    """Scores of documents with hosts from source and paths from source and language."""
    return scored(docs, fitted(docs, labels, **options), *_sites("source", "lang"), dropped=dropped)


def keep(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that are kept, with their own columns."""
    own = Own(docs)
    got = scored(own.df, fitted(docs, labels, **options), *_sites(own.name("source"), own.name("lang")), own.name("text"))
    return own.back(got.where("kept"))


def op6_hierarchical_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality, toxicity and decision for all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    got = by_source(docs, table(spark, sf_dir, "labels"), ("text",))
    return got.select("doc_id", "source", "lang", *NEW)
