"""Secret scan: key patterns, and a randomness test battery for other tokens.

Three base kinds are regular expressions: ``assign`` (a key name, a sign, a
value of 12 characters or more), ``access`` (AKIA...) and ``hex``.

The method adds spans of kind ``random``: runs of 20 or more characters of
[A-Za-z0-9+/=_-] that overlap no base span, look drawn at random, and cannot be
explained as ordinary text.  Runs are split at inner equals signs (name=value); a
part that does not look random as a whole is tried in pieces of 20 or more
characters between its other separators.

Randomness.  The narrowest encoding with the token's characters is inferred
(hexadecimal, base 32, letters and digits, base 64), and three tests ask whether
its symbols are drawn evenly and independently: chi-squared of the symbol counts,
the number of runs above and below the alphabet's middle, and the serial
correlation of neighbours.  Their least p-value, times three, must be ``least_fit``
or more.

False discoveries.  The null hypothesis of a token is that it is ordinary text:
its characters come by q, their frequencies in the whole corpus.  With R its
likelihood ratio of even draws against draws by q, R exceeds r with a probability
of at most 1 / r under the null (Markov), so 1 / R is a p-value, and it falls with
the token's length.  The p-value of a token that fails the battery is 1, which can
only raise it, so each tested token, part and piece of a run has one valid p-value
that holds battery and length.  Benjamini-Hochberg over all of them bounds the
expected share of false discoveries by ``rate``: tokens are independent under the
null, and pieces of one run, which may overlap, depend on each other positively.  Frequencies and p-values are histograms of fixed size,
made by partial aggregation; nothing else reaches the driver.

Spans are of code points, their end exclusive; values are not written anywhere.
Nulls and empty texts: a null text is empty, a null id is an id like others.  Very
long texts are read whole, one batch of texts at a time.  Ties: spans of one start
are in order of kind.  Repeated rows have equal results, and each of their tokens
counts.  An empty table gives an empty result.  A column named secrets is replaced.
"""

from __future__ import annotations

import bisect
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._base import Own, Scratch, arrow_map, quoted, table, utf8

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ASSIGN_HINT = re.compile(rb"password|passwd|secret|token|api_?key", re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
LEAST = 20
_TOKEN = re.compile(r"[A-Za-z0-9+/=_-]{20,}")
_PART = re.compile(r"[^=]+(?:=+\Z)?")
_PIECES = [re.compile(f"[{c}]{{20,}}=*") for c in ("A-Za-z0-9+/", "A-Za-z0-9_-", "A-Za-z0-9")]

#: Encodings from narrow to wide, with their alphabets in order.
ENCODINGS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("alnum", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
_PLACES = [(name, frozenset(a), {c: i for i, c in enumerate(a)}) for name, a in ENCODINGS]
#: Steps of -log2 p in the histogram of p-values.
STEPS = 256


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the base kinds, in order of start, then kind."""
    out = []
    if _ASSIGN_HINT.search(text.encode()):
        out += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def _normal_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi2_p(x: float, df: int) -> float:
    """Upper tail by Wilson and Hilferty's cube root."""
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def fit(token: str) -> float:
    """How well the token fits a random draw from its encoding: 0 to 1."""
    core = token.rstrip("=")
    chars = set(core)
    places = next((p for _, a, p in _PLACES if chars <= a), None)
    if places is None or len(core) < 2:
        return 0.0
    size, n = len(places), len(core)
    x = np.fromiter(map(places.__getitem__, core), np.int64, n)
    # Few symbols for a wide alphabet: equal groups of neighbours, at least two expected in each.
    groups = max(2, min(size, n // 2))
    observed = np.bincount(x * groups // size, minlength=groups)
    expected = n * np.bincount(np.arange(size) * groups // size, minlength=groups) / size
    even = _chi2_p(float(((observed - expected) ** 2 / expected).sum()), groups - 1)
    high = x >= size / 2
    runs = 1 + int((high[1:] != high[:-1]).sum())
    run = _normal_p((runs - (n + 1) / 2) / math.sqrt((n - 1) / 4))
    centred = x - (size - 1) / 2
    serial = float((centred[1:] * centred[:-1]).sum()) / ((size * size - 1) / 12)
    return min(1.0, 3 * min(even, run, _normal_p(serial / math.sqrt(n - 1))))


def evidence(token: str, frequency: np.ndarray) -> int:
    """-log2 of the p-value that ordinary characters (frequency by code) make the token, rounded down."""
    core = token.rstrip("=")
    chars = set(core)
    size = next((len(p) for _, a, p in _PLACES if chars <= a), None)
    if size is None or not core:
        return 0
    codes = np.frombuffer(core.encode(), np.uint8)
    return int(min(STEPS - 1, max(0.0, -len(core) * math.log2(size) - np.log2(frequency[codes]).sum())))


def parts(run: str, least_fit: float) -> list[tuple[int, int, bool]]:
    """The parts of the run that are tested, and whether they look random.

    They are what is between inner equals signs, and where that does not look
    random, pieces between its other separators (but for those that overlap a
    random one).
    """
    out = []
    for m in _PART.finditer(run):
        if m.end() - m.start() < LEAST:
            continue
        random = fit(m[0]) >= least_fit
        out.append((*m.span(), random))
        taken: list[tuple[int, int]] = []
        for piece in () if random else _PIECES:
            for n in piece.finditer(run, m.start(), m.end()):
                a, b = n.span()
                if (a, b) != m.span() and not any(a < y and x < b for x, y in taken):
                    out.append((a, b, fit(n[0]) >= least_fit))
                    if out[-1][2]:
                        taken.append((a, b))
    return out


def tokens(text: str, base: list[tuple[int, int, int]], least_fit: float):
    """(start, end, looks random) of the tested parts of long runs that overlap no base span."""
    k, reach, starts = 0, [-1], [s[0] for s in base]
    for s in base:
        reach.append(max(reach[-1], s[1]))
    for m in _TOKEN.finditer(text):
        for a, b, random in parts(m[0], least_fit):
            a, b = a + m.start(), b + m.start()
            k = bisect.bisect_left(starts, b)
            if reach[k] <= a:
                yield a, b, random


def frequencies(docs: DataFrame) -> np.ndarray:
    """How often each byte is among the bytes of encodings in a column of texts, plus one each."""
    known = np.zeros(256, bool)
    known[list("".join(a for _, a in ENCODINGS).encode())] = True

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen = np.zeros(256, np.int64)
        for text in utf8(batch.column(0)):
            if text:
                for at in range(0, len(text), 1 << 20):
                    seen += np.bincount(np.frombuffer(text, np.uint8)[at : at + (1 << 20)], minlength=256)
        return pa.RecordBatch.from_arrays([pa.array(np.arange(256, dtype=np.int32)), pa.array(seen)], ["byte", "n"])

    got = arrow_map(docs, run, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect()
    counts = np.ones(256)
    for byte, n in got:
        counts[byte] += n
    return counts / counts[known].sum()


def threshold(histogram: dict[int, int], tested: int, rate: float) -> int:
    """The least -log2 p that Benjamini-Hochberg reports of so many tests; STEPS if none."""
    rank, best = 0, STEPS
    for step in sorted(histogram, reverse=True):
        rank += histogram[step]
        if step and 2.0**-step * tested <= rate * rank:
            best = step
    return best


def find(docs: DataFrame, keep: list[str], text_col: str = "text", rate: float = 0.01, least_fit: float = 0.001) -> DataFrame:
    """The columns keep of docs (but one named secrets), and secrets: an array of (kind, start, end) in order of start, then kind."""
    own = Own(docs.select(*[F.col(quoted(c)) for c in keep], F.col(quoted(text_col)).cast("string").alias("__text")), ["secrets"])
    text = own.name("__text")
    frequency = frequencies(own.df.select(text))
    span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("evidence", pa.int32())]))
    at = own.df.columns.index(text)
    rest = [c for c in own.df.columns if c != text]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out, tested = [], []
        for text in batch.column(at).to_pylist():
            text = text or ""
            base = base_spans(text)
            tries = list(tokens(text, base, least_fit))
            more = [(a, b, 3, evidence(text[a:b], frequency)) for a, b, random in tries if random]
            spans = sorted([(*s, None) for s in base] + more, key=lambda s: (s[0], s[2]))
            out.append([{"kind": k, "start": a, "end": b, "evidence": e} for a, b, k, e in spans])
            tested.append(len(tries))
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(out, span), pa.array(tested, pa.int64())], [*rest, "secrets", "tested"])

    new = "secrets array<struct<kind:int,start:int,end:int,evidence:int>>, tested long"
    schema = T.StructType([*own.df.select(*rest).schema.fields, *T._parse_datatype_string(new).fields])
    found = Scratch(docs.sparkSession, "secrets").table(arrow_map(own.df, run, schema), "found")
    tested = found.agg(F.sum("tested")).first()[0] or 0
    steps = found.select(F.explode("secrets").alias("s")).where("s.kind = 3").groupBy("s.evidence").agg(F.count("*").alias("n")).collect()
    least = threshold({r[0]: r[1] for r in steps}, tested, rate)
    names = F.array(*[F.lit(k) for k in KINDS])
    kept = F.filter("secrets", lambda s: (s["kind"] < 3) | (s["evidence"] >= least))
    secrets = F.transform(kept, lambda s: F.struct(names[s["kind"]].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select(*[F.col(own.name(c)).alias(c) for c in own.names if own.name(c) != text], secrets.alias("secrets"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents."""
    got = find(table(spark, sf_dir, "documents"), ["doc_id"])
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    of = lambda kind: F.filter("secrets", lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    base = F.filter("secrets", lambda s: s["kind"] != "random")
    return got.select("doc_id", *counts, F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"), F.array_join(F.transform("secrets", line), ",").alias("spans"))
