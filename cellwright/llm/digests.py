"""Quartile bucket digests of texts, and the difference of two digests.

Three byte triplets start at each byte of the UTF-8 text (the bytes at offsets
0-1-2, 0-1-3 and 0-2-4); each is hashed to one of 128 buckets and counted.  A
bucket's code is its count's place among the quartiles of all counts (0 to 3).
The digest is hexadecimal: two digits for the length on a log scale, two for
the ratios of the quartiles, 64 for the codes.  Equal texts have equal digests.

Two digests differ by the sum of their codes' distances (a distance of 3 counts
6), plus up to 12 for each of the two header bytes.  ``likeness`` is 1 for equal
digests and falls to 0 at the difference that random codes have.  A text of
under 5 bytes has no triplets: its digest is its length's, and it is like
another only so far as their digests agree.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import partitions, sliced, table

BUCKETS = 128
_GAPS = ((1, 2), (1, 3), (2, 4))
_PAIR = np.array([0, 1, 2, 6])
#: The mean distance of two independent codes, times the buckets.
_RANDOM = BUCKETS * (6 * 1 + 4 * 2 + 2 * 6) / 16


def counts(data: bytes) -> np.ndarray:
    """Hashed triplets per bucket."""
    out = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(data) - 4, 1 << 20):
        b = np.frombuffer(data, np.uint8)[at : at + (1 << 20) + 4].astype(np.uint32)
        n = len(b) - 4
        for k, (x, y) in enumerate(_GAPS):
            v = b[:n] | b[x : n + x] << np.uint32(8) | b[y : n + y] << np.uint32(16)
            v += np.uint32(k << 24)
            v *= np.uint32(0x9E3779B1)
            v ^= v >> np.uint32(15)
            v *= np.uint32(0x85EBCA77)
            out += np.bincount(v >> np.uint32(25), minlength=BUCKETS)
    return out


def digest(data: bytes) -> bytes:
    """Length byte, quartile byte, and four codes a byte."""
    c = counts(data)
    q1, q2, q3 = (int(x) for x in np.partition(c, (31, 63, 95))[[31, 63, 95]])
    codes = (c > q1).astype(np.uint8) + (c > q2) + (c > q3)
    length = min(255, round(math.log1p(len(data)) / math.log(1.1)))
    ratio = (15 * q1 // q3 << 4 | 15 * q2 // q3) if q3 else 0
    four = codes.reshape(-1, 4)
    return bytes([length, ratio]) + (four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3]).tobytes()


def _codes(body: bytes) -> np.ndarray:
    b = np.frombuffer(body, np.uint8)
    return np.stack([b >> 6, b >> 4 & 3, b >> 2 & 3, b & 3]).astype(np.int8)


def likeness(a: bytes, b: bytes) -> float:
    """From 0 (as different as random digests) to 1 (equal)."""
    difference = int(_PAIR[np.abs(_codes(a[2:]) - _codes(b[2:]))].sum())
    difference += min(12, abs(a[0] - b[0])) + min(12, abs((a[1] >> 4) - (b[1] >> 4)) + abs((a[1] & 15) - (b[1] & 15)))
    return max(0.0, 1.0 - difference / (_RANDOM + 24))


def _in_order(docs: DataFrame, most_blocks: int = 65_536, rows: int = 4096) -> DataFrame:
    """docs (doc_id, text) in descending id within blocks, each with its follower at its end.

    Blocks are ranges of ids between approximate quantiles, which are ids
    themselves; the largest id of a block also goes to the block that comes
    before it (halo), so every row's follower is at hand.
    """
    seen = docs.agg(F.count("*").alias("n"), F.max("doc_id").alias("top")).first()
    blocks = max(1, min(most_blocks, seen["n"] // rows))
    ends: list[int] = []
    if seen["top"] is not None:
        shares = [k / blocks for k in range(1, blocks)]
        if shares:
            ends = docs.agg(F.percentile_approx("doc_id", shares, min(1_000_000, max(10_000, 4 * blocks))).alias("q")).first()["q"]
        ends = sorted({*ends, seen["top"]})
    ends = np.array(ends, np.int64)

    def blocks_of(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        value = ids.fillna(0).astype("int64").to_numpy()
        at = np.where(known, np.searchsorted(ends, value), 0)
        last = known & (len(ends) > 1) & (ends[np.minimum(at, max(0, len(ends) - 1))] == value if len(ends) else False)
        return pd.Series([[a, (a + 1) % len(ends)] if x else [a] for a, x in zip(at.tolist(), last.tolist(), strict=True)])

    dealt = docs.select("*", F.posexplode(F.pandas_udf(blocks_of, "array<int>")("doc_id")).alias("halo", "block"))
    return dealt.repartition(partitions(docs.sparkSession), "block").sortWithinPartitions("block", "halo", F.desc_nulls_last("doc_id"), F.desc_nulls_last("text"))


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rows(batches):
    """Each row with the text of the row after it in its block."""
    held, first = None, None
    for batch in (part for whole in batches for part in sliced(whole)):
        for doc_id, text, halo, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = text or ""
            if held is not None and held[2] != block:
                yield held[0], held[1], first[1]
                held = None
            if held is None:
                first = (doc_id, text)
            else:
                yield held[0], held[1], text
            held = None if halo else (doc_id, text, block)
    if held is not None:
        yield held[0], held[1], first[1]


def _compared(batches):
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    out: list[tuple] = []
    kept: tuple[str, bytes] | None = None  # the last follower and its digest
    for doc_id, text, after in _rows(batches):
        own = kept[1] if kept and kept[0] is text else digest(text.encode())
        kept = (after, digest(after.encode()))
        half = len(text) // 2
        edited = (text[: len(text) - half] + after[:half]).encode()
        new = digest(edited)
        out.append((doc_id, len(text), hashlib.sha256(edited).hexdigest(), own.hex(), new.hex(), likeness(own, new), likeness(own, kept[1])))
        if len(out) >= 2048:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of each text, of its edited text, and their likeness.

    The edited text has its last half replaced by as much of the next document
    in descending id; after the last comes the first.  A null text is empty,
    null ids come last, and rows of one id go by text, greatest first.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _in_order(docs).select("doc_id", "text", "halo", "block").mapInArrow(_compared, _SCHEMA)


def op4_quartile_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of documents and of their edited texts."""
    return compare(table(spark, sf_dir, "documents"))
