import hashlib

from cellwright.llm import digests as dg


def brute(rows):
    """(n_chars, sha256 of the edited text) by id."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    out = {}
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        out.setdefault(i, []).append((len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()))
    return {k: sorted(v) for k, v in out.items()}


def got(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append((r.n_chars, r.edited_sha256))
    return {k: sorted(v) for k, v in out.items()}


def test_query_matches_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(dg.op4_quartile_digests(spark, sf)) == brute(rows)


def test_blocks_nulls_ties(documents, monkeypatch):
    monkeypatch.setattr(dg._in_order, "__defaults__", (65_536, 3))
    rows = [(k * 7, f"text number {k} é" * (k % 5)) for k in range(40)] + [(None, "nameless"), (3, None), (7, "again"), (7, "again")]
    assert got(dg.compare(documents(rows))) == brute(rows)
    for few in ([(1, "alone here")], [(None, "x" * 9), (None, None)], []):
        assert got(dg.compare(documents(few))) == brute(few)


def test_likeness():
    text = b"the quick brown fox jumps over the lazy dog again and again, " * 30
    other = bytes(range(256)) * 8
    a, b, c = dg.digest(text), dg.digest(text.replace(b"lazy", b"idle", 5)), dg.digest(other)
    assert len(a.hex()) == 68 and dg.digest(text) == a
    assert dg.likeness(a, a) == 1 and dg.likeness(a, b) > dg.likeness(a, c) >= 0
    assert dg.likeness(a, b) == dg.likeness(b, a)
    assert dg.digest(b"") == dg.digest(b"") and 0 <= dg.likeness(dg.digest(b""), a) <= 1
    big = bytes(k * k % 251 for k in range(3_000_000))
    assert dg.counts(big).sum() == 3 * (len(big) - 4)
