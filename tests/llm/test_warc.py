import hashlib

import pytest

from cellwright.llm import warc


def brute(rows, least=1000):
    first = {}
    for i, html in rows:
        data = (html or "").encode()
        if len(data) >= least and i is not None:
            first[data] = max(i, first.get(data, i))
    out = []
    for i, html in rows:
        data = (html or "").encode()
        to = first.get(data)
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), *(("response", None) if to is None or to == i or i is None else ("revisit", to))))
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_query(spark, sf):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()]
    assert rows(warc.op5_warc_chunks(spark, sf)) == brute(pages)


HARD = "x\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\ny"


@pytest.fixture
def hard():
    return [
        (1, "a" * 1500), (2, "a" * 1500), (3, "a" * 1500), (9, "a" * 1500), (9, "a" * 1500), (4, None), (5, ""), (6, "é\r\n\r\n"), (7, "\r\n" + HARD * 3 + "\r\n"),
        (None, "b" * 1200), (None, "b" * 1200), (8, "short"), (10, "short"), (11, "日本" * 700 + "\r\n\r\nz"), (12, "日本" * 700 + "\r\n\r\nz"), (-3, "\n\x00 \r"),
    ]


def test_hard_payloads(spark, tables, hard):
    pages = spark.createDataFrame([(i, f"http://x/{i}\r\nWARC-Type: no" if i else None, h) for i, h in hard], "page_id long, url string, html string")
    assert rows(warc.op5_warc_chunks(spark, tables(pages=pages))) == brute(hard)
    assert warc.op5_warc_chunks(spark, tables(pages=pages.limit(0))).count() == 0


def test_chunks_round_trip(spark, tmp_path, hard):
    pages = spark.createDataFrame([(i, "u", h) for i, h in hard], "page_id long, url string, html string")
    warc.write(warc.records(pages, "page_id", "url", "html", 1000), str(tmp_path / "w"), chunk=7)
    chunks = warc.read(spark, str(tmp_path / "w"))
    back = {}
    for r in chunks.collect():
        assert r.valid and len(r.content) <= 7
        back.setdefault(r.record_id, {})[r.chunk_no] = r.content
    texts = sorted("".join(c[k] for k in sorted(c)) for c in back.values())
    expected = sorted("" if kind == "revisit" else (h or "") for (i, h), kind in [((i, h), next(x[3] for x in brute(hard) if x[0] == i and x[2] == hashlib.sha1((h or "").encode()).hexdigest())) for i, h in hard])
    assert len(texts) <= len(expected) and set(texts) == set(expected)
    whole = warc.payloads(chunks).where("type = 'response'").collect()
    assert all(r.valid and r.sha1 == r.payload_digest and r.bytes == r.payload_bytes for r in whole)


def test_long_payload_in_chunks(spark, tmp_path):
    long = "0123456789abcdé\r\n" * 1_000_000
    pages = spark.createDataFrame([(1, "u", long, "x"), (2, None, long, "x"), (3, "v", "short", "x")], "page_id long, url string, html string, content string")
    warc.write(warc.records(pages, "page_id", "url", "html", 1000), str(tmp_path / "w"))
    chunks = warc.read(spark, str(tmp_path / "w"))
    sizes = sorted((r.chunk_no, r.n) for r in chunks.selectExpr("chunk_no", "length(content) n", "type").where("type <> 'revisit'").collect())
    assert max(n for _, n in sizes) == 1 << 16 and sum(n for _, n in sizes) == len(long) + 5
    got = {r.type: r for r in warc.payloads(chunks).where("payload_bytes > 5").collect()}
    assert got["response"].valid and got["response"].sha1 == hashlib.sha1(long.encode()).hexdigest() == got["revisit"].payload_digest
    broken = warc.payloads(chunks.where("chunk_no <> 7").coalesce(1)).where("type = 'response' and payload_bytes > 5").first()
    assert not broken.valid
