from collections import Counter

import corpus_pipeline as cp
from cellwright.llm import decontaminate, mixing, near_dedup, quality
from tests.llm.test_decontaminate import brute as hits
from tests.llm.test_near_dedup import brute as groups

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_one_by_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}

    good = cp.keep_good(spark, docs, sf).cache()
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    right = [(i in kept) == (labels[i] == (1, 0)) for i in labels]
    assert good.columns == COLUMNS and sum(right) > 0.95 * len(right)

    one = cp.keep_one_of_each(spark, good, sf).cache()
    expected = groups([(i, rows[i].text) for i in kept], width=5, percent=80)
    assert sorted(r.doc_id for r in one.collect()) == sorted({c for _, c in expected.values()})

    clean = cp.cut_benchmark(spark, one, sf).cache()
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    before = hits([(r.doc_id, r.text) for r in one.collect()], items)
    after = {r.doc_id: r for r in clean.collect()}
    assert set(after) == {i for i, h in before.items() if 2 * h[1] <= h[0]}
    assert all((r.text == rows[i].text) == (not before[i][4]) and r.n_chars == len(r.text or "") for i, r in after.items() if r.text is not None)
    assert any(h[4] for h in before.values())

    mixed = cp.mix_sources(spark, clean, sf).cache()
    copies = {r.doc_id: r.copies for r in mixing.mix(clean).collect() if r.copies}
    assert Counter(r.doc_id for r in mixed.collect()) == copies and max(copies.values()) <= 2

    last = cp.to_shards(spark, mixed, sf).collect()
    assert len(last) == sum(copies.values()) and all(0 <= r.shard < 40 for r in last)
    assert decontaminate and near_dedup and quality


def test_run_and_edges(spark, sf, tables, documents):
    got = cp.run(spark, sf)
    assert set(COLUMNS) < set(got.columns) and got.count() > 0
    labels = spark.read.parquet(f"{sf}/labels.parquet").limit(0)
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    folder = tables(documents=documents([]), labels=labels, benchmark=bench)
    assert cp.run(spark, folder).count() == 0


def test_rows_without_ids_and_repeats(spark, sf, documents):
    near = " ".join(f"w{k}" for k in range(60))
    docs = documents([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (None, "a b c d e f g"), (None, "quite another text here"), (None, "quite another text here"), (None, near), (None, near + " x"), (5, "another text with this id"), (5, "one more text with this id"), (None, None), (3, None), (4, "")])
    got = Counter((r.doc_id, r.text) for r in cp.keep_one_of_each(spark, docs, sf).collect())
    assert sum(got.pop((None, t), 0) for t in (near, near + " x")) == 1
    assert got == {(1, "a b c d e f g"): 1, (None, "quite another text here"): 1, (5, "another text with this id"): 1, (5, "one more text with this id"): 1, (None, None): 1, (3, None): 1, (4, ""): 1}
    assert cp.mix_sources(spark, docs, sf).columns == docs.columns
    assert cp.cut_benchmark(spark, docs, sf).count() == 13 and cp.to_shards(spark, docs, sf).count() == 13


def test_clashing_names_in_every_stage(spark, sf, documents):
    rows = [(k, f"plain text number {k} of some words that differ {k * 7} and more", f"s{k % 3}") for k in range(30)]
    odd = documents(rows).selectExpr("*", *[f"concat('{c}', doc_id) `{c}`" for c in ("__key", "kept", "spans", "__copies", "__part", "__good", "own0", "copies")])
    for _, stage in cp.STAGES:
        got = stage(spark, odd, sf)
        assert got.columns[: len(odd.columns)] == odd.columns
        assert all(r[c] == f"{c}{r.doc_id}" for r in got.collect() for c in odd.columns[5:])
