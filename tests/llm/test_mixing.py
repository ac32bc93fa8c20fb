import itertools
import random
import re

from pyspark.sql import functions as F

from cellwright.llm import mixing as mx


def brute_targets(sizes, share=1.5, most=2.0):
    """Water filling by rounds."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > most * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in free}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= full
    return out


def check(rows, got):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    wanted = brute_targets(sizes)
    assert sorted((r.doc_id, r["size"]) for r in got) == sorted((i, size(t)) for i, t, _ in rows)
    source = {i: s for i, _, s in rows}
    taken = {}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - wanted[s]) < 1e-6 * (1 + wanted[s])
        assert r.taken <= 2 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
        taken[s] = taken.get(s, 0) + r.taken
    return taken, wanted


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    got = mx.op7_mixing(spark, sf).collect()
    taken, wanted = check(rows, got)
    # As near as any choice of documents can come: every one once or not at all, or once or twice.
    for s in wanted:
        sizes = [len(re.findall(mx.WORD, t or "")) for _, t, x in rows if x == s]
        times = int(wanted[s] // sum(sizes)) if sum(sizes) else 0
        reach = 1
        for n in sizes:
            reach |= reach << n
        best = (reach & ((1 << round(wanted[s]) - times * sum(sizes) + 1) - 1)).bit_length() - 1
        assert taken[s] == times * sum(sizes) + best
    assert sorted(map(str, mx.op7_mixing(spark, sf).collect())) == sorted(map(str, got))


def test_fit_against_all_subsets():
    rng = random.Random(2)
    for _ in range(200):
        sizes = sorted(rng.sample(range(1, 40), rng.randrange(1, 5)))
        counts = [rng.randrange(1, 4) for _ in sizes]
        whole = sum(s * c for s, c in zip(sizes, counts, strict=True))
        budget = rng.randrange(whole + 1)
        take = mx.fit(budget, sizes, counts)
        assert all(0 <= t <= c for t, c in zip(take, counts, strict=True))
        got = sum(s * t for s, t in zip(sizes, take, strict=True))
        best = max(x for x in (sum(s * t for s, t in zip(sizes, p, strict=True)) for p in itertools.product(*[range(c + 1) for c in counts])) if x <= budget)
        assert got == best
    assert mx.fit(10, [7, 3], [5, 5], window=4) in ([1, 1], [0, 3])
    big = mx.fit(1_000_003, list(range(50, 2000)), [3] * 1950, window=1000)
    assert sum(s * t for s, t in zip(range(50, 2000), big, strict=True)) == 1_000_003
    huge = mx.fit(9_000_000, [4_000_001, 3_999_999, 1_000_000, 7], [2, 2, 1, 50_000])
    assert sum(s * t for s, t in zip([4_000_001, 3_999_999, 1_000_000, 7], huge, strict=True)) == 9_000_000


def test_edges(documents):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, None), (3, "", "y"), (4, "d e", None), (5, "one", "Z")] + [(k, "same words here", "hot") for k in range(10, 60)]
    docs = documents(rows)
    taken, wanted = check(rows, mx.mix(docs).collect())
    assert all(abs(taken[s] - wanted[s]) <= 3 for s in wanted)
    out = mx.mixed(docs).collect()
    assert sum(len((r.text or "").split()) for r in out) == sum(taken.values())
    odd = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in ("__copies", "__k", "__mark", "__copy", "__id", "mark", "copies", "own0")})
    got = mx.mixed(odd)
    assert got.columns == odd.columns and all(r["__copies"] == f"__copies{r.doc_id}" and r.own0 == f"own0{r.doc_id}" for r in got.collect())
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in out)
    long = documents([(None, "word " * 500_000, "x"), (None, "word " * 500_000, "x"), (1, "a b", "y")])
    assert sum(r.taken for r in mx.mix(long).collect() if r["size"] == 500_000) <= 2_000_000
    assert mx.mix(documents([])).count() == 0 and mx.mixed(documents([])).count() == 0
