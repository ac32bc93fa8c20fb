import random

import numpy as np

from cellwright.llm import near_dedup as nd


def brute(rows, width=3, percent=85):
    """(set size, component) of each id, from all pairs."""

    def shingles(text):
        w = (text or "").encode().lower().split()
        if not w:
            return frozenset()
        return frozenset([tuple(w)]) if len(w) < width else frozenset(zip(*(w[k:] for k in range(width)), strict=False))

    sets = {i: shingles(t) for i, t in rows}
    at = {i: i for i in sets}

    def top(x):
        while at[x] != x:
            x = at[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            both = len(a & b)
            if a and b and 100 * both >= percent * (len(a) + len(b) - both):
                x, y = top(i), top(j)
                at[max(x, y)] = min(x, y)
    return {i: (len(s), top(i)) for i, s in sets.items()}


def test_matches_all_pairs(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.op1_minhash_near_dedup(spark, sf).collect()}
    assert got == brute(rows)


def test_group_of_near_copies_and_border(documents):
    rng = random.Random(1)
    base = [f"w{rng.randrange(10_000)}" for _ in range(120)]
    rows = []
    for k in range(40):
        w = list(base)
        for _ in range(rng.randrange(8)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10_000)}"
        rows.append((100 - k, " ".join(w)))
    rows += [(200, "one two"), (201, "ONE\ttwo"), (202, ""), (203, None), (204, " \n "), (205, "one"), (5, "a b c d"), (6, "a b c d")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.components(documents(rows), width=3, percent=85).collect()}
    assert got == brute(rows)


def by_rows(rows, **options):
    """Components of rows whose ids may be null or repeat: brute force on row numbers, named afterwards."""
    found = brute([(k, t) for k, (_, t) in enumerate(rows)], **options)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            c = found[k][1]
            least[c] = min(least.get(c, i), i)
    return [(i, found[k][0], least.get(found[k][1])) for k, (i, _) in enumerate(rows)]


def test_null_ids_bridge_and_repeated_ids(documents):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10_000)}" for _ in range(100)]
    left, right = ["l"] * 5 + base[5:], base[:-5] + ["r"] * 5
    texts = [" ".join(w) for w in (left, base, right)]
    other = " ".join(f"v{k}" for k in range(50))
    rows = [(1, texts[0]), (None, texts[1]), (2, texts[2]), (9, other), (9, texts[2] + " x"), (None, other + " y"), (None, "only here and now"), (None, "only here and now"), (None, None), (None, "")]
    got = nd.components(documents(rows), width=3, percent=85).collect()
    assert len(brute([(1, texts[0]), (2, texts[2])])) == 2 and brute([(1, texts[0]), (2, texts[2])])[2][1] == 2
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=key) == sorted(by_rows(rows), key=key)
    for r in got:
        assert r.kept == (r.doc_id == r.component_id)
    shuffled = nd.components(documents(rows).repartition(7), width=3, percent=85).collect()
    assert sorted(map(str, shuffled)) == sorted(map(str, got))


def test_null_ids_repeats_and_empty_table(documents):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "only here and now"), (None, None)]
    got = sorted(map(str, nd.components(documents(rows), width=3, percent=85).collect()))
    kept = [r for r in nd.components(documents(rows), width=3, percent=85).collect() if r.kept]
    assert len(got) == 5 and len(kept) == 4
    assert nd.components(documents([])).count() == 0 and nd.one_of_each(documents([])).count() == 0


def test_long_texts_and_extra_columns(documents):
    rng = random.Random(8)
    long = [f"w{rng.randrange(100_000)}" for _ in range(300_000)]
    near = list(long)
    near[1000] = "changed"
    docs = documents([(3, " ".join(long)), (2, " ".join(near)), (7, "quite short text of its own")])
    odd = docs.selectExpr("*", "'k' key", "'k2' __key", "'b' best", "'o' own0", "'s' `x.y`")
    got = nd.components(odd, width=3, percent=85).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(2, 2), (3, 2), (7, 7)]
    kept = nd.one_of_each(odd)
    assert kept.columns == odd.columns and sorted((r.doc_id, r.key, r["__key"], r.best, r.own0, r["x.y"]) for r in kept.collect()) == [(2, "k", "k2", "b", "o", "s"), (7, "k", "k2", "b", "o", "s")]


def test_keys_find_all_pairs_within_the_distance():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 16, (200, nd.PERMS), np.uint16)
    b = a.copy()
    for row in b:
        row[rng.choice(nd.PERMS, nd.MAX_ERRORS, replace=False)] ^= 1
    assert all((x == y).any() for x, y in zip(nd.bucket_keys(a, nd.MAX_ERRORS), nd.bucket_keys(b, nd.MAX_ERRORS), strict=True))


def test_distance_for_a_similarity():
    assert nd.errors_for(85) == nd.MAX_ERRORS and nd.errors_for(80) > nd.MAX_ERRORS and nd.errors_for(100) == 1
