import hashlib
import random
import re

from cellwright.llm import decontaminate as dc

_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return _WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    windows = {}
    for item, t in items:
        b = words(t)
        size = min(window, len(b))
        for k in range(len(b) - size + 1) if b else ():
            windows.setdefault(size, {}).setdefault(tuple(b[k : k + size]), set()).add(str(item))
    out = {}
    for i, text in docs:
        w = words(text)
        hit, found = set(), set()
        for size, known in windows.items():
            for a in range(len(w) - size + 1):
                if (of := known.get(tuple(w[a : a + size]))) is not None:
                    hit |= set(range(a, a + size))
                    found |= of
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def rows(df):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()}


def test_matches_brute_force_on_generated_text(spark, tables, documents):
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefgh") + rng.choice(["", "é", "7"])
    items = [(k, " ".join(word() for _ in range(rng.choice([0, 2, 9, 10, 11, 25])))) for k in range(30)] + [(31, None), (2, "a-A b")]
    docs = []
    for k in range(60):
        text = [word() for _ in range(rng.randrange(80))]
        for _ in range(rng.randrange(3)):
            t = items[rng.randrange(30)][1].split()
            a = rng.randrange(len(t) + 1)
            text[rng.randrange(len(text) + 1) : 0] = t[a : a + rng.randrange(8, 14)]
        docs.append((k, ", ".join(text).upper() if k % 3 else " ".join(text)))
    docs += [(100, None), (101, ""), (102, "-- !")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    folder = tables(documents=documents(docs), benchmark=bench)
    expected = brute(docs, items)
    assert rows(dc.op3_decontaminate(spark, folder)) == expected
    many = dc.find(documents(docs), bench, max_words=60)
    assert {r.doc_id: (r.n_words, r.n_hit, len(r["items"])) for r in many.collect()} == {k: v[:3] for k, v in expected.items()}
    one = {r.doc_id: (r.spans, r["items"], r.longest) for r in dc.find(documents(docs), bench).collect()}
    assert {r.doc_id: (r.spans, r["items"], r.longest) for r in many.collect()} == one


def test_clean(spark, documents):
    item = " ".join(f"q{k}" for k in range(12))
    docs = documents([(1, "start " + "here and there " * 10 + item.upper() + "! end."), (2, item), (3, "é clean"), (4, None)])
    got = {r.doc_id: r for r in dc.clean(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()}
    assert sorted(got) == [1, 3, 4]
    assert got[1].text == "start " + "here and there " * 10 + "! end." and got[1].n_chars == len(got[1].text)
    assert got[3].text == "é clean" and got[4].text is None
    more = docs.withColumnsRenamed({"lang": "Spans", "source": "items"})
    again = dc.clean(more, spark.createDataFrame([(9, item)], "item_id long, text string"))
    assert again.columns == more.columns and {r.items for r in again.collect()} == {"s"}


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.find(documents([]), none).count() == 0
    assert dc.find(documents([(1, "a b")]), none).first().n_hit == 0


def test_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = rows(dc.op3_decontaminate(spark, sf))
    assert got == brute(docs, items)


def test_long_text_repeats_null_ids_and_names(spark, documents):
    item = " ".join(f"q{k}" for k in range(30))
    long = "plain words of a long text " * 200_000 + item + " more " * 10
    docs = documents([(None, long), (1, item), (1, item), (None, None)])
    odd = docs.selectExpr("*", "'r' __row", "'t' __text", "'o' own0", "'x' start")
    bench = spark.createDataFrame([(7, item), (7, item), (None, "only here")], "item_id long, text string")
    for options in ({}, {"max_words": 30}):
        got = dc.find(odd, bench, **options)
        assert got.columns == odd.columns + dc.NEW
        assert sorted((r.n_words, r.n_hit, tuple(r["items"])) for r in got.collect()) == [(0, 0, ()), (30, 30, ("7",)), (30, 30, ("7",)), (1_200_040, 30, ("7",))]
        assert {(r["__row"], r["__text"], r.own0, r.start) for r in got.collect()} == {("r", "t", "o", "x")}


def test_size_of_the_automaton():
    rng = random.Random(1)
    items = [(k, [b"w%d" % int(rng.paretovariate(0.8)) for _ in range(100)]) for k in range(300)]
    found = dc.Automaton(items, 10).sizes()
    assert found["states"] <= 2 * 30_000 and found["transitions"] <= 3 * 30_000 and found["bytes"] < 200 * 30_000
