import hashlib
import random
import re

import regex

from cellwright.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def valid(kind, s):
    digits = re.sub(r"[^0-9]", "", s)
    return {"email": True, "ip": all(int(p) <= 255 for p in s.split(".") if kind == "ip"), "card": kind == "card" and 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]


def base(text):
    return [[(m.start(), m.end()) for m in re.finditer(p, text or "") if valid(k, m[0])] for k, p in PATTERNS.items()]


def rows(got):
    return {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got}


def expected(docs):
    out = {}
    for i, text in docs:
        found = base(text)
        line = ",".join(f"{k}:{a}:{b}" for k, spans in zip(PATTERNS, found, strict=True) for a, b in spans)
        out[i] = (*map(len, found), hashlib.sha256(line.encode()).hexdigest())
    return out


def test_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(pii.op8_bootstrapped_pii(spark, sf).collect()) == expected(docs)


def test_hard_texts(spark, tables, documents):
    texts = [
        "a@b.c_d@e.f.g x@y z@-.-", "@@a@b.c@d.e", "é𝔘 me@home.org 日本 1.2.3.4.5.6.7.8 999.1.1.1 01.002.0003.4 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112 4111 1111 1111 1111 2 0000000000000000000 00000000000000000000",
        "+1 (974) 555-3436, +44 20 7946 0958+4420 12345678 +1 2 +12345678901234567", "5 4111111111111111 7", "1-4111111111111111", "a" * 50_000, "1" * 50_000, "1." * 20_000, "a@" * 20_000, "+1 " * 9_000, None, "", "256.1.1.1.2 x.y@z.w", "99999999999.1.1.1",
    ]
    docs = list(enumerate(texts))
    assert rows(pii.op8_bootstrapped_pii(spark, tables(documents=documents(docs))).collect()) == expected(docs)


def test_patterns_find_unseen_identifiers(documents):
    docs = [(k, f"note {k} please mail address: user{k}@mail.example.org soon") for k in range(12)]
    docs += [(50, "we have address: jane(at)9876.example now"), (51, "the number 12345678 is a count"), (None, "our address: bob(at)5555.test again"), (None, None)]
    got = {(r.doc_id, len(r.email)): [(s.start, s.end) for s in r.context] for r in pii.find(documents(docs)).collect()}
    at = docs[12][1].index("jane")
    assert got[50, 0] == [(at, at + len("jane(at)9876.example"))]
    assert got[51, 0] == [] and got[3, 1] == []
    assert pii.find(documents([])).count() == 0


def test_discovered_identifiers_support_patterns(documents):
    docs = [(k, f"address: user{k}@mail.example.org") for k in range(40)]
    docs += [(100 + k, f"address: key{5000 + k}") for k in range(8)] + [(200 + k, f"account key{5000 + k}") for k in range(8)]
    docs += [(300, "account new9999"), (301, "count 12345")]
    got = {r.doc_id: [(s.start, s.end) for s in r.context] for r in pii.find(documents(docs)).collect()}
    assert got[100] == [(9, 16)] and got[200] == [(8, 15)]
    assert got[300] == [(8, 15)] and got[301] == []


def test_repeats_and_null_ids(documents):
    docs = [(1, "a@b.cd"), (1, "a@b.cd"), (None, "x"), (None, "1.2.3.4")]
    assert sorted((str(r.doc_id), len(r.email), len(r.ip)) for r in pii.find(documents(docs)).collect()) == [("1", 1, 0), ("1", 1, 0), ("None", 0, 0), ("None", 0, 1)]


def bootstrap(docs, support=5, least=0.7, rounds=3):
    """The spans of kind context, by plain loops over the definition."""
    seen = []
    for i, text in docs:
        text, spans = text or "", []

        def instances(matches):
            end = 0
            for a, b in matches:
                before = [re.sub("[0-9]", "0", w.lower()) for w in re.split(r"[\x20\x09-\x0D]+", text[end:a]) if w]  # noqa: B023
                end = b
                yield a, b, {" ".join(before[-n:]) for n in (1, 2) if len(before) >= n}  # noqa: B023

        for kind, pattern in pii.KINDS.items():
            for a, b, left in instances([m.span() for m in regex.finditer(pattern, text)]):
                if valid(kind, text[a:b]):
                    spans.append((a, b))
                    seen.append((i, a, b, text[a:b].lower(), True, left))
        words = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text) if "@" in m[0] or len(re.findall("[0-9]", m[0])) >= 4]
        seen += [(i, a, b, text[a:b].lower(), False, left) for a, b, left in instances(words) if not any(x < b and a < y for x, y in spans)]
    edges = {}
    for _, _, _, value, seed, left in seen:
        for p in left:
            edges.setdefault(p, {})[value] = edges.get(p, {}).get(value, False) or seed
    edges = {p: v for p, v in edges.items() if len(v) >= support}
    score, confidence = {}, {}
    for _ in range(rounds):
        confidence = {}
        for p, values in edges.items():
            known = [1.0 if seed else score.get(v, 0.0) for v, seed in values.items()]
            if sum(x >= least for x in known) >= support:
                confidence[p] = sum(known) / len(known)
        doubt = {}
        for p, c in confidence.items():
            for v, seed in edges[p].items():
                if not seed:
                    doubt[v] = doubt.get(v, 1.0) * max(1e-12, 1 - c)
        score = {v: 1 - d for v, d in doubt.items()}
    return {(i, a, b) for i, a, b, v, seed, left in seen if not seed and score.get(v, 0) >= least and any(confidence.get(p, 0) >= least for p in left)}


def test_bootstrap_against_plain_loops(spark, documents):
    rng = random.Random(5)
    cues, docs = ["mail to", "call me on", "my account", "invoice", "seen in", "the code"], []
    for k in range(400):
        text = []
        for _ in range(rng.randrange(1, 6)):
            seed, cue = rng.random(), rng.randrange(len(cues))
            share = (0.95, 0.9, 0.6, 0.3, 0.0, 0.8)[cue]
            real = rng.choice([f"u{rng.randrange(60)}@host.org", f"10.0.{rng.randrange(9)}.{rng.randrange(9)}", f"+1 555 {rng.randrange(100, 999)} 4321"])
            text.append(f"{cues[cue]}{rng.choice([' ', '  ', ': '])}{real if seed < share else f'id{rng.randrange(1000, 1060)}'} {rng.choice(['and', 'then', '', 'a long way from here'])}")
        docs.append((k, " ".join(text)))
    got = {(r.doc_id, s.start, s.end) for r in pii.find(documents(docs)).collect() for s in r.context}
    want = bootstrap(docs)
    assert got == want and want


def test_many_matches_far_words_and_extra_columns(documents):
    word = "w" * 300
    many = " ".join(f"x{k}@y.org" for k in range(30_000))
    rows = [(k, f"{word} u{k}@h.org") for k in range(6)] + [(10, f"{word} id12345"), (11, many)]
    docs = documents(rows).selectExpr("*", "'k' __key", "'e' email", "1 start")
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    assert [(s.start, s.end) for s in got[10].context] == [(301, 308)]
    spans = [(s.start, s.end) for s in got[11].email]
    assert spans == [m.span() for m in re.finditer(r"\S+", many)]
