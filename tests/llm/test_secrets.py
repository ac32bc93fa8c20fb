import hashlib
import math
import random
import re
import string
from collections import Counter

from cellwright.llm import secrets as sc

ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def base(text):
    out = [(m.start(), m.end(), 0) for m in re.finditer(ASSIGN, text) if len(m[1]) >= 12]
    out += [(m.start(), m.end(), 1) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), m.end(), 2) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out, key=lambda s: (s[0], s[2]))


def expected(docs):
    out = {}
    for i, text in docs:
        b = base(text or "")
        line = ",".join(f"{sc.KINDS[k]}:{x}:{y}" for x, y, k in b)
        out[i] = (*(sum(s[2] == k for s in b) for k in range(3)), hashlib.sha256(line.encode()).hexdigest())
    return out


def rows(df):
    return {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in df.collect()}


def test_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sc.op9_secret_scan(spark, sf)
    assert rows(got) == expected(docs)
    assert all(r.spans == "" or set(x.split(":")[0] for x in r.spans.split(",")) <= set(sc.KINDS) for r in got.collect())


def test_hard_texts(spark, tables, documents):
    texts = ["é Token: 'abcdefabcdefabcdef0123' AKIA" + "A1" * 9 + " AKIAAKIAAKIA", "api-key=aaaaaaaaaaaa apikey=bbbbbbbbbbbb API_KEY : \"c.c=c-c/c+c_c\"", "ſecret=aaaaaaaaaaaaaa secreT==aaaaaaaaaaaa", "f" * 100_000, "token=" * 5_000, None, "", "password=" + "x" * 11]
    docs = list(enumerate(texts))
    assert rows(sc.op9_secret_scan(spark, tables(documents=documents(docs)))) == expected(docs)
    assert sc.op9_secret_scan(spark, tables(documents=documents([]))).count() == 0


def test_random_tokens_stand_out(documents):
    rng = random.Random(4)
    plain = ["internationalisation", "counterrevolutionaries", "electroencephalographically", "uncharacteristically", "thththththththththth"]
    keys = ["".join(rng.choice(string.ascii_letters + string.digits) for _ in range(40)) for _ in range(30)]
    docs = [(k, f"see {rng.choice(plain)} and {key} or {rng.choice(plain)} file_name_with_parts_{k:04d} zzzzzzzzzzzzzzzzzzzzzzzz1111") for k, key in enumerate(keys)] + [(99, None)]
    texts = dict(docs)
    found = [texts[r.doc_id][s.start : s.end] for r in sc.find(documents(docs), ["doc_id"]).collect() for s in r.secrets]
    assert sum(k in found for k in keys) >= 28
    assert not [f for f in found if f not in keys]


def test_values_joined_to_names(documents):
    rng = random.Random(11)
    b64, url = string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "-_"
    draw = lambda alphabet: "".join(rng.choice(string.ascii_letters) + "".join(rng.choice(alphabet) for _ in range(38)) + rng.choice(string.ascii_letters))
    forms = [("AWS_SECRET_ACCESS_KEY=%s", b64), ("session=%s", url), ("auth_key=%s==", b64), ("https://h.example/x?a=1&sig=%s&b=2", url), ("a=b=%s", b64), ("my_long_file_name-%s", b64)]
    want, docs = [], []
    for k in range(60):
        form, alphabet = forms[k % len(forms)]
        value = draw(alphabet)
        while "%s==" not in form and alphabet == b64 and not set("+/") & set(value):
            value = draw(alphabet)
        want.append((form, value + ("==" if "%s==" in form else "")))
        docs.append((k, f"set a_rather_long_name_of_things=internationalisation and {form % value} here"))
    texts = dict(docs)
    found = {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.secrets] for r in sc.find(documents(docs), ["doc_id"]).collect()}
    for form in dict(forms):
        hits = [found[k] == [v] for k, (f, v) in enumerate(want) if f == form]
        assert sum(hits) >= len(hits) - 1, form


def test_battery():
    rng = random.Random(8)
    fits = sorted(sc.fit("".join(rng.choice("0123456789abcdef") for _ in range(32))) for _ in range(200))
    assert fits[100] > 0.3 and fits[10] > 0.01
    assert sc.fit("ab" * 16) < 1e-4 and sc.fit("a" * 32) < 1e-6 and sc.fit("") == 0 == sc.fit("é" * 20)


def chi2_tail(x, df):
    """Upper tail of chi-squared by the series of the lower incomplete gamma function."""
    a, x = df / 2, x / 2
    term = total = 1 / a
    for k in range(1, 2000):
        term *= x / (a + k)
        total += term
    return 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a)) if x else 1.0


def plain_fit(core, alphabet):
    """The battery from its definition."""
    x = [alphabet.index(c) for c in core]
    n, size = len(x), len(alphabet)
    groups = max(2, min(size, n // 2))
    seen, room = Counter(i * groups // size for i in x), Counter(i * groups // size for i in range(size))
    even = chi2_tail(sum((seen[g] - n * room[g] / size) ** 2 / (n * room[g] / size) for g in range(groups)), groups - 1)
    two_sided = lambda z: math.erfc(abs(z) / math.sqrt(2))
    side = [i >= size / 2 for i in x]
    runs = 1 + sum(a != b for a, b in zip(side, side[1:], strict=False))
    run = two_sided((runs - (n + 1) / 2) / (math.sqrt(n - 1) / 2))
    mean, variance = (size - 1) / 2, (size**2 - 1) / 12
    serial = two_sided(sum((a - mean) * (b - mean) for a, b in zip(x, x[1:], strict=False)) / variance / math.sqrt(n - 1))
    return min(1.0, 3 * min(even, run, serial))


def test_battery_against_its_definition():
    rng = random.Random(3)
    for name, alphabet in sc.ENCODINGS[:1] + sc.ENCODINGS[3:5]:
        for _ in range(60):
            core = "".join(rng.choice(alphabet[: rng.choice([len(alphabet), len(alphabet) * 3 // 4])]) for _ in range(rng.randrange(20, 90)))
            if all(not set(core) <= set(a) for n, a in sc.ENCODINGS if n != name and len(a) <= len(alphabet)):
                assert abs(sc.fit(core) - plain_fit(core, alphabet)) < 0.03


def test_discoveries_against_a_plain_step_up(spark, documents):
    """Benjamini-Hochberg over the sorted p-values of all tested tokens."""
    rng = random.Random(21)
    words = ["internationalisation_of_things", "counterrevolutionaries", "a_long_file_name_of_parts", "ABCDEFGHIJKLMNOPQRSTUVWX"]
    docs = []
    for k in range(200):
        key = "".join(rng.choice(string.ascii_letters[: rng.choice([10, 26, 52])] + "0123") for _ in range(rng.randrange(20, 32)))
        docs.append((k, "some plain words of prose, " * 20 + f"{rng.choice(words)} plain words {key if k % 3 else rng.choice(words)} end"))
    frequency = Counter("".join(t for _, t in docs))
    known = set("".join(a for _, a in sc.ENCODINGS))
    whole = sum(frequency[c] + 1 for c in known)
    tests = []
    for i, t in docs:
        for m in re.finditer(r"[A-Za-z0-9+/=_-]{20,}", t):
            for a, b, looks in sc.parts(m[0], 0.001):
                core = m[0][a:b].rstrip("=")
                alphabet = next((x for _, x in sc.ENCODINGS if set(core) <= set(x)), None)
                bits = sum(-math.log2(len(alphabet)) - math.log2((frequency[c] + 1) / whole) for c in core) if looks else 0.0
                tests.append((2.0 ** -min(sc.STEPS - 1, max(0, int(bits))), (i, m.start() + a, m.start() + b)))
    assert any(p == 1 for p, _ in tests)
    tests.sort()
    last = max((k for k, (p, _) in enumerate(tests, 1) if p * len(tests) <= 0.01 * k), default=0)
    cut = tests[last - 1][0] if last else 0.0
    want = {span for p, span in tests if p <= cut and p < 1}
    got = {(r.doc_id, s.start, s.end) for r in sc.find(documents(docs), ["doc_id"]).collect() for s in r.secrets if s.kind == "random"}
    assert got == want and 20 < len(got) < len(tests)


def test_kept_columns_repeats_and_long_texts(documents):
    docs = documents([(None, "x" * 2_000_000 + " token=abcdefghijkl9"), (1, "AKIA" + "B7" * 9), (1, "AKIA" + "B7" * 9), (2, None)]).selectExpr("*", "'old' secrets", "'t' tested", "'o' own0")
    got = sc.find(docs, ["doc_id", "secrets", "tested", "own0"])
    assert got.columns == ["doc_id", "tested", "own0", "secrets"]
    assert sorted((r.doc_id or 0, r.tested, r.own0, len(r.secrets)) for r in got.collect()) == [(0, "t", "o", 1), (1, "t", "o", 1), (1, "t", "o", 1), (2, "t", "o", 0)]
