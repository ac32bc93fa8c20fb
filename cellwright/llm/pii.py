"""Personal data: base patterns, and bootstrapped contextual extraction.

Base kinds are regular expressions with checks (see ``KINDS``).  Their matches
are the seed entities of the bootstrap:

* an instance is the text of an entity, or of a word with at least four digits or
  an @ that is no base match;
* a pattern is an instance's left context: the last word, or the last two words,
  between the match before it (of its kind, passing the checks or not) and itself, whole,
  in lower case with digits as 0;
* the graph has an edge from each pattern to each instance seen after it.

Scores go to and fro over the graph, ``rounds`` times: a pattern's score is the
mean score of its instances (seeds have 1, others what they have so far), but 0
with fewer than ``support`` different instances whose score reaches ``least``, so
that what one round finds admits patterns in the next; an instance's score is one
minus the product of its patterns' doubts.  Words whose score reaches ``least`` at the end,
after a pattern that reaches it too, are reported with kind ``context``.

Everything is DataFrame functions.  Contexts and instances are grouped by value
with partial aggregation, facts of a pattern are joined by a salt, too, so a
frequent pattern is no hot spot, and each text is read once.  Places and contexts
come from the gaps between matches and running sums in blocks, so a text costs
little more than its length, however many matches it has.

Positions are code points; ends are exclusive.  Nulls and empty texts: a null text
is empty; rows are told apart by id and a hash of the text, so null and repeated
ids work; identical rows get identical results.  Very long texts stay whole.
Ties: instances of one text have one score, patterns of one context one
confidence.  An empty table gives an empty result.  Other columns of docs play no
part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import Scratch, quoted, table, with_hot

# The base patterns.  They match what these match, leftmost and without overlap,
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#   ip    [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card  [0-9]([\x20-]?[0-9])+  of 16 to 19 digits
#   phone \+[0-9][\x20().0-9-]+[0-9]
# but start only where a match can start, and give nothing back, so long words cost no more than their length.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_WORD = r"(?<![^\x20\x09-\x0D])(?=[^\x20\x09-\x0D]*+@|(?:[^\x20\x09-\x0D0-9]*+[0-9]){4})[^\x20\x09-\x0D]++"
#: Matches whose places are added up together.
_BLOCK = 256
_MATCH = "array<struct<start:int,end:int,value:string,one:string,two:string>>"


def _blocks(array: str) -> Column:
    """The array column (not empty) cut into blocks."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(array) - 1) / _BLOCK).cast("int")), lambda b: F.slice(array, b * _BLOCK + 1, _BLOCK))


def _running(df: DataFrame, name: str, sizes: Column) -> DataFrame:
    """df with, for each of an array of numbers, the sum of those before it: in blocks, then between blocks."""

    def sums(values: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(values, first, step, lambda acc: acc["out"])

    df = df.withColumn("__sizes", sizes)
    df = df.withColumn("__blocks", F.when(F.size("__sizes") > 0, _blocks("__sizes")))
    df = df.withColumn("__from", sums(F.transform("__blocks", lambda block: F.aggregate(block, F.lit(0), lambda acc, x: acc + x)), F.lit(0)))
    return df.withColumn(name, F.flatten(F.zip_with("__blocks", "__from", sums))).drop("__sizes", "__blocks", "__from")


def _found(df: DataFrame, name: str, pattern: str, hint: Column | None) -> DataFrame:
    """df with the pattern's matches in column name, with their places and the words before them.

    The gaps between the matches come from a split by the same pattern.
    """
    text, none = F.col("__text"), F.array().cast("array<string>")
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    df = df.withColumn("__m", matches if hint is None else F.when(hint, matches).otherwise(none))
    df = df.withColumn("__g", F.when(F.size("__m") > 0, F.slice(F.split(text, pattern, -1), 1, F.size("__m"))).otherwise(none))
    df = _running(df, "__at", F.zip_with("__m", "__g", lambda m, g: F.length(g) + F.length(m)))
    plain = lambda word: F.nullif(F.regexp_replace(F.lower(F.reverse(word)), "[0-9]", "0"), F.lit(""))

    def placed(x: Column) -> Column:
        begin, back = x["__at"] + F.length(x["__g"]), F.reverse(x["__g"])
        one, two = (F.regexp_extract(back, r"^[\x20\x09-\x0D]*+([^\x20\x09-\x0D]++)(?:[\x20\x09-\x0D]++([^\x20\x09-\x0D]++))?", k) for k in (1, 2))
        return F.struct(begin.alias("start"), (begin + F.length(x["__m"])).alias("end"), x["__m"].alias("value"), plain(one).alias("one"), plain(two).alias("two"))

    return df.withColumn(name, F.coalesce(F.transform(F.arrays_zip("__m", "__g", "__at"), placed), F.array()).cast(_MATCH)).drop("__m", "__g", "__at")


def _luhn(value: Column) -> Column:
    digits = F.reverse(F.regexp_replace(value, "[^0-9]", ""))

    def weighed(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        double = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 0, double).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + weighed(i)) % 10 == 0


def _valid(kind: str) -> Callable[[Column], Column]:
    """The check that a match of the kind must pass."""
    digits = lambda s: F.length(F.regexp_replace(s["value"], "[^0-9]", ""))
    small = lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(256)) <= 255)
    return {
        "email": lambda s: F.lit(True),
        "ip": lambda s: F.forall(F.split(s["value"], r"\."), small),
        "card": lambda s: _luhn(s["value"]),
        "phone": lambda s: digits(s).between(8, 15),
    }[kind]


def _spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, __key, a column of spans for each kind, and words: other words like identifiers, in context."""
    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    df = docs.select(F.col(quoted(id_col)).alias("doc_id"), text.alias("__text")).withColumn("__key", F.xxhash64("doc_id", "__text"))
    hints = {"email": F.contains("__text", F.lit("@")), "phone": F.contains("__text", F.lit("+"))}
    for kind, pattern in KINDS.items():
        df = _found(df, f"__{kind}", pattern, hints.get(kind))
        df = df.withColumn(kind, F.filter(f"__{kind}", _valid(kind))).drop(f"__{kind}")
    df = df.withColumn("__base", F.concat(*KINDS))
    df = _found(df, "__words", _WORD, None)
    # A word overlaps a base match in few of the blocks of matches.
    block = lambda b: F.struct(F.array_min(F.transform(b, lambda s: s["start"])).alias("lo"), F.array_max(F.transform(b, lambda s: s["end"])).alias("hi"), F.transform(b, lambda s: F.struct(s["start"], s["end"])).alias("spans"))
    near = F.when((F.size("__base") > 0) & (F.size("__words") > 0), F.transform(_blocks("__base"), block))
    meets = lambda s, a, b, w: (s[a] < w["end"]) & (w["start"] < s[b])
    apart = lambda n: lambda w: ~F.coalesce(F.exists(n, lambda b: meets(b, "lo", "hi", w) & F.exists(b["spans"], lambda s: meets(s, "start", "end", w))), F.lit(False))
    # The transform binds the blocks to a name: they are made once a text, not once a word.
    others = F.transform(F.array(near), lambda n: F.filter("__words", apart(n)))[0]
    instance = lambda seed: lambda s: F.struct(s["start"], s["end"], F.lower(s["value"]).alias("value"), s["one"], s["two"], F.lit(seed).alias("seed"))
    context = F.concat(F.transform("__base", instance(True)), F.transform(others, instance(False)))
    plain = [F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))).alias(k) for k in KINDS]
    return df.select("doc_id", "__key", *plain, F.when(F.size("__base") + F.size("__words") > 0, context).alias("__context"))


def _discovered(spans: DataFrame, scratch: Scratch, support: int, least: float, rounds: int) -> DataFrame:
    """doc_id, __key and __more: the spans that confident patterns add."""
    seen = spans.where("__context is not null").select("doc_id", "__key", F.inline("__context"))
    both = F.array_compact(F.array("one", F.concat("two", F.lit(" "), "one")))
    seen = seen.select("doc_id", "__key", "start", "end", "value", "seed", F.explode(both).alias("pattern"))
    edges = scratch.table(seen.groupBy("pattern", "value").agg(F.max("seed").alias("seed")), "edges")
    # Patterns of fewer instances can never have the support.
    enough = edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= support).select("pattern")
    edges = scratch.table(with_hot(edges, enough, "pattern", "value"), "supported")
    scores = None
    patterns = None
    for k in range(rounds):
        known = edges if scores is None else edges.join(scores, "value", "left")
        score = F.when(F.col("seed"), 1.0).otherwise(F.lit(0.0) if scores is None else F.coalesce("score", F.lit(0.0)))
        patterns = known.groupBy("pattern").agg(F.avg(score).alias("confidence"), F.count_if(score >= least).alias("n")).where(F.col("n") >= support)
        patterns = scratch.table(patterns.drop("n"), f"patterns{k}")
        doubt = F.ln(F.greatest(F.lit(1e-12), 1 - F.col("confidence")))
        scores = with_hot(edges.where("not seed"), patterns, "pattern", "value").groupBy("value").agg((1 - F.exp(F.sum(doubt))).alias("score"))
        scores = scratch.table(scores, f"scores{k}")
    scratch.drop("edges", "supported", *[f"{t}{k}" for t in ("patterns", "scores") for k in range(rounds - 1)])
    sure = with_hot(seen.where("not seed"), patterns.where(F.col("confidence") >= least).select("pattern"), "pattern", "value", "__key")
    sure = sure.join(scores.where(F.col("score") >= least).select("value"), "value")
    return sure.groupBy("doc_id", "__key").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("__more"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = 5, least: float = 0.7, rounds: int = 3) -> DataFrame:
    """Per row of docs: doc_id, and arrays of spans email, ip, card, phone (start, end, value) and context (start, end)."""
    scratch = Scratch(docs.sparkSession, "pii")
    spans = scratch.table(_spans(docs, id_col, text_col), "spans")
    more = _discovered(spans, scratch, support, least, rounds)
    more = more.select(F.col("doc_id").alias("__id"), F.col("__key").alias("__k"), "__more")
    got = spans.drop("__context").join(more, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__k")), "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    return got.select("doc_id", *KINDS, F.coalesce("__more", none).alias("context"))


def op8_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents."""
    got = find(table(spark, sf_dir, "documents"))
    lines = lambda kind: F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))
    base = F.concat(*[lines(k) for k in KINDS])
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return got.select("doc_id", *counts, F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, lines("context")), ",").alias("spans"))
