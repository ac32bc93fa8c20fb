"""Near-duplicate detection: b-bit MinHash and a multi-index Hamming join.

Each text becomes the set of its distinct word shingles (64-bit hashes).  Texts
with equal sets form one class; one row per class goes on.  A class gets a
signature of ``perms`` MinHash symbols of 16 bits each.  Two sets of Jaccard
similarity J differ in a symbol with probability (1 - J)(1 - 2^-16), so with
64 symbols, J = 0.85 and ``max_errors`` = 23, a pair exceeds the distance with
a probability below 1e-5 (binomial tail).

Signatures within ``max_errors`` are all found: the symbols are split into
``(max_errors + 1) / 2`` = 12 chunks, so by the pigeonhole principle one chunk
has at most one error.  That error is enumerated: a key per symbol position
stands for its chunk with that symbol left out (64 keys a class).  Classes that
share a key are candidates.

Candidates are not all pairs of a bucket.  Its pivot, the class that shares most
buckets with others, is compared with each of the others on the full shingle
sets, and linked classes are contracted to components.  What is left are pairs
x, y of the same pivot p in different components.  Let D be what a class lacks of
p's set and A what it has beyond it.  Then

    |x and y| = |p| - |Dx| - |Dy| + |Dx and Dy| + |Ax and Ay|,

so a link needs x and y to share at least w(x) + w(y) elements of their
differences, w growing with |D| and |A| (see ``_weight``).  At least one of the two
has no link to p, so that number is positive, and a prefix filter applies: each
class keeps the rarest of its differences that must hold a shared one, and only
classes that share such a one are compared, by the differences each shares with
anyone: linked are those that share w(x) + w(y) of them, so a comparison needs no
full sets, and only links leave the join.  Differences nobody shares are the
rarest, so copies with edits of their own meet nobody.  No link between
components is lost, and a group of n near copies costs about n comparisons.

Before larger joins, rows that cannot match are left out by a bitmap of hashed
keys.  It has a bounded size; where it fills up it lets more rows pass and the
exact join decides.

Hot groups: classes of equal sets are made by partial aggregation, so a group of
exact copies is one row.  Facts of a pivot or a component are joined by a salt, too.  Joins of buckets by key stand right behind their shuffles, where Spark
splits a key that is too large for a task.

Classes go by numbers of their own, so ids may be null.  Nulls: a row without id
takes part like any other; ``component_id`` is the least non-null id reachable,
null if there is none.  Empty texts (null, or without words) link with nothing.
Ties: a class is represented by its row of least id, then of least hash.  Repeated
ids: each row is judged by its own text, and identical rows get identical results.
Very long texts are handled whole, one batch of texts at a time.  An empty table
gives an empty result.  Columns of docs other than id and text play no part, and
``one_of_each`` keeps them all, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import Own, Scratch, arrow_map, quoted, table, utf8, with_hot

PERMS, MAX_ERRORS = 64, 23
_MASK = (1 << 64) - 1


class _WordHashes(dict):
    """64-bit hashes of words, kept for the words seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E6C63D0876A9A47)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles.

    Words are runs of anything but ASCII white space, A-Z in lower case.  A
    text of fewer words than ``width`` gives one shingle, its whole sequence.
    """
    words = text.lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    if n < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    s = h[: n - width + 1].copy()
    for k in range(1, width):
        s *= np.uint64(0xD6E8FEB86659FD93)
        s += h[k : n - width + 1 + k]
    return np.unique(_mix(s))


def _permutations(perms: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 32, perms, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, perms, np.uint32)


def signatures(sets: list[np.ndarray], perms: int) -> np.ndarray:
    """A row of 16-bit MinHash symbols for each set; zeros for empty sets."""
    out = np.zeros((len(sets), perms), np.uint16)
    a, b = _permutations(perms)
    at = 0
    while at < len(sets):
        to, total = at, 0
        while to < len(sets) and (to == at or total + len(sets[to]) <= 1 << 16):
            total += len(sets[to])
            to += 1
        full = [i for i in range(at, to) if len(sets[i])]
        if full:
            h = np.concatenate([sets[i] for i in full])
            h = (h >> np.uint64(32)).astype(np.uint32)
            starts = np.cumsum([0] + [len(sets[i]) for i in full[:-1]])
            for k in range(perms):
                least = np.minimum.reduceat(h * a[k] + b[k], starts)
                out[full, k] = ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)
        at = to
    return out


def errors_for(percent: int, perms: int = PERMS, miss: float = 1e-5) -> int:
    """The least odd distance that a pair of this similarity exceeds with at most this probability."""
    p = (1 - percent / 100) * (1 - 2.0**-16)
    tail = lambda t: sum(math.comb(perms, k) * p**k * (1 - p) ** (perms - k) for k in range(t + 1, perms + 1))
    return next(t for t in range(1, perms + 2, 2) if tail(t) <= miss)


def _chunks(perms: int, max_errors: int) -> np.ndarray:
    """The chunk of each symbol position: enough chunks that one has at most one error."""
    return np.arange(perms) * ((max_errors + 2) // 2) // perms


def bucket_keys(sig: np.ndarray, max_errors: int) -> np.ndarray:
    """Per signature and symbol position, the key of its chunk without that symbol."""
    n, perms = sig.shape
    chunk = _chunks(perms, max_errors)
    salt = _mix(np.arange(1, perms + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    h = _mix(sig.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + salt)
    sums = np.add.reduceat(h, np.flatnonzero(np.diff(chunk, prepend=-1)), axis=1)
    return _mix(sums[:, chunk] - h + salt).astype(np.int64)


def row_key(id_: Column, text: Column) -> Column:
    """A 128-bit key of a row: its id and text."""
    return F.md5(F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.when(text.isNull(), ":").otherwise(F.concat(F.lit(":t"), text))))


def fingerprints(texts: DataFrame, width: int, perms: int) -> DataFrame:
    """Of rows (doc_id, key, text): id, key, set size, 128-bit digest of the set, and signature."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, width) for t in utf8(batch.column(2))]
        sig = signatures(sets, perms)
        return pa.RecordBatch.from_arrays(
            [
                *batch.columns[:2],
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array([r.tobytes() for r in sig], pa.binary()),
            ],
            ["doc_id", "key", "n_shingles", "digest", "sig"],
        )

    return arrow_map(texts, run, "doc_id long, key string, n_shingles long, digest binary, sig binary")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, width) for t in utf8(batch.column(1))]
        ends = np.cumsum([0] + [len(s) for s in sets])
        flat = pa.array(np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], ["id", "set"])

    return arrow_map(docs, run, "id long, set array<long>")


def _with_both(pairs: DataFrame, nodes: DataFrame, payload: list[str]) -> DataFrame:
    """Pairs (a, b) with the payload of both ends, as <name>_a and <name>_b.

    One b may stand in a third of all pairs, so its payload goes to up to 32
    salted copies of it, of which each pair meets one.
    """
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(32)))
    ends = lambda x: nodes.select(F.col("id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in payload])
    right = salted.select("b", "salt").distinct().join(ends("b"), "b")
    return salted.join(ends("a"), "a").join(right, ["b", "salt"]).drop("salt")


class Bitmap:
    """Which evenly spread 64-bit values may occur: a bit each, of at most 2 ** most_bits."""

    def __init__(self, values: DataFrame, most_bits: int = 28):
        """values: one long column."""
        value = F.col(values.columns[0])
        self.bits = min(most_bits, max(16, (16 * values.count()).bit_length()))
        place = F.shiftrightunsigned(value, 64 - self.bits)
        words = values.select(place.alias("place")).selectExpr("shiftright(place, 6) AS word", "shiftleft(1L, cast(place & 63 AS int)) AS bit")
        rows = words.groupBy("word").agg(F.bit_or("bit").alias("bit")).toPandas()
        bitmap = np.zeros(1 << (self.bits - 6), np.int64)
        bitmap[rows["word"].to_numpy(np.int64)] = rows["bit"].to_numpy(np.int64)
        self.words = values.sparkSession.sparkContext.broadcast(bitmap.view(np.uint64))

    def may_have(self, values: np.ndarray) -> np.ndarray:
        place = values.view(np.uint64) >> np.uint64(64 - self.bits)
        return (self.words.value[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)

    def keeps(self, value: Column) -> Column:
        def run(values: pd.Series) -> pd.Series:
            return pd.Series(self.may_have(values.to_numpy(np.int64)))

        return F.pandas_udf(run, "boolean")(value)


def _load(texts: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """The shingle sets (id, set) of the wanted classes (id, key), from the rows that represent them."""
    hashed = F.xxhash64("key")
    some = texts.where(Bitmap(wanted.select(hashed)).keeps(hashed))
    return _sets(some.join(wanted, "key").dropDuplicates(["id"]).select("id", "text"), width)


def _pairs_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).distinct()


def _weight(percent: int) -> Column:
    """w of a class: two need w(x) + w(y) shared differences for a link.

    A link needs (100 + percent) * |x and y| >= percent * (n_x + n_y); with the
    identity in the module's text, and all times (100 + percent), a class adds
    100 * |D| + percent * |A| - (100 - percent) / 2 * |p| to the need.
    """
    missing, more = F.col("n_b") - F.col("both"), F.col("n_a") - F.col("both")
    return (100 * missing + percent * more - (100 - percent) / 2 * F.col("n_b")).cast("double")


def _left_over(tested: DataFrame, labels: DataFrame, sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Linked pairs (a, b) of classes whose components differ.

    tested: all classes a compared with a pivot b, with n_a, n_b, both and linked.
    A pair can share no more differences than either class shares with anyone, so
    a class needs a partner whose slack (what it shares, less its own w) covers w.
    """
    unit = 100 + percent
    named = tested.join(labels.select(F.col("id").alias("a"), "label"), "a", "left").withColumn("label", F.coalesce("label", "a")).withColumn("w", _weight(percent))
    named = scratch.table(named, "named")
    groups = named.groupBy("b").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.min("w").alias("least"), F.min(F.when(~F.col("linked"), F.col("w"))).alias("least_apart"))
    groups = groups.where("x <> y and least_apart is not null").select("b", "least", "least_apart")
    lower = F.col("w") + F.when(F.col("linked"), F.col("least_apart")).otherwise(F.col("least"))
    live = with_hot(named, groups, "b", "a").where(lower <= unit * (F.col("n_a") + F.col("n_b") - 2 * F.col("both"))).select("a", "b", "label", "linked", "n_b", "w")
    live = scratch.table(live, "live")
    both = _with_both(live, sets, ["set"])
    items = F.concat(F.array_except("set_a", "set_b"), F.array_except("set_b", "set_a"))
    items = scratch.table(both.select("a", "b", F.explode(items).alias("item")), "differences")
    shared = items.groupBy("b", "item").agg(F.count("*").alias("n")).where("n > 1")
    ranked = items.join(shared, ["b", "item"]).groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("n", "item"))).alias("items"))
    ranked = scratch.table(ranked.withColumn("some", F.size("items")).join(live, ["a", "b"]), "ranked")
    # The least w of partners by slack, in steps of a 64th of the pivot's need, rounded so that none is missed.
    step = unit * F.col("n_b") / 64.0
    slack = F.floor((unit * F.col("some") - F.col("w")) / step)
    steps = ranked.groupBy("b", slack.alias("slack")).agg(F.min("w").alias("any"), F.min(F.when(~F.col("linked"), F.col("w"))).alias("apart"))
    steps = steps.groupBy("b").agg(F.collect_list(F.struct("slack", "any", "apart")).alias("steps"))
    covers = F.filter("steps", lambda x: x["slack"] >= F.floor(F.col("w") / step))
    partner = F.when(F.col("linked"), F.array_min(F.transform(covers, lambda x: x["apart"]))).otherwise(F.array_min(F.transform(covers, lambda x: x["any"])))
    ranked = with_hot(ranked, scratch.table(steps, "steps"), "b", "a").withColumn("partner", partner).where("partner is not null")
    # Of the differences shared with anyone, rarest first, this many hold one that a linked pair shares.
    take = F.col("some") - F.greatest(F.lit(1), F.ceil((F.col("w") + F.col("partner")) / unit - 1e-9)) + 1
    ranked = ranked.withColumn("take", take.cast("int")).where("take > 0")
    ranked = ranked.select("a", "b", "label", "linked", "w", "some", F.transform("items", lambda x: x["item"]).alias("shared"), F.explode(F.slice("items", F.lit(1), F.col("take"))["item"]).alias("item"))
    ranked = scratch.table(ranked, "prefixes")
    x, y = (ranked.select("b", "item", *[F.col(c).alias(f"{c}_{k}") for c in ("a", "label", "linked", "w", "some", "shared")]) for k in "xy")
    need = F.col("w_x") + F.col("w_y")
    pairs = x.join(y, ["b", "item"]).where("a_x > a_y and label_x <> label_y and not (linked_x and linked_y)").where(need <= unit * F.least("some_x", "some_y"))
    return pairs.where(need <= unit * F.size(F.array_intersect("shared_x", "shared_y"))).select(F.col("a_x").alias("a"), F.col("a_y").alias("b")).distinct()


def _contract(edges: DataFrame, labels: DataFrame | None, scratch: Scratch, tag: str) -> DataFrame:
    """Node (id) to the least id of its component (label), by repeated contraction.

    Each round points every node at its least neighbour and rewrites the edges
    between the targets; the edges left shrink by half at least.
    """
    k = 0
    while True:
        edges = scratch.table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"edges{tag}_{k}")
        if k > 0:
            scratch.drop(f"edges{tag}_{k - 1}")
        if edges.isEmpty():
            return labels if labels is not None else edges.select(F.col("a").alias("id"), F.col("b").alias("label"))
        ends = edges.select(F.col("a").alias("id"), F.col("b").alias("to")).union(edges.select(F.col("b").alias("id"), F.col("a").alias("to")))
        up = ends.groupBy("id").agg(F.min("to").alias("to")).select("id", F.least("id", "to").alias("to"))
        up = scratch.table(up, f"up{tag}_{k}")
        if labels is None:
            labels = up.withColumnRenamed("to", "label")
        else:
            new = up.select(F.col("id").alias("label"), "to")
            old = labels.join(new, "label", "left").select("id", F.coalesce("to", "label").alias("label"))
            labels = old.union(up.join(labels.select("id"), "id", "left_anti").select("id", F.col("to").alias("label")))
        labels = scratch.table(labels, f"labels{tag}_{k}")
        for c in ("a", "b"):
            new = up.select(F.col("id").alias(c), F.col("to").alias(f"to_{c}"))
            edges = edges.join(new, c, "left").withColumn(c, F.coalesce(f"to_{c}", c)).drop(f"to_{c}")
        k += 1


def _classified(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, perms: int, max_errors: int | None) -> DataFrame:
    """Per row of docs: doc_id, key, n_shingles, and best: the row (nameless, doc_id, key) its component is named after."""
    max_errors = errors_for(percent, perms) if max_errors is None else max_errors
    scratch = Scratch(docs.sparkSession, "near-dedup")
    texts = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text"))
    texts = texts.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("key"), "text")
    prints = scratch.table(fingerprints(texts, width, perms), "prints")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "key"))
    nodes = prints.where("n_shingles > 0").groupBy("digest", F.col("n_shingles").alias("n"), "sig").agg(best.alias("best"))
    nodes = scratch.table(nodes.withColumn("rep", F.monotonically_increasing_id()), "nodes")

    def keyed(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        if not batch.num_rows:
            return None
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(batch.num_rows, perms)
        keys, reps = bucket_keys(sig, max_errors).ravel(), np.repeat(batch.column(0).to_numpy(), perms)
        if bitmap is not None:
            some = bitmap.may_have(keys)
            keys, reps = keys[some], reps[some]
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(reps)], ["key", "rep"])

    bitmap = None
    keys = arrow_map(nodes.select("rep", "sig"), keyed, "key long, rep long")
    shared = scratch.table(keys.groupBy("key").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x < y").select("key"), "shared")
    bitmap = Bitmap(shared)
    keys = arrow_map(nodes.select("rep", "sig"), keyed, "key long, rep long")
    buckets = scratch.table(keys.join(shared, "key"), "buckets")
    sizes = buckets.groupBy("key").agg(F.count("*").alias("n"))
    weight = buckets.join(sizes, "key").groupBy("rep").agg(F.sum("n").alias("n"))
    weighed = scratch.table(buckets.join(weight, "rep"), "weighed")
    pivots = weighed.groupBy("key").agg(F.max_by("rep", F.struct("n", -F.col("rep"))).alias("pivot"))
    pairs = weighed.join(pivots, "key").where("rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct()
    pairs = scratch.table(pairs, "pairs")
    scratch.drop("shared", "buckets", "weighed")
    wanted = _pairs_of(pairs).join(nodes.select(F.col("rep").alias("id"), F.col("best.key").alias("key")), "id")
    sets = scratch.table(_load(texts, scratch.table(wanted, "wanted"), width), "sets")
    links = (100 + percent) * F.col("both") >= percent * (F.col("n_a") + F.col("n_b"))
    tested = _with_both(pairs, sets, ["set"]).select("a", "b", F.size("set_a").alias("n_a"), F.size("set_b").alias("n_b"), F.size(F.array_intersect("set_a", "set_b")).alias("both"))
    tested = scratch.table(tested.withColumn("linked", links), "tested")
    labels = _contract(tested.where("linked").select("a", "b"), None, scratch, "1")

    edges = _left_over(tested, labels, sets, scratch, percent)
    at = lambda x: labels.select(F.col("id").alias(x), F.col("label").alias(f"to_{x}"))
    edges = edges.select("a", "b").join(at("a"), "a", "left").join(at("b"), "b", "left")
    labels = _contract_on(edges.select(F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b")), labels, scratch)

    # Components get their names: the least row of each.
    linked = scratch.table(nodes.select("rep", "digest", "best").join(labels.withColumnRenamed("id", "rep"), "rep", "left"), "linked")
    some = linked.where("label is not null")
    names = scratch.table(some.groupBy("label").agg(F.min("best").alias("name")), "names")
    named = with_hot(some, names, "label", "rep").select("digest", F.col("name").alias("best"))
    named = named.union(linked.where("label is null").select("digest", "best"))
    named = scratch.table(named, "named-classes")
    scratch.drop("nodes", "pairs", "wanted", "sets", "tested", "named", "live", "differences", "ranked", "steps", "prefixes", "linked", "names")
    got = prints.select("doc_id", "key", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("digest")).alias("digest")).join(named, "digest", "left")
    return got.select("doc_id", "key", "n_shingles", "best")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, perms: int = PERMS, max_errors: int | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept.

    width: words of a shingle.  percent: least similarity of a link.  perms,
    max_errors: symbols of a signature and the distance up to which all pairs
    are found (by default ``errors_for`` percent: a link is missed with a
    probability of at most 1e-5).  kept: the row has its component's id; of a
    component without any id, it has the text that stands for the component.
    """
    got = _classified(docs, id_col, text_col, width, percent, perms, max_errors)
    component = F.when(F.col("n_shingles") > 0, F.col("best.doc_id")).otherwise(F.col("doc_id"))
    nameless = F.when(F.col("n_shingles") > 0, F.col("best.key") == F.col("key")).otherwise(F.lit(True))
    return got.select("doc_id", "n_shingles", component.alias("component_id"), F.when(component.isNull(), nameless).otherwise(F.coalesce(F.col("doc_id") == component, F.lit(False))).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, perms: int = PERMS, max_errors: int | None = None) -> DataFrame:
    """The rows of docs that stay: one of each component.

    It is the row of least id that is not null, else one without id.  Rows
    without words are linked with nothing and stay.  Of rows that are equal in id
    and text one stays.
    """
    own = Own(docs)
    rows = _classified(own.df, own.name(id_col), own.name(text_col), width, percent, perms, max_errors)
    stay = Scratch(docs.sparkSession, "kept").table(rows.where((F.col("n_shingles") == 0) | (F.col("best.key") == F.col("key"))).select(F.col("key").alias("__key")).distinct(), "keys")
    keyed = own.df.withColumn("__key", row_key(own[id_col].cast("long"), own[text_col].cast("string")))
    return own.back(keyed.join(stay, "__key").dropDuplicates(["__key"]))


def _contract_on(edges: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """Labels after joining the components that the edges (between labels) connect."""
    more = _contract(edges, None, scratch, "2").select(F.col("id").alias("label"), F.col("label").alias("to"))
    old = labels.join(more, "label", "left").select("id", F.coalesce("to", "label").alias("label"))
    return old.union(more.select(F.col("label").alias("id"), F.col("to").alias("label")).join(old.select("id"), "id", "left_anti"))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of documents: 3-word shingles, similarity 0.85."""
    return components(table(spark, sf_dir, "documents"), width=3, percent=85)
