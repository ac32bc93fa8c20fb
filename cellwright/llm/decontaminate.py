"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all benchmark items build one suffix automaton (word
numbers as its alphabet).  Documents stream through it word by word; at each
word it holds the longest run of words ending there that occurs in some item.
A run of ``window`` words or more is a hit, and so is a whole item of fewer
words.  A word no item has resets the automaton, so only stretches of known
words that are long enough for a hit are streamed.

Words are runs of [0-9a-z] and all bytes from 0x80, after A-Z became lower
case.

The automaton is flat: arrays of numbers for each state's length, suffix link and
first transition, and a dictionary only for states of several transitions.  It
takes some 160 bytes a benchmark word on the driver and in each Python worker, and
290 while it is built (measured on prose and on words of a power law, at 200,000
and 1,000,000 words).  It is built from blocks of at most
``max_words`` benchmark words, so what is sent to the executors has a bound.  A
larger benchmark takes one pass over the documents for each block, and the hit
spans of the passes are merged by document.  No item is dropped.

Nulls and empty texts: null texts have no words; null or wordless items have no
windows; an item without an id marks words but is not listed; documents with null
ids are scanned like others.  Very long texts are scanned whole, one at a time in
a worker.  Ties and repeats: items with equal ids count once, repeated documents
are documents of their own with equal results.  An empty benchmark hits nothing,
an empty table gives an empty result.  Columns with the names of new ones are
replaced (by ``clean``: kept), all others stay as they are.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._base import Own, Scratch, arrow_map, table, utf8

_IS_WORD = lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_NORMAL = bytes(c if _IS_WORD(c) else 32 for c in _LOWER)
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_NORMAL).split() if text else []


class Automaton:
    """A generalised suffix automaton over the words of items."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        # Per state: the longest string's length, the suffix link, the first transition's word and target.
        self.length, self.link, self.word, self.target = (array("i") for _ in range(4))
        self.more: dict[int, dict[int, int]] = {}  # further transitions
        self._state(0, -1)
        ends, end_items = array("i"), array("i")  # states after window words or more, and their items
        self.ids = [i for i, _ in items]
        short: list[tuple[list[int], int]] = []
        for k, (_, ws) in enumerate(items):
            numbers = array("i", [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws])
            at = 0
            for n, x in enumerate(numbers, 1):
                at = self._extend(at, x)
                if n >= window:
                    ends.append(at)
                    end_items.append(k)
            if 0 < len(numbers) < window:
                short.append((numbers, k))
        by_length = np.argsort(np.frombuffer(self.length, np.int32), kind="stable").tolist()
        # The state of each window-long run, and the items it occurs in, as stretches of one array.
        self.cut = array("i", [-1]) * len(self.length)
        for v in by_length:
            if self.length[v] >= window:
                up = self.link[v]
                self.cut[v] = v if self.length[up] < window else self.cut[up]
        seen = np.unique(np.stack([np.frombuffer(self.cut, np.int32)[np.frombuffer(ends, np.int32)], np.frombuffer(end_items, np.int32)], 1), axis=0) if ends else np.empty((0, 2), np.int32)
        starts = np.flatnonzero(np.diff(seen[:, 0], prepend=-1))
        self.first = array("i", [-1]) * len(self.length)
        for v, a in zip(seen[starts, 0].tolist(), starts.tolist(), strict=True):
            self.first[v] = a
        self.run_of, self.items = array("i", seen[:, 0].tolist()), array("i", seen[:, 1].tolist())
        # Short items that end in a state, longest first; the nearest state by suffix links that has any.
        self.short: dict[int, list[tuple[int, int]]] = {}
        for numbers, k in short:
            v = 0
            for x in numbers:
                v = self._go(v, x)
            self.short.setdefault(v, []).append((len(numbers), k))
        self.nearest = array("i", [-1]) * len(self.length) if self.short else None
        for v in by_length if self.short else ():
            self.nearest[v] = v if v in self.short else self.nearest[self.link[v]] if v else -1
        self.least = min([window, *(len(n) for n, _ in short)])

    def sizes(self) -> dict[str, int]:
        """States, transitions and bytes."""
        arrays = [a for a in vars(self).values() if isinstance(a, array)]
        inner = sum(sys.getsizeof(d) for d in self.more.values())
        held = sum(map(sys.getsizeof, arrays)) + sys.getsizeof(self.more) + inner + sys.getsizeof(self.vocabulary) + sum(map(sys.getsizeof, self.vocabulary))
        return {"states": len(self.length), "transitions": sum(x >= 0 for x in self.word) + sum(map(len, self.more.values())), "bytes": held}

    def _state(self, length: int, link: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self.word.append(-1)
        self.target.append(-1)
        return len(self.length) - 1

    def _go(self, v: int, x: int) -> int | None:
        """The target of v's transition by x."""
        if self.word[v] == x:
            return self.target[v]
        more = self.more.get(v)
        return more.get(x) if more else None

    def _lead(self, v: int, x: int, to: int) -> None:
        """Set v's transition by x."""
        if self.word[v] in (-1, x):
            self.word[v], self.target[v] = x, to
        else:
            self.more.setdefault(v, {})[x] = to

    def _clone(self, p: int, x: int, q: int) -> int:
        new = self._state(self.length[p] + 1, self.link[q])
        self.word[new], self.target[new] = self.word[q], self.target[q]
        if q in self.more:
            self.more[new] = dict(self.more[q])
        self.link[q] = new
        while p != -1 and self._go(p, x) == q:
            self._lead(p, x, new)
            p = self.link[p]
        return new

    def _extend(self, last: int, x: int) -> int:
        """The state of the string of last followed by x."""
        if (q := self._go(last, x)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, x, q)
        new, p = self._state(self.length[last] + 1, 0), last
        while p != -1 and self._go(p, x) is None:
            self._lead(p, x, new)
            p = self.link[p]
        if p != -1:
            q = self._go(p, x)
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, x, q)
        return new

    def _items_at(self, v: int, out: set[int]) -> None:
        """Add the items that the window-long run of state v occurs in."""
        run = self.cut[v]
        k = self.first[run]
        while k < len(self.items) and self.run_of[k] == run:
            out.add(self.items[k])
            k += 1

    def hits(self, text_words: list[bytes]) -> tuple[list[tuple[int, int]], set[int], int]:
        """Disjoint hit spans [from, to) of words, items hit, and the words of the longest hit."""
        n = len(text_words)
        if n < self.least or not self.vocabulary:
            return [], set(), 0
        numbers = list(map(self.vocabulary.get, text_words))
        known = np.fromiter((x is not None for x in numbers), np.bool_, n)
        edges = np.flatnonzero(np.diff(known, prepend=False, append=False))
        starts, stops = edges[::2], edges[1::2]
        long = stops - starts >= self.least
        spans: list[list[int]] = []
        items: set[int] = set()
        longest, window, seen_run = 0, self.window, -1
        word, target, more, link, length, nearest = self.word, self.target, self.more, self.link, self.length, self.nearest
        for a, b in zip(starts[long].tolist(), stops[long].tolist(), strict=True):
            v = m = 0
            for i in range(a, b):
                x = numbers[i]
                while True:
                    if word[v] == x:
                        to = target[v]
                        break
                    to = more[v].get(x) if v in more else None
                    if to is not None or not v:
                        break
                    v = link[v]
                    m = length[v]
                if to is None:
                    continue
                v, m = to, m + 1
                reach = 0
                if m >= window:
                    reach = m
                    if self.cut[v] != seen_run:
                        seen_run = self.cut[v]
                        self._items_at(v, items)
                s = nearest[v] if nearest is not None else -1
                while s > 0:
                    for size, k in self.short[s]:
                        if size <= m:
                            reach = max(reach, size)
                            items.add(k)
                    s = nearest[link[s]]
                if reach:
                    longest = max(longest, reach)
                    low = i + 1 - reach
                    while spans and spans[-1][1] >= low:
                        low = min(low, spans.pop()[0])
                    spans.append([low, i + 1])
        return [(a, b) for a, b in spans], items, longest


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, max_words: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    block, size = [], 0
    for row in benchmark.select(F.col(id_col), F.col(text_col).cast("string")).toLocalIterator():
        ws = words(row[1].encode() if row[1] else None)
        if not ws:
            continue
        if block and size + len(ws) > max_words:
            yield block
            block, size = [], 0
        block.append((row[0], ws))
        size += len(ws)
    yield block


NEW = ["n_words", "n_hit", "spans", "items", "longest"]
_FOUND = "n_words long, spans array<struct<start:int,stop:int>>, items array<string>, longest long"


def _scanned(docs: DataFrame, automaton: Automaton, text_col: str) -> DataFrame:
    """docs with n_words, spans, items and longest."""
    shared = docs.sparkSession.sparkContext.broadcast(automaton)
    at = docs.columns.index(text_col)
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        a = shared.value
        n, spans, items, longest = [], [], [], []
        for text in utf8(batch.column(at)):
            ws = words(text)
            s, found, most = a.hits(ws)
            n.append(len(ws))
            spans.append([{"start": x, "stop": y} for x, y in s])
            items.append(sorted({str(a.ids[k]) for k in found if a.ids[k] is not None}))
            longest.append(most)
        new = [pa.array(n, pa.int64()), pa.array(spans, span), pa.array(items, pa.list_(pa.string())), pa.array(longest, pa.int64())]
        return pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "n_words", "spans", "items", "longest"])

    return arrow_map(docs, run, T.StructType([*docs.schema.fields, *T._parse_datatype_string(_FOUND).fields]))


def _merged(many: DataFrame) -> DataFrame:
    """One row per __row from those of all passes, with spans that touch made one."""
    some = many.select("__row", F.inline("spans"))
    order = Window.partitionBy("__row").orderBy("start", "stop")
    reached = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    some = some.withColumn("new", F.coalesce((F.col("start") > reached).cast("int"), F.lit(0)))
    some = some.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    some = some.groupBy("__row", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    some = some.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    rest = many.groupBy("__row").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("longest").alias("longest"))
    return rest.join(some, "__row", "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:int,stop:int>>")))


def find(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_words: int = 500_000) -> DataFrame:
    """docs with n_words, n_hit, spans (of words), items (ids as sorted strings), longest."""
    own = Own(docs, NEW)
    docs, text = own.df.withColumn("__text", own[text_col].cast("string")), "__text"
    scanned = passes = None
    for block in _blocks(benchmark, item_col, item_text_col, max_words):
        if passes is None:
            scanned, passes = (Automaton(block, window), 1)
            continue
        if passes == 1:
            scratch = Scratch(docs.sparkSession, "decontaminate")
            docs = scratch.table(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
            many = _scanned(docs.select("__row", text), scanned, text).drop(text)
        more = _scanned(docs.select("__row", text), Automaton(block, window), text).drop(text)
        many, passes = many.union(more), passes + 1
    got = _scanned(docs, scanned, text) if passes == 1 else docs.join(_merged(many), "__row")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return own.back(got, "n_words", n_hit.alias("n_hit"), "spans", "items", "longest")


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the given spans of words."""
    at = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
    out, done = [], 0
    for a, b in spans:
        out.append(text[done : at[a][0]])
        done = at[b - 1][1]
    return b"".join([*out, text[done:]])


def clean(docs: DataFrame, benchmark: DataFrame, most: float = 0.5, text_col: str = "text", length_col: str | None = "n_chars", **options) -> DataFrame:
    """docs without hit spans, and without the documents of which more than ``most`` is hit.

    length_col, if docs have it, becomes the new number of code points of a text
    that was cut.
    """
    own = Own(docs)
    text = own.name(text_col)
    got = find(own.df, benchmark, text_col=text, **options).where(F.col("n_hit") <= most * F.col("n_words"))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = batch.schema.names
        texts, spans = batch.column(names.index(text)), batch.column(names.index("spans")).to_pylist()
        if any(spans):
            new = [without_spans(t.encode(), [(s["start"], s["stop"]) for s in ss]).decode() if ss else t for t, ss in zip(texts.to_pylist(), spans, strict=True)]
            batch = batch.set_column(names.index(text), text, pa.array(new, texts.type))
        return batch

    clean = arrow_map(got, cut, got.schema)
    if length_col in docs.columns:
        length = own.name(length_col)
        clean = clean.withColumn(length, F.when(F.size("spans") > 0, F.length(text)).otherwise(F.col(length)).cast(own.df.schema[length].dataType))
    return own.back(clean)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents inside 10-word windows of benchmark items, and the items."""
    got = find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
