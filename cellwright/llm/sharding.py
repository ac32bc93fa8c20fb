"""Sharding by a hierarchical weighted hash tree.

A key descends region, rack and shard.  On each level every child draws
-ln(u) / weight with u from a hash of the key and the child's path, and the
least draw wins, so a child gets keys in proportion to its weight.  A child's
draw depends on nothing but the key, its path and its weight: when a weight
grows, keys move only towards that child, and all other subtrees keep theirs.

``layout`` makes the tree of a number of shards: ``regions`` regions of ``racks``
racks of ``seats`` seats, of which the shards take the first so many, dealt over
regions and racks in turn; shards beyond the last seat are regions of their own.
A key that comes to a seat without a shard descends again with other draws.  So
the number of shards alone decides, and one more shard takes rows only into
itself, whatever the number: a key's earlier descents end where they did, and a
key moves only if one of them comes to the new seat (or region).  Keys that find
no shard in ``TRIES`` descents go to the shard of least draw among all, which
keeps this law too.

Each level is one expression over a small constant table of its subtrees, so the
plan stays short.  The whole is DataFrame functions.

Slots number the rows of a shard without gaps.  They come from two levels:
rows are dealt to ``subs`` hash parts of each shard, parts are numbered by a
prefix sum over their counts, and rows only within a part.  No task holds a
whole shard.

Nulls: a null key has a shard too (that of the null hash; law ``key`` allows no
other), so rows without a key all go to one shard.  Null and empty texts weigh
nothing, very long ones are never moved to Python.  Ties and repeats: rows of one
key share a shard, and are numbered by a hash of their other columns (of all types
but maps and variants); identical rows get different slots.  An empty table gives
an empty result with all columns.  Columns named shard, grown_shard or slot are replaced; any
other names, also internal ones, are kept as they are.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._base import Own, Scratch, content, table

#: Descents of a key before it goes to the least draw among all shards.
TRIES = 24
_CHILD = "struct<path:string,weight:double,number:int>"


@dataclass(frozen=True)
class Node:
    """A subtree; a leaf has no children, and a shard number unless it is an empty seat."""

    path: str
    weight: float
    children: tuple[Node, ...] = ()
    shard: int | None = None


def tree(racks: dict[str, dict[str, dict[int, float]]]) -> tuple[Node, ...]:
    """Regions from {region: {rack: {shard: weight}}}; inner weights are sums."""
    out = []
    for region, inside in racks.items():
        nodes = []
        for rack, shards in inside.items():
            leaves = tuple(Node(f"{region}/{rack}/{s}", w, shard=s) for s, w in shards.items())
            nodes.append(Node(f"{region}/{rack}", sum(x.weight for x in leaves), leaves))
        out.append(Node(region, sum(x.weight for x in nodes), tuple(nodes)))
    return tuple(out)


def layout(shards: int, regions: int = 4, racks: int = 4, seats: int = 4) -> tuple[Node, ...]:
    """The tree of so many shards of equal weight."""
    out = []
    for r in range(regions):
        inside = []
        for k in range(racks):
            at = [r + regions * (k + racks * s) for s in range(seats)]
            inside.append(Node(f"{r}/{k}", float(seats), tuple(Node(f"{r}/{k}/{s}", 1.0, shard=s if s < shards else None) for s in at)))
        out.append(Node(f"{r}", float(racks * seats), tuple(inside)))
    for s in range(regions * racks * seats, shards):
        out.append(Node(f"+{s}", 1.0, (Node(f"+{s}/0", 1.0, (Node(f"+{s}/0/{s}", 1.0, shard=s),)),)))
    return tuple(out)


def _least(key: Column, attempt: Column, children: Column) -> Column:
    """The number of the child of least draw; children: (path, weight, number) structs."""

    def draw(c: Column) -> Column:
        uniform = (F.shiftrightunsigned(F.xxhash64(key, c["path"], attempt), 11).cast("double") + 0.5) / float(1 << 53)
        return F.struct((-F.ln(uniform) / c["weight"]).alias("draw"), c["number"].alias("number"))

    return F.array_min(F.transform(children, draw))["number"]


def _constant(value: list, schema: str) -> Column:
    """A constant table, which Catalyst folds to one literal."""
    return F.from_json(F.lit(json.dumps(value)), schema)


def shard_of(key: Column, nodes: tuple[Node, ...]) -> Column:
    """The key's shard in the tree (never null)."""
    racks = [x for n in nodes for x in n.children]
    leaves = [x for rack in racks for x in rack.children]
    number_of = {id(n): k for level in (nodes, racks, leaves) for k, n in enumerate(level)}
    child = lambda n, k: {"path": n.path, "weight": float(n.weight), "number": k}
    inside = lambda level: [[child(x, number_of[id(x)]) for x in n.children] for n in level]
    regions = _constant([child(n, k) for k, n in enumerate(nodes)], f"array<{_CHILD}>")
    of_region, of_rack = (_constant(inside(level), f"array<array<{_CHILD}>>") for level in (nodes, racks))
    shards = _constant([-1 if x.shard is None else x.shard for x in leaves], "array<int>")

    def descend(attempt: Column) -> Column:
        region = _least(key, attempt, regions)
        rack = F.transform(F.array(region), lambda r: _least(key, attempt, of_region[r]))[0]
        leaf = F.transform(F.array(rack), lambda r: _least(key, attempt, of_rack[r]))[0]
        return shards[leaf]

    if all(x.shard is not None for x in leaves):
        return F.coalesce(descend(F.lit(0)), F.lit(-1))
    tries = F.sequence(F.lit(0), F.lit(TRIES - 1))
    found = F.aggregate(tries, F.lit(-1), lambda got, attempt: F.when(got >= 0, got).otherwise(F.coalesce(descend(attempt), F.lit(-1))))
    filled = [x for x in leaves if x.shard is not None]
    last = _least(key, F.lit(TRIES), _constant([child(x, x.shard) for x in filled], f"array<{_CHILD}>"))
    # One evaluation of the descents, and a value that cannot be null (else joins would filter by it again).
    return F.coalesce(F.transform(F.array(found), lambda s: F.when(s >= 0, s).otherwise(last))[0], F.lit(-1))


def place(df: DataFrame, key: Column, nodes: tuple[Node, ...], out: str) -> DataFrame:
    """df with the key's shard in column out."""
    return df.withColumn(out, shard_of(key, nodes).cast("int"))


def number(df: DataFrame, key: Column, shard: str = "shard", out: str = "slot", subs: int = 1024) -> DataFrame:
    """df (without columns of names like __part) with gapless numbers from 0 within each shard."""
    part = F.coalesce(F.pmod(F.xxhash64(key, F.lit("slot")), F.lit(subs)), F.lit(0)).cast("int")
    df = df.withColumn("__part", part)
    counts = df.groupBy(shard, "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(shard).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col(shard).alias("__shard"), F.col("__part").alias("__of"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from"))
    counts = Scratch(df.sparkSession, "slots").table(counts, "parts")
    inside = F.row_number().over(Window.partitionBy(shard, "__part").orderBy(F.xxhash64(key), key, content(df.drop("__part"))))
    got = df.withColumn("__at", inside)
    # At most subs rows a shard: Spark sends them to all tasks.
    got = got.join(F.broadcast(counts), (F.col(shard) == F.col("__shard")) & (F.col("__part") == F.col("__of")))
    return got.withColumn(out, (F.col("__from") + F.col("__at") - 1).cast("long")).drop("__part", "__from", "__shard", "__of", "__at")


def assign(df: DataFrame, id_col: str = "doc_id", shards: int = 40) -> DataFrame:
    """df with columns shard, grown_shard (with one more shard) and slot."""
    if shards < 1:
        raise ValueError("at least one shard")
    own = Own(df, ["shard", "grown_shard", "slot"])
    key = own[id_col]
    got = number(place(own.df, key, layout(shards), "shard"), key)
    return own.back(got, "shard", shard_of(key, layout(shards + 1)).cast("int").alias("grown_shard"), "slot")


def op10_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards under the law ``key``."""
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    return assign(docs).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
