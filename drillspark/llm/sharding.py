"""Hierarchical weighted hash tree sharding.

Shards sit in racks and racks in regions. A row descends from the root: at each
node every child draws ``-ln(u) / weight`` with ``u`` from a hash of the row's
key and the child's name, and the row goes to the child with the least draw, so
a child gets rows in proportion to its weight. A child's draw depends on
nothing but the key, its name and its weight. When weights change, a row moves
only where a changed child starts or stops winning: movement stays within the
subtrees whose weights change. A new shard that opens a region of its own
(``grown``) takes rows only into itself.

Only the key and the tree decide; a row's neighbours, its text or the number of
partitions do not. Equal keys share a shard; a null key is a key of its own.

Defined cases: texts play no part, so null, empty and very long ones are placed like
any other; repeated rows get slots of their own; an empty table stays empty. A column
named as a new one (``shard``, ``slot``) is replaced, others stay whatever their
names. Slots are counted in at most ``MAX_BUCKETS`` ranges of the hash for each shard,
which bounds the table of their first positions; ranges then only grow longer.
"""

from __future__ import annotations

import math
from dataclasses import dataclass


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

# A draw takes the first 13 hex digits (52 bits) of an MD5 sum.
DRAW_DIGITS = 13
MAX_BUCKETS = 4096
UNFOLD = 65536


@dataclass(frozen=True)
class Node:
    """A region or rack (with children) or a shard (with its number)."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int | None = None
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def tree(regions: int, racks: int, shards: int, weights: dict[int, float] | None = None) -> Node:
    """A root over ``regions`` x ``racks`` x ``shards`` shards numbered in
    order from 0, each of weight 1 unless ``weights`` says otherwise."""
    weights = weights or {}

    def rack(r: int, k: int) -> Node:
        first = (r * racks + k) * shards
        return Node(
            f"region{r}/rack{k}",
            tuple(
                Node(f"region{r}/rack{k}/shard{s}", (), s, weights.get(s, 1.0)) for s in range(first, first + shards)
            ),
        )

    return Node(
        "root", tuple(Node(f"region{r}", tuple(rack(r, k) for k in range(racks))) for r in range(regions))
    )


def grown(root: Node, weight: float = 1.0) -> Node:
    """The tree with one more shard, which opens a region of its own: no other
    node's weight changes, so rows move only into the new shard."""
    new = 1 + max(_shards(root))
    name = f"region{len(root.children)}"
    leaf = Node(f"{name}/rack0/shard{new}", (), new, weight)
    return Node(root.name, (*root.children, Node(name, (Node(f"{name}/rack0", (leaf,)),))))


def _shards(node: Node) -> list[int]:
    return [node.shard] if node.shard is not None else [s for c in node.children for s in _shards(c)]


def _inner(node: Node) -> list[Node]:
    """The nodes that have children, the root first."""
    return [node, *[n for c in node.children for n in _inner(c)]] if node.children else []


def _depth(node: Node) -> int:
    return 1 + max(_depth(c) for c in node.children) if node.children else 0


def draw(key: Column, name: Column, weight: Column) -> Column:
    """``-ln(u) / weight``: exponential with the child's weight as its rate."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(":"), name).cast("binary"))
    u = (F.conv(F.substring(digest, 1, DRAW_DIGITS), 16, 10).cast("double") + 0.5) / float(16**DRAW_DIGITS)
    return -F.log(u) / weight


def shard_of(key: Column, root: Node) -> Column:
    """Number of the shard to which ``key`` descends from the root. Children
    of weight 0 are never drawn; of equal draws the first child wins."""
    entries = []
    for node in _inner(root):
        drawn = [
            F.struct(F.lit(c.name).alias("name"), F.lit(float(c.weight)).alias("weight"))
            for c in node.children
            if c.weight > 0
        ]
        entries += [F.lit(node.name), F.array(*drawn)]
    children = F.create_map(*entries)
    at = F.lit(root.name)
    for _ in range(_depth(root)):
        draws = F.transform(
            F.element_at(children, at),
            lambda c, i: F.struct(draw(key, c["name"], c["weight"]).alias("d"), i.alias("i"), c["name"].alias("name")),
        )
        # a shard has no children: the row stays
        at = F.coalesce(F.array_min(draws)["name"], at)
    return F.regexp_extract(at, r"shard(\d+)$", 1)


def with_shards(df: DataFrame, key_col: str, root: Node, name: str = "shard") -> DataFrame:
    """``df`` with the shard of each row. A narrow step: no shuffle."""
    return df.withColumn(name, shard_of(F.col(key_col), root).cast("int"))


def with_slots(rows: DataFrame, shard_col: str = "shard", name: str = "slot", bucket_rows: int = 1_000_000) -> DataFrame:
    """``rows`` with a gapless position from 0 in each shard.

    Positions follow a hash of the whole row, so they can be counted bucket by
    bucket: equal-width ranges of the hash hold even shares, whatever the
    keys. Equal rows are folded to one row with a count first and unfolded at
    the end (which of them gets which slot makes no difference), so no key,
    however common, meets in one task.
    """
    rows = rows.drop(name)
    cols = rows.columns
    digest = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in cols]).cast("binary"))
    # read three times below: written once
    folded = checkpointed(rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("__n")).withColumn("__h", digest))
    most = folded.groupBy(shard_col).agg(F.sum("__n").alias("n")).agg(F.max("n")).first()[0] or 1
    buckets = min(MAX_BUCKETS, 16 * 2 ** max(0, math.ceil(math.log2(most / bucket_rows))))
    bucket = F.floor(F.conv(F.substring("__h", 1, 8), 16, 10).cast("double") * F.lit(buckets / 16**8)).cast("int")
    folded = folded.withColumn("__b", bucket)
    # one row for each shard and bucket: shards x MAX_BUCKETS at most
    before = Window.partitionBy("__s").orderBy("__sb").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        folded.groupBy(F.col(shard_col).alias("__s"), F.col("__b").alias("__sb"))
        .agg(F.sum("__n").alias("m"))
        .select("__s", "__sb", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("__at"))
    )
    within = Window.partitionBy(shard_col, "__b").orderBy("__h", *cols).rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        folded.withColumn("__in", F.coalesce(F.sum("__n").over(within), F.lit(0)))
        .join(F.broadcast(starts), (F.col(shard_col) == F.col("__s")) & (F.col("__b") == F.col("__sb")))
        .withColumn("__first", F.col("__at") + F.col("__in"))
        .withColumn("__end", F.col("__first") + F.col("__n"))
    )
    # unfolded in two steps, so that no array is longer than UNFOLD
    step = F.explode(F.sequence("__first", F.col("__end") - 1, F.lit(UNFOLD).cast("long")))
    part = placed.select(*cols, "__end", step.alias("__from"))
    slots = F.explode(F.sequence("__from", F.least(F.col("__from") + UNFOLD, F.col("__end")) - 1))
    return part.select(*cols, slots.alias(name))
