"""Exact ranked lexical search: a best-first search of sparse ball trees.

A document is a sparse vector: for each of its terms an integer weight (rarity times
a saturating count, see ``Ranking``). An item is the set of its terms, a vector of
ones, and a document's score is their inner product.

Vectors. One pass over the texts writes, for each document, its length and the
counts of those of its terms that some item asks for; other terms are zeros of
every inner product. Document counts of terms, N and L come from that table and
cover all documents.

Trees. A task reads its documents in batches of at most ``TREE_DOCS`` documents and
``TREE_ENTRIES`` entries and makes a ball tree of each: a node's documents are
halved by which of two far-off documents they are nearer to. A node holds its
mean c, its terms, and how far its documents are from c, both on the whole and
within each of ``TERM_BLOCKS`` groups of terms. No document of a node can score more
than

    sum of c over the item's terms in the node + min(sqrt(m) r, sum of sqrt(m_b) r_b)

with m (m_b) of the item's terms (in group b) in the node (Cauchy-Schwarz; terms
that the node lacks are zero in all its documents). Squared distances carry a
margin for the rounding of their sums, and the bound is rounded up to a whole
number, so a score never exceeds it.

Search. For each item the node with the largest bound is opened next; at a leaf the
scores are summed in 64-bit integers. The search of a tree ends when the largest
bound left is below the item's tenth-best score so far in the task, or equal to it
where all ids left come after. Each task returns at most k rows an item; the best
of those are the answer.

Items are read in shards of about ``SHARD_BYTES`` of text, one after the other, so
what goes along with a job stays bounded.

Defined cases: null texts and texts without a term score nothing, and no row has a
score of 0; every row of the documents and of the items counts by itself, repeated
ids and texts included; equal scores go by ascending id, null last; a text of any
length is read whole; without documents or items there are no rows. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from ..session import checkpointed
from .common import clean_texts, pieces, strings, words_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BEST = 10
SHARD_BYTES = 4 << 20
TREE_DOCS = 2048
TREE_ENTRIES = 1 << 19
LEAF_DOCS = 16
TERM_BLOCKS = 256
ULP = 2.0**-52


# --- terms -----------------------------------------------------------------------


def _byte_map() -> np.ndarray:
    """Bytes of terms as they are (A-Z in lower case), all others a space."""
    out = np.full(256, 0x20, np.uint8)
    for b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
        out[b] = b
    for b in range(0x41, 0x5B):
        out[b] = b + 0x20
    return out


BYTE_MAP = _byte_map()


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Terms of all texts, as ``common.words_of`` gives words."""
    texts = clean_texts(texts).cast(pa.string())
    _, ends, data = texts.buffers()
    if data is not None:
        mapped = pa.py_buffer(BYTE_MAP[np.frombuffer(data, np.uint8)])
        texts = pa.StringArray.from_buffers(len(texts), ends, mapped, offset=texts.offset)
    return words_of(texts, ascii_only=True)


def _counts(codes: np.ndarray, starts: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct named terms of each text with their counts: the offsets of each
    text, the names and the counts. ``names``: by code, -1 for none."""
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    name = names[codes] if len(codes) else np.zeros(0, np.int64)
    wide = int(names.max(initial=0)) + 1
    pair, tf = np.unique((text * wide + name)[name >= 0], return_counts=True)
    return np.searchsorted(pair // wide, np.arange(len(starts))), pair % wide, tf


def item_terms(items: DataFrame, text_col: str) -> DataFrame:
    """(uid, terms) of the items, each term once."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                codes, starts, vocab = terms_of(piece.column("text"))
                at, name, _ = _counts(codes, starts, np.arange(len(vocab)))
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), vocab.take(pa.array(name)))
                yield pa.RecordBatch.from_arrays([piece.column("uid"), lists], ["uid", "terms"])

    return items.select("uid", F.col(text_col).alias("text")).mapInArrow(run, "uid long, terms array<string>")


def _vectors(documents: DataFrame, id_col: str, text_col: str, terms: dict[str, int]) -> DataFrame:
    """(id, n, ids, tfs) of every document with a term: its length, the numbers of
    the asked-for terms it holds, and their counts."""
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    tail = [StructField("n", LongType()), StructField("ids", ArrayType(IntegerType())), StructField("tfs", ArrayType(LongType()))]
    schema = StructType([rows.schema["id"], *tail])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                codes, starts, vocab = terms_of(piece.column("text"))
                names = np.fromiter((terms.get(v, -1) for v in strings(vocab)), np.int64, len(vocab))
                at, name, tf = _counts(codes, starts, names)
                at = pa.array(at, pa.int32())
                arrays = [
                    piece.column("id").cast(arrow.field("id").type),
                    pa.array(np.diff(starts), pa.int64()),
                    pa.ListArray.from_arrays(at, pa.array(name, pa.int32())),
                    pa.ListArray.from_arrays(at, pa.array(tf, pa.int64())),
                ]
                made = pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, arrow)], schema=arrow)
                yield made.filter(pa.array(np.diff(starts) > 0))

    return rows.mapInArrow(run, schema)


# --- weights ---------------------------------------------------------------------


@dataclass
class Ranking:
    """What a score needs besides the counts of a document: the number of
    documents with a term, the length of all, and each term's weight."""

    documents: int
    length: int
    weights: np.ndarray

    @classmethod
    def of(cls, documents: int, length: int, holding: np.ndarray) -> Ranking:
        """``holding``: in how many documents each term occurs."""
        made = [math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in holding]
        return cls(documents, length, np.array(made, np.int64))

    def entries(self, n: np.ndarray, sizes: np.ndarray, ids: np.ndarray, tfs: np.ndarray) -> np.ndarray:
        """Weight of every entry; ``n``: lengths of the documents, ``sizes``: entries of each."""
        wide = 90 * int(n.max(initial=0)) * self.documents >= 1 << 63
        grown = 90 * (n.astype(object) if wide else n) * self.documents // self.length
        m = np.repeat((10 + grown).astype(np.int64), sizes)
        return self.weights[ids] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m))


# --- a tree ----------------------------------------------------------------------


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


class Tree:
    """A ball tree of documents with at least one entry each."""

    def __init__(self, doc_ids: list, sizes: np.ndarray, ids: np.ndarray, values: np.ndarray):
        self.vocab, local = np.unique(ids, return_inverse=True)
        self.mark = np.zeros(len(self.vocab), bool)
        at = np.concatenate([[0], np.cumsum(sizes)])
        self.order = np.arange(len(sizes))
        self._split(sizes, at, local, values.astype(float))
        take = _ragged(at[:-1][self.order], sizes[self.order])
        self.term, self.value = local[take], values[take]
        self.at = np.concatenate([[0], np.cumsum(sizes[self.order])])
        self.ids = [doc_ids[i] for i in self.order.tolist()]
        self._enclose()

    def _split(self, sizes: np.ndarray, at: np.ndarray, term: np.ndarray, value: np.ndarray) -> None:
        """Nodes as ranges of ``order``, which is sorted on the way."""
        square = np.add.reduceat(value * value, at[:-1])
        dense = np.zeros(len(self.vocab))

        def near(rows: np.ndarray, take: np.ndarray, ends: np.ndarray, pivot: int) -> np.ndarray:
            """Squared distances to a document, less the pivot's own square."""
            own = slice(at[pivot], at[pivot + 1])
            dense[term[own]] = value[own]
            dot = np.add.reduceat(dense[term[take]] * value[take], ends)
            dense[term[own]] = 0
            return square[rows] - 2 * dot

        self.low, self.high, self.left = [0], [len(sizes)], [-1]
        todo = [0]
        while todo:
            node = todo.pop()
            low, high = self.low[node], self.high[node]
            if high - low <= LEAF_DOCS:
                continue
            rows = self.order[low:high]
            take = _ragged(at[:-1][rows], sizes[rows])
            ends = np.concatenate([[0], np.cumsum(sizes[rows])[:-1]])
            a = int(rows[np.argmax(near(rows, take, ends, int(rows[0])))])
            to_a = near(rows, take, ends, a)
            b = int(rows[np.argmax(to_a)])
            side = to_a + square[a] - near(rows, take, ends, b) - square[b]
            self.order[low:high] = rows[np.argsort(side, kind="stable")]
            middle = (low + high) // 2
            self.left[node] = len(self.low)
            for lo, hi in ((low, middle), (middle, high)):
                todo.append(len(self.low))
                self.low.append(lo)
                self.high.append(hi)
                self.left.append(-1)

    def _enclose(self) -> None:
        """Means, distances and smallest ids of all nodes. ``node_term`` lists the
        nodes that hold a term, ``node_mean`` their means."""
        width, blocks = len(self.vocab), TERM_BLOCKS
        block = np.arange(width) % blocks
        doc = np.repeat(np.arange(len(self.ids)), np.diff(self.at))
        value = self.value.astype(float)
        terms, means, owners = [], [], []
        self.radius, self.radii = np.zeros(len(self.low)), np.zeros((len(self.low), blocks))
        longest = int(np.diff(self.at).max(initial=0))
        for node, (low, high) in enumerate(zip(self.low, self.high)):
            part = slice(self.at[low], self.at[high])
            term, v, n = self.term[part], value[part], high - low
            mean = np.bincount(term, v, width) / n
            held = np.flatnonzero(np.bincount(term, minlength=width))
            middle = np.bincount(block[held], mean[held] ** 2, blocks)
            # (v - c)^2 = c^2 + (v^2 - 2vc) over the terms of a document; the other terms give c^2
            slot = (doc[part] - low) * blocks + block[term]
            square, cross = v * v, 2 * v * mean[term]
            far = np.bincount(slot, square - cross, n * blocks).reshape(n, blocks) + middle
            size = np.bincount(slot, square + cross, n * blocks).reshape(n, blocks) + middle
            margin = 4 * (longest + len(held) + blocks) * ULP
            self.radii[node] = np.sqrt(np.maximum(far + margin * size, 0).max(axis=0))
            whole, sizes = far.sum(axis=1), size.sum(axis=1)
            self.radius[node] = np.sqrt(np.maximum(whole + margin * sizes, 0).max())
            terms.append(held)
            means.append(mean[held])
            owners.append(np.full(len(held), node))
        terms = np.concatenate(terms)
        place = np.argsort(terms, kind="stable")
        self.node_at = np.searchsorted(terms[place], np.arange(width + 1))
        self.node_term, self.node_mean = np.concatenate(owners)[place], np.concatenate(means)[place]
        self.least = [min(map(_id_order, self.ids[lo:hi])) for lo, hi in zip(self.low, self.high)]

    def bounds(self, terms: np.ndarray) -> np.ndarray:
        """No document of a node scores more than this (a whole number)."""
        count = self.node_at[terms + 1] - self.node_at[terms]
        take = _ragged(self.node_at[terms], count)
        node, nodes = self.node_term[take], len(self.low)
        centre = np.bincount(node, self.node_mean[take], nodes)
        slot = node * TERM_BLOCKS + np.repeat(terms % TERM_BLOCKS, count)
        shared = np.bincount(slot, minlength=nodes * TERM_BLOCKS).reshape(nodes, TERM_BLOCKS)
        by_block = (np.sqrt(shared) * self.radii).sum(axis=1)
        whole = np.sqrt(shared.sum(axis=1)) * self.radius
        reach = centre + np.minimum(by_block, whole)
        return np.floor(reach * (1 + 8 * (len(terms) + TERM_BLOCKS) * ULP) + 1).astype(np.int64)

    def scores(self, low: int, high: int) -> np.ndarray:
        """Exact scores of the documents of a leaf for the marked terms."""
        part = slice(self.at[low], self.at[high])
        return np.add.reduceat(self.value[part] * self.mark[self.term[part]], self.at[low:high] - self.at[low])

    def search(self, wanted: np.ndarray, best: list[tuple], k: int) -> tuple[list[tuple], int]:
        """The best (score, id) rows of ``best`` and of this tree, and how many
        documents were scored."""
        place = np.minimum(np.searchsorted(self.vocab, wanted), len(self.vocab) - 1)
        terms = place[self.vocab[place] == wanted]
        if not len(terms):
            return best, 0
        bounds = self.bounds(terms)
        self.mark[terms] = True
        seen, heap = 0, [(-int(bounds[0]), 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if len(best) == k and -bound < best[-1][0]:
                break
            if len(best) == k and -bound == best[-1][0] and self.least[node] > _id_order(best[-1][1]):
                continue
            child = self.left[node]
            if child >= 0:
                for c in (child, child + 1):
                    heapq.heappush(heap, (max(bound, -int(bounds[c])), c))
                continue
            low, high = self.low[node], self.high[node]
            found = self.scores(low, high)
            seen += high - low
            least = best[-1][0] if len(best) == k else 1
            hits = np.flatnonzero(found >= max(1, least))
            if len(hits):
                new = [(int(found[i]), self.ids[low + i]) for i in hits.tolist()]
                best = sorted(best + new, key=lambda r: (-r[0], _id_order(r[1])))[:k]
        self.mark[terms] = False
        return best, seen


def _id_order(value) -> tuple:
    return (value is None, value if value is not None else 0)


def trees(batches, ranking: Ranking):
    """Trees of the (id, n, ids, tfs) rows of a task, in bounded batches."""
    held: list[tuple] = []
    docs = entries = 0

    def make() -> Tree:
        names = [i for part in held for i in part[0]]
        n, sizes, ids, tfs = (np.concatenate([part[j] for part in held]) for j in (1, 2, 3, 4))
        return Tree(names, sizes, ids, ranking.entries(n, sizes, ids, tfs))

    for batch in batches:
        ends = np.concatenate([[0], np.cumsum(np.diff(batch.column("ids").offsets.to_numpy()))])
        start = 0
        while start < batch.num_rows:
            room = int(np.searchsorted(ends, ends[start] + TREE_ENTRIES - entries, side="right")) - 1
            stop = min(batch.num_rows, start + TREE_DOCS - docs, max(room, start + (0 if docs else 1)))
            if stop > start:
                rows = batch.slice(start, stop - start)
                held.append((
                    rows.column("id").to_pylist(),
                    rows.column("n").to_numpy(),
                    np.diff(ends[start : stop + 1]),
                    rows.column("ids").flatten().to_numpy().astype(np.int64),
                    rows.column("tfs").flatten().to_numpy(),
                ))
                docs, entries, start = docs + stop - start, entries + int(ends[stop] - ends[start]), stop
            if start < batch.num_rows or docs >= TREE_DOCS:
                yield make()
                held, docs, entries = [], 0, 0
    if held:
        yield make()


# --- search ----------------------------------------------------------------------


def _best_of_tasks(vectors: DataFrame, wanted: dict[int, np.ndarray], ranking: Ranking, k: int) -> DataFrame:
    """(uid, id, score): the best k documents of each task and item."""
    schema = StructType([StructField("uid", LongType()), vectors.schema["id"], StructField("score", LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        best: dict[int, list] = {uid: [] for uid in wanted}
        for tree in trees(batches, ranking):
            for uid, terms in wanted.items():
                best[uid], _ = tree.search(terms, best[uid], k)
        rows = [(uid, i, s) for uid, found in best.items() for s, i in found]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else ([], [], []), arrow)], schema=arrow)

    return vectors.mapInArrow(run, schema)


def rank_documents(
    documents: DataFrame,
    items: DataFrame,
    k: int = BEST,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every item."""
    spark = documents.sparkSession
    # written, as the numbers of the rows must hold for all uses
    numbered = checkpointed(
        items.select(F.monotonically_increasing_id().alias("uid"), F.col(item_id_col).alias("item"), F.col(item_text_col).alias("text"))
    )
    count, total = numbered.agg(F.count("text"), F.sum(F.octet_length("text"))).first()
    shards = max(1, min(count, -(-(total or 0) // shard_bytes)))
    asked = checkpointed(item_terms(numbered, "text").withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards))))
    found = None
    for shard in range(shards):
        rows = asked.where(F.col("shard") == shard).select("uid", "terms").collect()  # about shard_bytes
        names = sorted({t for r in rows for t in r.terms})
        number = {t: i for i, t in enumerate(names)}
        wanted = {r.uid: np.array(sorted(number[t] for t in r.terms), np.int64) for r in rows if r.terms}
        vectors = checkpointed(_vectors(documents, id_col, text_col, number))
        n, length = vectors.agg(F.count(F.lit(1)), F.sum("n")).first()
        holding = np.zeros(len(names), np.int64)
        for r in vectors.select(F.explode("ids").alias("i")).groupBy("i").count().collect():  # a row a name
            holding[r[0]] = r[1]
        ranking = Ranking.of(n, length or 1, holding)
        part = _best_of_tasks(vectors.where(F.size("ids") > 0), wanted, ranking, k)
        part = checkpointed(part) if shards > 1 else part
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("uid").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = numbered.select(F.col("uid").alias("own"), F.col("item").alias(item_id_col))
    joined = ranked.join(names, F.col("uid") == F.col("own"))
    out = joined.select(item_id_col, F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
    return out
