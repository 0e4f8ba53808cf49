"""N-gram Jaccard join by MinHash banding.

A document is its set of five-word n-grams (words split at white space, lower
case, punctuation at their ends cut off; a text of one to four words is one
shorter n-gram). Two documents are linked when the Jaccard similarity of their
sets is at least ``threshold``.

1. Documents with equal sets are one class; everything below works on one
   representative of each class, so copies never meet as pairs.
2. ``bands`` x ``rows`` MinHash values a class, the most rows a band that still
   reach ``recall`` at the threshold within ``MAX_HASHES`` values. A shuffle on
   (band, hash) finds the buckets with two classes or more; buckets with the
   same members in several bands are kept once.
3. Full n-gram sets are fetched for the bucket members only. A bucket of any
   size is cut into blocks and every pair of blocks is verified in a task of
   bounded size, by counting shared n-grams. A pair counts in the first band it
   shares, so no pair is counted twice and none is ever a row: a task returns,
   for each member, its number of links and one member it is connected to.
4. Connected classes get the smallest document id among them, by label
   propagation with pointer jumping over those linear edges.

Nothing is capped or sampled. Defined cases: a null text is linked to nothing
and a class of its own; texts without a word are copies of each other and
linked to nothing else; repeated rows are copies; a null id is never the
smallest (a class of null ids only has class id null).
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from . import common

cloudpickle.register_pickle_by_value(sys.modules[__name__])

N = 5
THRESHOLD = 0.8
RECALL = 0.9995
MAX_HASHES = 128
BLOCK_MEMBERS = 2048
BLOCK_GRAMS = 1_500_000
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
BROADCAST_BYTES = 16 << 20  # most that is sent to every task; more is shuffled


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): a pair at the threshold shares a band with probability
    1 - (1 - threshold**rows)**bands, which must reach ``recall``."""
    best = None
    for rows in range(1, 33):
        miss = 1 - threshold**rows
        if miss >= 1:
            break
        bands = math.ceil(math.log(1 - recall) / math.log(miss)) if miss > 0 else 1
        if bands * rows <= most:
            best = bands, rows
    if best is None:
        raise ValueError(f"no banding with {most} hashes reaches recall {recall} at {threshold}")
    return best


def gram_sets(texts: pa.Array, n: int = N) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    codes, starts, vocab = common.words_of(texts)
    words = [w.lower() for w in common.strings(vocab)]
    word_hash = common.hash_words(pa.array([w.strip(PUNCTUATION) or w for w in words], pa.string()))[codes]
    grams = common.window_hashes(word_hash, n)
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if b - a >= n:
            g = np.sort(grams[a : b - n + 1])
            out.append(g[np.concatenate([[True], g[1:] != g[:-1]])])
        elif b > a:
            out.append(common.window_hashes(word_hash[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """Band hashes (len(sets), bands) of non-empty sets."""
    rng = np.random.default_rng(20_000)
    flips = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    odds = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(sets), bands), np.uint64)
    at = 0
    while at < len(sets):  # runs of sets that fit the cache
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= 1 << 15):
            size += len(sets[end])
            end += 1
        flat = np.concatenate(sets[at:end])
        first = np.cumsum([0, *[len(s) for s in sets[at : end - 1]]])
        value = np.empty_like(flat)
        for b in range(bands):
            mixed = np.full(end - at, b + 1, np.uint64)
            for r in range(rows):
                np.bitwise_xor(flat, flips[b * rows + r], out=value)
                np.multiply(value, odds[b * rows + r], out=value)
                mixed = (mixed ^ np.minimum.reduceat(value, first)) * np.uint64(0x9FB21C651E98DF25)
                mixed ^= mixed >> np.uint64(29)
            out[at:end, b] = mixed
        at = end
    return out


def _signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(id, rk, set_key, n, bands): ``rk`` a hash of id and text, ``set_key``
    128 bits of the set, null for a null text. ``docs``: (id, rk, text)."""
    id_type = docs.schema["id"].dataType.simpleString()

    def sign(batches):
        import xxhash

        for batch in batches:
            for piece in common.pieces(batch, "text"):
                texts = piece.column("text")
                sets = gram_sets(common.clean_texts(texts), n)
                keys = [xxhash.xxh3_128_digest(s.tobytes()) if ok else None for s, ok in zip(sets, texts.is_valid().to_pylist())]
                full = [i for i, s in enumerate(sets) if len(s)]
                hashes = band_hashes([sets[i] for i in full], bands, rows).view(np.int64)
                sizes = np.zeros(len(sets), np.int32)
                sizes[full] = bands
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(hashes.ravel())
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("id"),
                        piece.column("rk"),
                        pa.array(keys, pa.binary()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        lists,
                    ],
                    ["id", "rk", "set_key", "n", "bands"],
                )

    return docs.select("id", "rk", "text").mapInArrow(
        sign, f"id {id_type}, rk long, set_key binary, n long, bands array<long>"
    )


def _sets_of(docs: DataFrame, n: int) -> DataFrame:
    """(set_key, grams): each set once a task. ``docs``: (text)."""

    def fetch(batches):
        import xxhash

        seen = set()
        for batch in batches:
            for piece in common.pieces(batch, "text"):
                keys, grams = [], []
                for s in gram_sets(common.clean_texts(piece.column("text")), n):
                    key = xxhash.xxh3_128_digest(s.tobytes())
                    if key not in seen:
                        seen.add(key)
                        keys.append(key)
                        grams.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(grams, pa.binary())], ["set_key", "grams"])

    return docs.select("text").mapInArrow(fetch, "set_key binary, grams binary")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of ``left`` with every set of
    ``right``, by products of 0/1 columns over the n-grams both sides have."""
    a, b = np.concatenate(left), np.concatenate(right)
    rows_a = np.repeat(np.arange(len(left)), [len(s) for s in left])
    rows_b = np.repeat(np.arange(len(right)), [len(s) for s in right])
    common_grams = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(common_grams):
        return out

    def placed(grams, rows):
        at = np.minimum(np.searchsorted(common_grams, grams), len(common_grams) - 1)
        hit = common_grams[at] == grams
        order = np.argsort(at[hit], kind="stable")
        return at[hit][order], rows[hit][order]

    col_a, rows_a = placed(a, rows_a)
    col_b, rows_b = placed(b, rows_b)
    step = max(1, (4 << 20) // max(len(left), len(right)))
    for first in range(0, len(common_grams), step):
        width = min(step, len(common_grams) - first)
        one = np.zeros((len(left), width), np.float32)
        two = np.zeros((len(right), width), np.float32)
        s, e = np.searchsorted(col_a, [first, first + width])
        one[rows_a[s:e], col_a[s:e] - first] = 1
        s, e = np.searchsorted(col_b, [first, first + width])
        two[rows_b[s:e], col_b[s:e] - first] = 1
        out += one @ two.T
    return out


def _roots(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member connected to each of ``count`` members by pairs."""
    root = np.arange(count)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def verify_block(
    keys: list[bytes], sets: list[np.ndarray], bands: np.ndarray, copies: np.ndarray, block: np.ndarray, i: int, j: int, band: int, threshold: float
) -> list[tuple[bytes, bytes, int]]:
    """(member, member it is connected to, links) for the pair of blocks
    (``i``, ``j``): all pairs of one block with itself, or of the first block
    with the second (none if either has no member)."""
    first, second = np.flatnonzero(block == i), np.flatnonzero(block == j)
    if not len(first) or not len(second):
        return []
    sizes = np.array([len(s) for s in sets])
    shared = shared_counts([sets[i] for i in first], [sets[i] for i in second])
    total = sizes[first][:, None] + sizes[second][None, :] - shared
    x, y = np.nonzero(shared >= threshold * total - 1e-6)
    x, y = first[x], second[y]
    once = x < y if i == j else np.ones(len(x), bool)
    x, y = x[once], y[once]
    links = np.zeros(len(keys), np.int64)
    for at in range(0, len(x), 1 << 18):
        a, b = x[at : at + (1 << 18)], y[at : at + (1 << 18)]
        new = ~(bands[a, :band] == bands[b, :band]).any(axis=1)
        np.add.at(links, a[new], copies[b[new]])
        np.add.at(links, b[new], copies[a[new]])
    root = _roots(len(keys), x, y)
    linked = np.unique(np.concatenate([x, y]))
    return [(keys[k], keys[root[k]], int(links[k])) for k in linked.tolist()]


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, of batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        ends = [*(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        start = 0
        for end in ends:
            key = tuple(c[start] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            last, start = key, end
    if held:
        yield pa.Table.from_batches(held)


def _verify(members: DataFrame, threshold: float) -> DataFrame:
    """(set_key, root, links) over the sorted rows of every block pair."""

    def run(batches):
        made: list[tuple[bytes, bytes, int]] = []
        for rows in _groups(batches, ["bucket", "i", "j"]):
            block = rows["block"].to_numpy()
            if len(block) < 2:
                continue
            made += verify_block(
                rows["set_key"].to_pylist(),
                [np.frombuffer(g, np.uint64) for g in rows["grams"].to_pylist()],
                np.array(common.int_lists(rows["bands"].combine_chunks()), np.int64),
                rows["copies"].to_numpy(),
                block,
                rows["i"][0].as_py(),
                rows["j"][0].as_py(),
                rows["band"][0].as_py(),
                threshold,
            )
            if len(made) >= 10_000:
                yield _link_batch(made)
                made = []
        yield _link_batch(made)

    return members.mapInArrow(run, "set_key binary, root binary, links long")


def _link_batch(made: list[tuple[bytes, bytes, int]]) -> pa.RecordBatch:
    cols = list(zip(*made)) if made else [[], [], []]
    return pa.RecordBatch.from_arrays(
        [pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int64())], ["set_key", "root", "links"]
    )


def components(edges: DataFrame) -> DataFrame:
    """(v, label): the smallest node connected to each node of ``edges``
    (a, b). Every round takes the smallest label among a node and its
    neighbours, then that label's own label; each is a written table. A round
    without a change ends it."""
    both = edges.where("a <> b").select("a", "b")
    both = checkpointed(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("label")))
    while True:
        near = (
            both.join(labels.select(F.col("v").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("v"))
            .agg(F.min("label").alias("near"))
        )
        low = labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("low"))
        jump = labels.select(F.col("v").alias("low"), F.col("label").alias("far"))
        new = checkpointed(
            low.join(jump, "low", "left").select("v", "old", F.least("low", F.coalesce("far", "low")).alias("label"))
        )
        changed = new.where("label <> old").limit(1).count()
        labels = new.select("v", "label")
        if not changed:
            return labels


def few(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A written table marked for broadcast if its values, counted, are within the bound."""
    sized = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 8 for c in df.columns]
    size = df.agg(F.sum(sum(sized[1:], sized[0]).cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= most else df


def ngram_join(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    n: int = N,
    recall: float = RECALL,
    block_members: int = BLOCK_MEMBERS,
    block_grams: int = BLOCK_GRAMS,
) -> DataFrame:
    """One row per document: its id, ``rk`` (hash of id and text), ``class_id``
    (smallest id among all documents connected to it by links), ``rep_id``
    (smallest id with the same n-gram set), ``n_links`` (documents linked to
    it, copies included), ``set_key`` and ``label`` (the smallest ``set_key``
    of its class, which names the class whatever the ids; null for a null text)."""
    bands, rows = choose_bands(threshold, recall)
    docs = documents.select(
        F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("rk"), F.col(text_col).alias("text")
    )
    signed = checkpointed(_signatures(docs, n, bands, rows))
    classes = checkpointed(
        signed.where("set_key IS NOT NULL")
        .groupBy("set_key")
        .agg(
            F.min("rk").alias("rk"),
            F.min("id").alias("rep_id"),
            F.count(F.lit(1)).alias("copies"),
            F.first("n").alias("n"),
            F.first("bands").alias("bands"),
        )
    )

    # buckets with two classes or more, those with the same members once
    banded = classes.where("n > 0").select("set_key", "n", F.posexplode("bands").alias("band", "h"))
    sizes = banded.groupBy("band", "h").agg(
        F.count(F.lit(1)).alias("m"),
        F.sum("n").alias("grams"),
        F.bit_xor(F.xxhash64("set_key")).alias("s1"),
        F.bit_xor(F.xxhash64(F.lit(1), "set_key")).alias("s2"),
    )
    buckets = checkpointed(
        sizes.where("m > 1")
        .groupBy("m", "s1", "s2")
        .agg(F.min(F.struct("band", "h")).alias("at"), F.first("grams").alias("grams"))
        .select(
            F.col("at.band").alias("band"),
            F.col("at.h").alias("h"),
            F.xxhash64("at.band", "at.h").alias("bucket"),
            F.greatest(F.ceil(F.col("m") / block_members), F.ceil(F.col("grams") / block_grams)).alias("blocks"),
        )
    )
    members = checkpointed(
        banded.select("set_key", "band", "h").join(buckets, ["band", "h"]).select("set_key", "bucket", "band", "blocks")
    )

    # the n-gram sets of bucket members, from the text of one document each
    wanted = checkpointed(members.select("set_key").distinct().join(classes.select("set_key", "rk", "copies", "bands"), "set_key"))
    texts = docs.join(few(wanted.select("rk")), "rk", "left_semi")
    sets = _sets_of(texts, n).groupBy("set_key").agg(F.first("grams").alias("grams"))
    full = wanted.select("set_key", "copies", "bands").join(sets, "set_key")

    # every pair of blocks of a bucket, each block with itself included
    block = F.pmod(F.xxhash64("bucket", "set_key"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1))
    dealt = (
        members.withColumn("block", block)
        .withColumn("other", other)
        .withColumn("i", F.least("block", "other"))
        .withColumn("j", F.greatest("block", "other"))
        .join(full, "set_key")
        .select("bucket", "i", "j", "block", "band", "set_key", "copies", "bands", "grams")
    )
    links = checkpointed(_verify(dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j"), threshold))

    labels = components(links.select(F.col("set_key").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("set_key").agg(F.sum("links").alias("links"))
    labelled = (
        classes.select("set_key", "rep_id", "copies")
        .join(labels.select(F.col("v").alias("set_key"), "label"), "set_key", "left")
        .join(counts, "set_key", "left")
        .withColumn("label", F.coalesce("label", "set_key"))
    )
    # written, so a class with a third of all sets is split where it is joined back
    labelled = checkpointed(labelled)
    smallest = checkpointed(labelled.groupBy("label").agg(F.min("rep_id").alias("class_id")))
    result = checkpointed(
        labelled.join(smallest, "label").select(
            "set_key", "label", "class_id", "rep_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
        )
    )
    alone = F.col("set_key").isNull()
    return (
        signed.select("id", "rk", "set_key")
        .join(result, "set_key", "left")
        .select(
            F.col("id").alias(id_col),
            "rk",
            F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
            F.when(alone, F.col("id")).otherwise(F.col("rep_id")).alias("rep_id"),
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
            "set_key",
            "label",
        )
    )


def drop_near_copies(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``documents`` with one row of each class left: a row with the smallest
    id (of rows that share it the one with the smallest hash, once). Rows with
    a null text all stay. Columns are unchanged."""
    joined = checkpointed(ngram_join(documents, id_col, text_col, **options).where("label IS NOT NULL"))
    # classes go by label: ids may be null or repeated
    rows = joined.groupBy("rk", "label", id_col).agg(F.count(F.lit(1)).alias("times"))
    order = F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), F.col("rk").alias("r"))
    # written, so that the join deals out by itself and a large class can be split
    keepers = checkpointed(rows.groupBy("label").agg(F.min(order).alias("best")))
    judged = checkpointed(
        rows.join(keepers, "label").select(
            F.col("rk").alias("__rk"),
            F.col(id_col).alias("__id"),
            (F.col("best.r") == F.col("rk")).alias("__stays"),
            F.col("times").alias("__times"),
        )
    )
    key = F.xxhash64(id_col, text_col)
    same = (key == F.col("__rk")) & F.col(id_col).eqNullSafe(F.col("__id"))
    gone = judged.where("NOT __stays OR __times > 1").select("__rk", "__id", "__stays")
    marked = documents.join(few(gone), same, "left")
    rest = marked.where("__rk IS NULL").select(*documents.columns)
    # rows that occur several times and stay: one of each
    again = marked.where("__stays").select(*documents.columns, "__rk").dropDuplicates(["__rk"]).drop("__rk")
    return rest.unionByName(again)
