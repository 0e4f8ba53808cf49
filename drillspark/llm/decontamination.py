"""Benchmark decontamination: a BM25 index of test items, searched by every
training passage with block-max WAND, matches verified on question and answer.

Index. Items are tokenised (white space, lower case, punctuation at word ends
cut off), weighted by BM25 and divided by the item's score for its own text, so
an item that occurs whole scores 1 whatever its length. Postings lie in blocks
of ``BLOCK_ITEMS`` items with the largest weight of each term in each block.
Items are dealt into shards of about ``SHARD_ITEMS`` items, ``SHARD_BYTES`` of
text and ``SHARD_POSTINGS`` postings, whichever makes more of them, apart by grade:
items of up to ``GRADE_WORDS`` words, up to twice as many, and so on. A shard holds
the text of an item once.

Search. For each grade a text is read as overlapping passages of twice its
longest item, so every stretch as long as an item lies whole within one, and
the passages of short items are short whatever else is in the benchmark. For a passage only
blocks with a *pivot* posting are opened: the weights of an item's terms, small
ones first, are summed up; as long as the sum is below the threshold no set of
these terms can reach it, so a passage must hold one of the others. Of an open
block the sum of its block maxima is taken next, and only where that reaches
the threshold are postings scored. No item at or above the threshold is missed.

Verification. The last line or sentence of an item is its answer, the rest its
question; a hit stands when the passage holds at least ``overlap`` of the
distinct three-word sequences of both.

Defined cases: null and empty texts and items match nothing; repeated items are
each reported, repeated rows alike; a text of any length is read whole, in pieces of
passages; without items or documents there are no matches; a column named ``matches``
is replaced, others stay whatever their names; an item of one sentence is cut at three
quarters of its words, one of a single word is question and answer at once.
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ..session import checkpointed
from . import common

cloudpickle.register_pickle_by_value(sys.modules[__name__])

K1, B = 1.2, 0.75
THRESHOLD = 0.65
OVERLAP = 0.5
GRAM = 3
BLOCK_ITEMS = 8
SHARD_ITEMS = 2048
SHARD_BYTES = 8 << 20
SHARD_POSTINGS = 1 << 18
GRADE_WORDS = 64
SHIP_BYTES = 64 << 20  # most of the index that goes with one pass over the texts
LEAST_STRIDE = 32
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def term(word: str) -> str:
    word = word.lower()
    return word.strip(PUNCTUATION) or word


def split_item(text: str) -> tuple[list[str], list[str]]:
    """(question terms, answer terms) of an item."""
    words = text.split()
    marked = re.split(r"(?:^|\n)\s*(?:answer|a)\s*:", text, maxsplit=1, flags=re.IGNORECASE)
    parts = marked if len(marked) == 2 else text.strip().rsplit("\n", 1)
    if len(parts) < 2:
        parts = re.split(r"(?<=[.!?])\s+", text.strip())
        parts = [" ".join(parts[:-1]), parts[-1]]
    question, answer = parts[0].split(), parts[1].split()
    if not question or not answer:
        cut = max(1, len(words) * 3 // 4)
        question, answer = words[:cut], words[cut:] or words[-1:]
    return [term(w) for w in question], [term(w) for w in answer]


def grams(terms: list[str]) -> set[tuple[str, ...]]:
    """Distinct ``GRAM``-term sequences; shorter lists are one sequence."""
    n = min(GRAM, len(terms))
    return {tuple(terms[i : i + n]) for i in range(len(terms) - n + 1)} if n else set()


def overlap(wanted: list[str], passage: list[str]) -> float:
    """Share of the sequences of ``wanted`` that ``passage`` holds."""
    need = grams(wanted)
    if not need:
        return 0.0
    n = len(next(iter(need)))
    have = {tuple(passage[i : i + n]) for i in range(len(passage) - n + 1)}
    return len(need & have) / len(need)


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


@dataclass
class Shard:
    """Postings of some items, in order of term and item. ``cells`` are the (term,
    block) pairs that have any, sorted, with the first posting and the largest weight
    of each: as many as there are postings at most, however many terms and blocks there
    are. ``pivot_at`` and ``pivot_block`` list the blocks in which a term is a pivot
    for some item."""

    terms: dict[str, int]
    ids: list
    questions: list[list[str]]
    answers: list[list[str]]
    item: np.ndarray
    weight: np.ndarray
    blocks: int
    cells: np.ndarray
    cell_at: np.ndarray
    cell_max: np.ndarray
    pivot_at: np.ndarray
    pivot_block: np.ndarray

    @classmethod
    def build(cls, items: pa.Table, postings: pa.Table, threshold: float) -> Shard:
        """From (uid, item_id, text) and (uid, term, weight) rows."""
        first = {r["uid"]: r for r in items.to_pylist()}
        # alike items share blocks, so block maxima stay close to their items'
        order = sorted(first, key=lambda u: (len(first[u]["text"]), u))
        number = {u: i for i, u in enumerate(order)}
        words = postings["term"].to_pylist()
        terms = {t: i for i, t in enumerate(sorted(set(words)))}
        t = np.array([terms[x] for x in words], np.int64)
        i = np.array([number[u] for u in postings["uid"].to_pylist()], np.int64)
        w = postings["weight"].to_numpy()
        place = np.lexsort((i, t))
        t, i, w = t[place], i[place], w[place]
        blocks = -(-len(order) // BLOCK_ITEMS)
        cell = t * blocks + i // BLOCK_ITEMS
        cells, cell_at = np.unique(cell, return_index=True)
        cell_max = np.maximum.reduceat(w, cell_at) if len(w) else w
        # pivots: the terms past the point where an item's small weights reach the threshold
        up = np.lexsort((t, w, i))
        total = np.cumsum(w[up])
        before = np.concatenate([[0], total])[np.searchsorted(i[up], i[up])]
        pivot = np.zeros(len(w), bool)
        pivot[up] = total - before >= threshold - 1e-9
        pivots = np.unique(cell[pivot])
        split = [split_item(first[u]["text"]) for u in order]
        return cls(
            terms, [first[u]["item_id"] for u in order], [s[0] for s in split], [s[1] for s in split], i, w,
            blocks, cells, np.append(cell_at, len(w)), cell_max,
            np.searchsorted(pivots // blocks, np.arange(len(terms) + 1)), pivots % blocks,
        )

    def _place(self, term: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``cells`` of (term, block) pairs, and which pairs have one."""
        wanted = term * self.blocks + block
        at = np.minimum(np.searchsorted(self.cells, wanted), len(self.cells) - 1)
        return at, self.cells[at] == wanted

    def search(self, words: np.ndarray, starts: np.ndarray, vocab: list[str], stride: int, threshold: float):
        """(text, first word of the passage, item, score) of every passage and
        item at or above the threshold. ``words``: vocabulary numbers."""
        known = np.fromiter((self.terms.get(v, -1) for v in vocab), np.int64, len(vocab))
        n_terms, blocks = len(self.terms), self.blocks
        segments = -(-np.diff(starts) // stride)
        base = np.concatenate([[0], np.cumsum(segments)])
        text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        t = known[words]
        hit = np.flatnonzero(t >= 0)
        if not len(hit):
            return
        segment = base[text[hit]] + (hit - starts[text[hit]]) // stride
        pair = np.unique(segment * n_terms + t[hit])
        segment, t = pair // n_terms, pair % n_terms
        segment_at = np.searchsorted(segment, np.arange(base[-1] + 1))
        owner = np.repeat(np.arange(len(segments)), segments)

        # open blocks: (segment, block) with a pivot, then the passages they are in
        count = self.pivot_at[t + 1] - self.pivot_at[t]
        opened = np.unique(np.repeat(segment, count) * blocks + self.pivot_block[_ragged(self.pivot_at[t], count)])
        s, b = opened // blocks, opened % blocks
        last = s + 1 == base[owner[s] + 1]
        head = s == base[owner[s]]
        begin = np.concatenate([s[~last | head], s[~head] - 1])  # as first and as second segment
        passage_block = np.unique(begin * blocks + np.concatenate([b[~last | head], b[~head]]))
        p, b = passage_block // blocks, passage_block % blocks
        if not len(p):
            return

        # distinct terms of each of these passages
        passages, p = np.unique(p, return_inverse=True)
        two = passages + 1 < base[owner[passages] + 1]
        end = np.where(two, passages + 2, passages + 1)
        size = segment_at[end] - segment_at[passages]
        pair = np.unique(np.repeat(np.arange(len(passages)), size) * n_terms + t[_ragged(segment_at[passages], size)])
        of, t = pair // n_terms, pair % n_terms
        term_at = np.searchsorted(of, np.arange(len(passages) + 1))

        step = 1 << 15  # open blocks at once
        for at in range(0, len(p), step):
            pp, bb = p[at : at + step], b[at : at + step]
            for _ in range(2):  # block maxima first, then the postings of what is left
                size = term_at[pp + 1] - term_at[pp]
                slot = np.repeat(np.arange(len(pp)), size)
                tt = t[_ragged(term_at[pp], size)]
                place, there = self._place(tt, bb[slot])
                if _ == 0:
                    bound = np.bincount(slot, np.where(there, self.cell_max[place], 0.0), len(pp))
                    left = bound >= threshold - 1e-9
                    pp, bb = pp[left], bb[left]
            if not len(pp):
                continue
            slot, place = slot[there], place[there]
            size = self.cell_at[place + 1] - self.cell_at[place]
            posting = _ragged(self.cell_at[place], size)
            slot = np.repeat(slot, size)
            inside = self.item[posting] - bb[slot] * BLOCK_ITEMS
            scores = np.bincount(slot * BLOCK_ITEMS + inside, self.weight[posting], len(pp) * BLOCK_ITEMS)
            for k in np.flatnonzero(scores >= threshold - 1e-9).tolist():
                first = int(passages[pp[k // BLOCK_ITEMS]])
                doc = int(owner[first])
                yield doc, int(first - base[doc]) * stride, int(bb[k // BLOCK_ITEMS]) * BLOCK_ITEMS + k % BLOCK_ITEMS, float(scores[k])


@dataclass
class Index:
    """The written index: one row a shard (its packed items and postings), the
    stride of passages and the bytes of each shard."""

    table: DataFrame
    strides: dict[int, int]
    sizes: dict[int, int]


def _item_terms(items: DataFrame) -> DataFrame:
    """(uid, words, term, tf) of ``items`` (uid, text), without the texts: a
    batch holds the terms of one piece of texts."""

    def count(batches):
        from collections import Counter

        for batch in batches:
            for piece in common.pieces(batch, "text"):
                uids, lengths, terms, tfs = [], [], [], []
                for uid, text in zip(piece.column("uid").to_pylist(), common.strings(common.clean_texts(piece.column("text")))):
                    words = [term(w) for w in text.split()]
                    found = Counter(words)
                    uids += [uid] * len(found)
                    lengths += [len(words)] * len(found)
                    terms += found.keys()
                    tfs += found.values()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(terms, pa.string()), pa.array(tfs, pa.int64())],
                    ["uid", "words", "term", "tf"],
                )

    return items.mapInArrow(count, "uid long, words long, term string, tf long")


def _stream(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def build_index(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Index:
    """Weigh and pack the items of ``benchmark``."""
    # written, as the numbers of the rows must hold for both of its uses
    items = checkpointed(
        benchmark.select(
            F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("item_id"), F.col(text_col).alias("text")
        )
    )
    terms = checkpointed(_item_terms(items.select("uid", "text")))
    shape = terms.groupBy("uid").agg(F.first("words").alias("words"), F.count(F.lit(1)).alias("postings"))
    texts = items.join(shape, "uid")
    grade = F.ceil(F.log2(F.greatest(F.col("words") / GRADE_WORDS, F.lit(1.0)))).cast("int")
    grades = texts.groupBy(grade.alias("grade")).agg(
        F.count(F.lit(1)), F.sum("words"), F.max("words"), F.sum("postings"), F.sum(F.octet_length("text"))
    )
    n, total, shard, strides = 0, 0, F.lit(0), {}
    for g, count, words, longest, postings, size in grades.orderBy("grade").collect():  # a row for each doubling
        shards = max(-(-count // SHARD_ITEMS), -(-size // SHARD_BYTES), -(-postings // SHARD_POSTINGS))
        own = F.pmod(F.xxhash64("uid"), F.lit(shards)) + len(strides)
        shard = F.when(grade == g, own).otherwise(shard)
        strides |= {len(strides) + k: max(LEAST_STRIDE, longest) for k in range(shards)}
        n, total = n + count, total + words
    mean = total / n if n else 1.0
    # written: a term that every item holds is split in the join
    rarity = terms.groupBy("term").agg(F.log(1 + (F.lit(n) - F.count(F.lit(1)) + 0.5) / (F.count(F.lit(1)) + 0.5)).alias("idf"))
    rarity = checkpointed(rarity)
    tf = F.col("tf").cast("double")
    raw = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("words") / F.lit(mean)))
    weighed = terms.join(rarity, "term").withColumn("raw", raw)
    own = weighed.groupBy("uid").agg(F.sum("raw").alias("own"))
    weighed = weighed.join(own, "uid").withColumn("weight", F.col("raw") / F.col("own"))
    shard = shard.cast("int").alias("shard")
    weighed = weighed.select(shard, "uid", "term", "weight")
    texts = texts.select(shard, "uid", "item_id", "text")

    def pack(texts: pa.Table, postings: pa.Table) -> pa.Table:
        texts = texts.combine_chunks()
        place = texts.schema.get_field_index("text")
        clean = pa.chunked_array([common.clean_texts(c) for c in texts["text"].chunks], pa.string())
        made = [_stream(texts.set_column(place, "text", clean).drop_columns(["shard"])), _stream(postings.drop_columns(["shard"]))]
        return pa.table({"shard": texts["shard"][:1], "items": pa.array(made[:1], pa.binary()), "postings": pa.array(made[1:], pa.binary())})

    both = texts.groupBy("shard").cogroup(weighed.groupBy("shard"))
    table = checkpointed(both.applyInArrow(pack, "shard int, items binary, postings binary"))
    # one row a shard
    sizes = {r[0]: r[1] for r in table.select("shard", F.octet_length("items") + F.octet_length("postings")).collect()}
    return Index(table, strides, sizes)


def match_fields(id_type) -> list[StructField]:
    one = StructType(
        [
            StructField("item_id", id_type),
            StructField("first_word", IntegerType()),
            StructField("bm25", DoubleType()),
            StructField("question_overlap", DoubleType()),
            StructField("answer_overlap", DoubleType()),
        ]
    )
    return [StructField("matches", ArrayType(one))]


def find_matches(
    df: DataFrame,
    index: Index,
    text_col: str = "text",
    threshold: float = THRESHOLD,
    least: float = OVERLAP,
    keep: list[str] | None = None,
    ship_bytes: int = SHIP_BYTES,
) -> DataFrame:
    """``df`` with ``matches``: the items found in the text, each with its best
    passage. The index goes with the job, ``ship_bytes`` of it at most; a larger
    one is searched part by part, in as many passes over the texts: the matches of a
    part are written, with the columns of ``df`` that are still needed, before the
    next part is read by the driver."""
    groups, size = [[]], 0
    for shard, n in sorted(index.sizes.items()):
        if groups[-1] and size + n > ship_bytes:
            groups.append([])
            size = 0
        groups[-1].append(shard)
        size += n
    id_type = None
    out = df
    kept = df.columns if keep is None else keep
    for k, group in enumerate(groups):
        rows = index.table.where(F.col("shard").isin(group)).collect()
        packed = [(bytes(r.items), bytes(r.postings)) for r in rows]
        strides = [index.strides[r.shard] for r in rows]
        if id_type is None:
            id_type = _id_type(packed)
        last = k == len(groups) - 1
        fields = [StructField(f"__matches{k}", match_fields(id_type)[0].dataType)]
        found = [f"__matches{j}" for j in range(k)]
        columns = [*kept, *found] if last else [*dict.fromkeys([*kept, text_col]), *found]
        out = common.add_columns(out, text_col, fields, _searcher(packed, strides, text_col, threshold, least), columns)
        if not last:
            out = checkpointed(out)
    parts = [F.col(f"__matches{j}") for j in range(len(groups))]
    merged = F.concat(*parts) if len(parts) > 1 else parts[0]
    return out.select(*[c for c in out.columns if c in kept and c != "matches"], merged.alias("matches"))


def _id_type(packed: list[tuple[bytes, bytes]]):
    from pyspark.sql.pandas.types import from_arrow_type
    from pyspark.sql.types import LongType

    return from_arrow_type(pa.ipc.open_stream(packed[0][0]).schema.field("item_id").type) if packed else LongType()


def _searcher(packed: list[tuple[bytes, bytes]], strides: list[int], text_col: str, threshold: float, least: float):
    shards: list[Shard] = []

    def work(piece: pa.RecordBatch) -> list:
        if not shards:
            shards.extend(Shard.build(*(pa.ipc.open_stream(p).read_all() for p in pair), threshold) for pair in packed)
        words, starts, vocab = common.words_of(common.clean_texts(piece.column(text_col)))
        vocab = [term(v) for v in common.strings(vocab)]
        best: list[dict] = [{} for _ in range(piece.num_rows)]
        for n, (shard, stride) in enumerate(zip(shards, strides)):
            for doc, first, item, score in shard.search(words, starts, vocab, stride, threshold):
                end = min(starts[doc + 1], starts[doc] + first + 2 * stride)
                passage = [vocab[w] for w in words[starts[doc] + first : end].tolist()]
                q, a = overlap(shard.questions[item], passage), overlap(shard.answers[item], passage)
                if q >= least and a >= least:
                    rank = (q + a, score, -first)
                    if rank > best[doc].get((n, item), ((-1.0,),))[0]:
                        best[doc][n, item] = rank, {
                            "item_id": shard.ids[item], "first_word": first, "bm25": round(score, 9),
                            "question_overlap": q, "answer_overlap": a,
                        }
        return [[[m for _, m in b.values()] for b in best]]

    return work
