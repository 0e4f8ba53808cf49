"""Repeated passages by a logarithmic family of sparse suffix arrays.

Every byte covered by a string of ``length`` bytes that starts anywhere else too, in
the same text or another, is removed.

Sparse suffixes. A window is a string of ``length`` bytes. Its anchor is the
``ANCHOR``-byte string in it with the smallest hash (the first of equal ones), so
equal windows have equal anchors at equal places. Consecutive windows with one
anchor form a *run*, some eighty windows. A run is entered as the suffix at its anchor:
``g``, the fingerprint of the anchor, by which the arrays are sorted, and ``h``, the
fingerprint of the run's whole stretch of text. Suffixes within a run need no
entries: windows can only be equal where their anchors are.

Family. Texts are dealt into batches; each gets an array of its anchors (a row each:
how often, one ``h``, whether others occur), stored sorted and bucketed by ``g``. A
new array is merge-scanned against the existing levels by sort-merge joins that move
no rows (buckets lie side by side); what it meets is a match. Levels of equal size
are merged before the next batch comes, so with 2^k batches every entry is
written at most k + 1 times.

Matches. Anchors met twice or more are looked up in the runs. Where all runs of an
anchor are alike, all their windows are repeated. Of the others (the ends of matches),
alike runs are repeated and count as one from then on; what is left is narrowed
down: runs are cut into parts of 32 windows at equal distances from the anchor, parts
under one key (anchor, distance, and the bytes that windows at these distances share)
are compared in the same way, then parts of 8 and single windows. All of it is
counting by key, so an anchor that a third of the texts have is no hot task. The union
of the windows found is cut out.

Windows count as equal when 64-bit fingerprints agree and those of their anchors, too.
Arrays are sorted by fingerprints, not by alphabet: an alphabetical array would
have to carry 200 bytes of text for each entry, and equality is all that is asked.

Defined cases: a null text is empty; texts shorter than ``length`` lose nothing;
equal texts lose everything (if long enough); matches never cross texts; a text
of any length is read whole, in segments; repeated rows and ids are rows of their
own; empty tables give none. Columns named as a new one are replaced.
"""

from __future__ import annotations

import sys
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from ..session import checkpointed, scratch_path
from .common import pieces

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH = 200
ANCHOR = 32
BATCHES = 4
SEGMENT = 1 << 15  # windows hashed at once: their arrays stay in a core's cache
SIZES = (32, 8, 1)  # windows in a part, round by round; 1 last

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


# --- fingerprints ----------------------------------------------------------------


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * _A) ^ b
    h ^= h >> np.uint64(32)
    h *= _B
    return h ^ (h >> np.uint64(29))


def _powers(raw: np.ndarray, length: int) -> dict[int, np.ndarray]:
    """Fingerprints of all strings of 1, 2, 4, ... bytes, up to ``length``."""
    out, size = {1: raw.astype(np.uint64) * _A + _B}, 1
    while size * 2 <= length:
        half = out[size]
        out[2 * size] = _mix(half[:-size], half[size:])
        size *= 2
    return out


def _prints(powers: dict[int, np.ndarray], length: int, count: int) -> np.ndarray:
    """Fingerprints of the first ``count`` strings of ``length`` bytes."""
    at, made = 0, None
    for size in sorted(powers, reverse=True):
        if length & size:
            part = powers[size][at : at + count]
            made = part if made is None else _mix(made, part)
            at += size
    return made


def _least(values: np.ndarray, width: int, count: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[:count], values[width - size : width - size + count])


def _segments(raw: np.ndarray, ends: np.ndarray, length: int):
    """Fingerprints of the windows of concatenated texts, some at a time: (place of
    the first, powers, fingerprints, text of each, whether it lies within it)."""
    total = len(raw) - length + 1
    for first in range(0, max(0, total), SEGMENT):
        count = min(SEGMENT, total - first)
        powers = _powers(raw[first : first + count + length - 1], length)
        place = np.arange(first, first + count)
        low, high = np.searchsorted(ends, [first, first + count - 1], side="right")
        parts = np.clip(ends[low : high + 1], first, first + count) - np.concatenate([[first], ends[low:high]])
        text = np.repeat(np.arange(low - 1, high), np.maximum(parts, 0))
        yield first, powers, _prints(powers, length, count), text, place + length <= ends[text + 1]


def anchor_size(length: int) -> int:
    return max(1, min(ANCHOR, length // 2))


def runs_of(raw: np.ndarray, ends: np.ndarray, length: int):
    """Runs of concatenated texts (offsets ``ends``), segment by segment: text,
    first window's place in the text, number of windows, g and h of each."""
    size = anchor_size(length)
    width = length - size + 1
    for first, powers, window, text, inside in _segments(raw, ends, length):
        count = len(window)
        anchors = _prints(powers, size, count + width - 1)
        least = _least(anchors, width, count)
        begin = np.ones(count, bool)
        # the anchor changes, was at the window's very start, or the text ends
        begin[1:] = (least[1:] != least[:-1]) | (anchors[: count - 1] == least[:-1]) | (text[1:] != text[:-1])
        starts = np.flatnonzero(begin & inside)
        stops = np.flatnonzero(begin | ~inside)
        after = np.append(stops, count)[np.searchsorted(stops, starts, side="right")]
        run = after - starts
        # at most ``width`` windows: the first and the last one cover the whole stretch
        h = _mix(_mix(window[starts], window[after - 1]), run.astype(np.uint64))
        yield text[starts], first + starts - ends[text[starts]], run, least[starts].view(np.int64), h.view(np.int64)


def _raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary array and the offsets of its values; null is empty."""
    column = column.fill_null(b"")
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


# --- tables ----------------------------------------------------------------------


def _bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """``df`` as a written table bucketed and sorted by ``key``: joins of such tables
    on it move no rows."""
    spark, name = df.sparkSession, f"suffixes_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, key)
    path = scratch_path(spark, "bucketed")
    dealt.write.option("path", path).option("compression", "zstd").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return spark.table(name)


def _runs(texts: DataFrame, length: int) -> DataFrame:
    """(uid, start, run, g, h) of the (uid, text) rows."""

    def work(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                uids = piece.column("uid").to_numpy()
                for text, start, run, g, h in runs_of(*_raw(piece.column("text")), length):
                    made = [pa.array(x) for x in (uids[text], start.astype(np.int32), run.astype(np.int32), g, h)]
                    yield pa.RecordBatch.from_arrays(made, ["uid", "start", "run", "g", "h"])

    return texts.select("uid", "text").mapInArrow(work, "uid long, start int, run int, g long, h long")


class Family:
    """Arrays of anchors in levels of 1, 2, 4, ... batches, and what was met."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.levels: list[tuple[int, DataFrame]] = []
        self.met: list[DataFrame] = []

    def add(self, array: DataFrame) -> None:
        """Scan a new batch's array against all levels, then keep it as one."""
        self._settle()
        self.met.append(array.where("n > 1").select("g", "mixed"))
        for _, level in self.levels:
            old = level.select("g", F.col("h").alias("old_h"), F.col("mixed").alias("old_mixed"))
            both = array.hint("merge").join(old, "g")
            self.met.append(both.select("g", (F.col("mixed") | F.col("old_mixed") | (F.col("h") != F.col("old_h"))).alias("mixed")))
        self.levels.append((0, array))

    def _settle(self) -> None:
        """Merge the two smallest levels as long as they are equal in size."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (rank, a), (_, b) = self.levels.pop(), self.levels.pop()
            a = a.select("g", *[F.col(c).alias(f"a_{c}") for c in ("n", "h", "mixed")])
            both = b.hint("merge").join(a, "g", "full")
            merged = both.select(
                "g",
                (F.coalesce("n", F.lit(0)) + F.coalesce("a_n", F.lit(0))).alias("n"),
                F.least("h", "a_h").alias("h"),
                (
                    F.coalesce("mixed", F.lit(False)) | F.coalesce("a_mixed", F.lit(False)) | F.coalesce(F.col("h") != F.col("a_h"), F.lit(False))
                ).alias("mixed"),
            )
            self.levels.append((rank + 1, _bucketed(merged, "g", self.buckets)))

    def matches(self) -> DataFrame:
        """(g, mixed): the anchors met twice or more, and whether their runs differ."""
        found = self.met[0]
        for part in self.met[1:]:
            found = found.unionByName(part)
        return checkpointed(found.groupBy("g").agg(F.max("mixed").alias("mixed")))


def _ask(asked: DataFrame, texts: DataFrame, length: int, size: int) -> DataFrame:
    """(key, h, uid, start, run, single) of the parts of the asked-for stretches
    (key, uid, start, run, single).

    A part holds the windows whose distance from their anchor has one quotient by
    ``size``. The new key adds that quotient and the bytes that all windows at such
    distances share, so windows can only be equal under equal keys; h is the
    fingerprint of the part's whole stretch. Texts are read where they lie: the
    asked-for rows move to them."""
    fields = ["key", "uid", "start", "run", "single"]
    by_text = asked.groupBy("uid").agg(F.collect_list(F.struct("key", "start", "run", "single")).alias("runs"))
    both = texts.select("uid", "text").join(by_text.hint("shuffle_hash"), "uid")
    cut = F.expr(f"substring(text, r.start + 1, r.run + {length - 1})").alias("stretch")
    rows = both.select("uid", "text", F.explode("runs").alias("r")).select("r.key", "uid", "r.start", "r.run", "r.single", cut)
    width, shared = length - anchor_size(length) + 1, length - size + 1

    def work(batches):
        for batch in batches:
            for piece in pieces(batch, "stretch", 1 << 17):
                key, uid, start, run, single = (piece.column(c).to_numpy(zero_copy_only=False) for c in fields)
                raw, ends = _raw(piece.column("stretch"))
                powers = _powers(raw, length)
                window = _prints(powers, length, len(raw) - length + 1)
                inner = _prints(powers, shared, len(raw) - shared + 1)
                anchors = _prints(powers, anchor_size(length), len(raw) - anchor_size(length) + 1)
                anchor = anchors[ends[:-1, None] + np.arange(width)].argmin(axis=1)
                # all windows, one row's after the other
                row = np.repeat(np.arange(len(run)), run)
                place = np.arange(len(row)) - np.repeat(np.cumsum(run) - run, run)
                node = (anchor[row] - place) // size
                head = np.ones(len(row), bool)
                head[1:] = (row[1:] != row[:-1]) | (node[1:] != node[:-1])
                first = np.flatnonzero(head)
                last = np.append(first[1:], len(row)) - 1
                row, node, place, count = row[first], node[first], place[first], (last - first + 1).astype(np.int32)
                at = ends[row] + place
                common = inner[ends[row] + anchor[row] - node * size]
                new_key = _mix(_mix(key[row].view(np.uint64), node.astype(np.uint64)), common)
                h = _mix(_mix(window[at], window[at + count - 1]), count.astype(np.uint64))
                made = [new_key.view(np.int64), h.view(np.int64), uid[row], (start[row] + place).astype(np.int32), count, single[row]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], ["key", "h", "uid", "start", "run", "single"])

    return rows.mapInArrow(work, "key long, h long, uid long, start int, run int, single boolean")


def _sort_out(parts: DataFrame, matches: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """What is known to be repeated of the parts (key, h, uid, start, run, single), and
    what must be looked at more closely, given the (key, mixed) met twice or more.

    All parts of a key alike: repeated. Of others, alike ones are repeated and go on
    as one, which is not ``single``: it only stands for what the single ones may meet."""
    met = parts.join(matches, "key")
    met = met.select("uid", "start", "run", "single", "mixed", *[F.when(F.col("mixed"), F.col(c)).alias(c) for c in ("key", "h")])
    met = checkpointed(met)
    differing = met.where("mixed")
    classes = differing.groupBy("key", "h").agg(
        F.count(F.lit(1)).alias("n"), F.max("single").alias("any"), F.min(F.struct("uid", "start", "run")).alias("one")
    )
    classes = checkpointed(classes.select("key", "h", "n", (F.col("any") & (F.col("n") == 1)).alias("single"), "one.*"))
    alike = classes.where("n > 1").select("key", "h")
    known = [
        met.where("single AND NOT mixed").select("uid", "start", "run"),
        differing.where("single").join(alike, ["key", "h"], "left_semi").select("uid", "start", "run"),
    ]
    open_keys = checkpointed(classes.groupBy("key").agg(F.max("single").alias("any")).where("any").select("key"))
    return known, checkpointed(classes.join(open_keys, "key", "left_semi").select("key", "uid", "start", "run", "single"))


def repeated_runs(texts: DataFrame, length: int, batches: int, buckets: int, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """(uid, start, run): windows of the written (uid, text) rows that occur twice,
    as runs of consecutive starts."""
    batch = F.pmod(F.xxhash64("uid"), F.lit(batches)).cast("int").alias("batch")
    entries = _runs(texts, length).groupBy(batch, "g").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("h"), F.max("h").alias("top"))
    entries = entries.select("batch", "g", "n", "h", (F.col("h") != F.col("top")).alias("mixed"))
    spark, name = texts.sparkSession, f"suffixes_{uuid.uuid4().hex}"
    out = entries.repartition(buckets, "g").write.option("path", scratch_path(spark, "arrays")).option("compression", "zstd")
    out.partitionBy("batch").bucketBy(buckets, "g").sortBy("g").saveAsTable(name)
    family = Family(buckets)
    for b in range(batches):
        family.add(spark.table(name).where(F.col("batch") == b).drop("batch"))

    runs = _runs(texts, length).withColumnRenamed("g", "key").withColumn("single", F.lit(True))
    found, asked = _sort_out(runs, family.matches().withColumnRenamed("g", "key"))
    for size in dict.fromkeys(max(1, min(s, length // 4)) for s in sizes):
        parts = checkpointed(_ask(asked, texts, length, size))
        keys = parts.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("h"), F.max("h").alias("top"), F.max("single").alias("any"))
        matches = checkpointed(keys.where("n > 1 AND any").select("key", (F.col("h") != F.col("top")).alias("mixed")))
        known, asked = _sort_out(parts, matches)
        found += known
    return reduce(DataFrame.unionByName, found)


def remove_repeats(
    df: DataFrame,
    text_col: str = "text",
    length: int = LENGTH,
    keep: list[str] | None = None,
    batches: int = BATCHES,
) -> DataFrame:
    """``df`` (its ``keep`` columns, default all) with ``n_bytes``, ``n_removed``,
    ``n_spans`` (maximal removed stretches) and ``kept`` (the bytes left)."""
    spark = df.sparkSession
    new = [StructField("n_bytes", LongType()), StructField("n_removed", LongType()), StructField("n_spans", LongType())]
    new.append(StructField("kept", BinaryType()))
    names = {f.name for f in new}
    kept = [f for f in df.schema.fields if f.name not in names and (keep is None or f.name in keep)]
    # a struct: no column can clash with the ones used here
    row = F.struct(*[F.col(f.name) for f in kept]) if kept else F.struct(F.lit(None).alias("none"))
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = _bucketed(df.select(F.monotonically_increasing_id().alias("uid"), row.alias("row"), text.alias("text")), "uid", buckets)
    found = repeated_runs(texts, length, batches, buckets)
    by_text = found.groupBy("uid").agg(F.collect_list(F.struct("start", "run")).alias("runs"))
    both = texts.join(by_text.hint("shuffle_hash"), "uid", "left").select("row", "text", "runs")
    out = StructType([*kept, *new])
    arrow = to_arrow_schema(out)

    def cut(data: bytes, runs: list) -> tuple[int, int, int, bytes]:
        spans: list[list[int]] = []
        for r in sorted(runs or [], key=lambda r: r["start"]):
            low, high = r["start"], r["start"] + r["run"] - 1 + length
            if spans and low <= spans[-1][1]:
                spans[-1][1] = max(high, spans[-1][1])
            else:
                spans.append([low, high])
        left, at = [], 0
        for low, high in spans:
            left.append(data[at:low])
            at = high
        left.append(data[at:])
        whole = b"".join(left)
        return len(data), len(data) - len(whole), len(spans), whole

    def work(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                made = [cut(d, r) for d, r in zip(piece.column("text").to_pylist(), piece.column("runs").to_pylist())]
                struct = piece.column("row")
                arrays = [struct.field(i) for i in range(len(kept))] + [pa.array(c) for c in zip(*made)]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, arrow)], schema=arrow)

    return both.mapInArrow(work, out)
