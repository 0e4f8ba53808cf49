"""Language identification by rank-order profiles.

A language's profile is its ``profile_size`` most frequent letter n-grams
(n = 1 to 3, lower case, words padded with ``_``), most frequent first. A text
gets the same ranking of its own n-grams and is compared with each profile by
the out-of-place distance: for each of the text's n-grams the difference of
the two ranks, or ``profile_size`` where the profile lacks it (Cavnar &
Trenkle 1994). The nearest profile names the language.

Profiles are counted over all training rows with a language, in one pass and
one aggregation over (language, n-gram). n-grams of equal count rank by their
frequency in all profiles together, then by name, so a ranking depends on
nothing but the text and the profiles.

``score`` is 1 - distance / largest possible distance, from 0 to 1. Defined
cases: a null text, or one without a letter, is ``und`` with score 0 (as is
every text where nothing was learned); of equal distances the language first
in name order wins; texts are taken whole, whatever their length.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from . import common

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROFILE_SIZE = 300
UNKNOWN = "und"
PAD = "_"
CODE_POINTS = 0x110000
LONG_TEXT = 1 << 20  # characters counted at once
DENSE_CELLS = 1 << 20


def _compact(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``codes`` (below ``size``) among their distinct values."""
    if size <= 1 << 24:
        seen = np.zeros(size, bool)
        seen[codes] = True
        values = np.flatnonzero(seen)
        place = np.zeros(size, np.int32)
        place[values] = np.arange(len(values), dtype=np.int32)
        return place[codes], values
    values, place = np.unique(codes, return_inverse=True)
    return place.astype(np.int32), values


class Letters:
    """Which code points are letters, looked up once each."""

    def __init__(self):
        self.kind = np.full(CODE_POINTS, 2, np.uint8)

    def mask(self, points: np.ndarray) -> np.ndarray:
        kinds = self.kind[points]
        for c in np.unique(points[kinds == 2]):
            self.kind[c] = chr(c).isalpha()
        return self.kind[points] == 1


def gram_ids(texts: list[str], letters: Letters) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[str]]:
    """For n = 1, 2, 3: the n-gram number and the text of every n-gram, in
    text order; and the n-grams by number."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer(("\0".join(lowered) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter((len(t) + 1 for t in lowered), np.int64, len(lowered))
    alpha = letters.mask(points)
    seen = np.zeros(CODE_POINTS, bool)
    seen[points[alpha]] = True
    alphabet = np.flatnonzero(seen)
    number = np.zeros(CODE_POINTS, np.int32)
    number[alphabet] = np.arange(1, len(alphabet) + 1, dtype=np.int32)
    # letters, and one separator after each run of them
    keep = alpha.copy()
    keep[1:] |= alpha[:-1]
    seq = np.concatenate([[0], number[points[keep]]]).astype(np.int64)
    owner = np.repeat(np.arange(len(lowered), dtype=np.int32), sizes)[keep]
    owner = np.concatenate([np.zeros(1, np.int32), owner])
    base = len(alphabet) + 1

    is_letter = seq != 0
    ones = (seq[is_letter] - 1).astype(np.int32), owner[is_letter]
    pair, pairs = _compact(seq[:-1] * base + seq[1:], base * base)
    # a pair belongs to the text of its letter
    two = pair, np.where(is_letter[:-1], owner[:-1], owner[1:])
    inner = is_letter[1:-1]
    triple, triples = _compact(pair[:-1][inner].astype(np.int64) * base + seq[2:][inner], len(pairs) * base)
    three = triple, owner[1:-1][inner]

    sign = [PAD, *map(chr, alphabet)]
    names = sign[1:]
    pair_names = [sign[p // base] + sign[p % base] for p in pairs.tolist()]
    names += pair_names
    names += [pair_names[t // base] + sign[t % base] for t in triples.tolist()]
    shift = len(alphabet), len(alphabet) + len(pairs)
    return [ones, (two[0] + shift[0], two[1]), (three[0] + shift[1], three[1])], names


def _cuts(text: str) -> list[str]:
    """A long text in parts that end between words."""
    parts, at = [], 0
    while len(text) - at > LONG_TEXT:
        end = min((e for e in (text.find(c, at + LONG_TEXT) for c in " \n\t") if e >= 0), default=len(text))
        parts.append(text[at:end])
        at = end
    return [*parts, text[at:]]


def dense_counts(texts: list[str], letters: Letters):
    """Blocks of texts: (first text, counts by text and n-gram, n-grams)."""
    if not texts:
        return
    grams, names = gram_ids(texts, letters)
    step = max(1, DENSE_CELLS // max(1, len(names)))
    for first in range(0, len(texts), step):
        last = min(len(texts), first + step)
        cells = (last - first) * len(names)
        total = np.zeros(cells, np.int64)
        for ids, owner in grams:
            a, b = np.searchsorted(owner, [first, last])
            total += np.bincount((owner[a:b] - first) * np.int64(len(names)) + ids[a:b], minlength=cells)
        yield first, total.reshape(last - first, len(names)), names


def long_counts(text: str, letters: Letters) -> tuple[np.ndarray, list[str]]:
    """Counts of one long text, part by part."""
    total: Counter = Counter()
    for part in _cuts(text):
        for _, counts, names in dense_counts([part], letters):
            total.update(dict(zip(names, counts[0].tolist())))
    names = sorted(total)
    return np.array([total[n] for n in names], np.int64), names


@dataclass
class Profiles:
    """Languages in name order; of each n-gram of any profile its rank in
    every language (``size`` where absent) and its place in the tie order."""

    languages: list[str]
    size: int
    ranks: dict[str, np.ndarray]
    places: dict[str, int]

    def _table(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ranks by language, and the tie order, for a list of n-grams."""
        ranks = np.full((len(self.languages), len(names)), self.size, np.int64)
        place = np.empty(len(names), np.int64)
        order = sorted(range(len(names)), key=lambda i: (self.places.get(names[i], len(self.places)), names[i]))
        place[order] = np.arange(len(names))
        for i, name in enumerate(names):
            if name in self.ranks:
                ranks[:, i] = self.ranks[name]
        return ranks, place

    def _nearest(self, counts: np.ndarray, ranks: np.ndarray, key: np.ndarray) -> tuple[str, float]:
        """``key``: larger for n-grams earlier in the tie order."""
        found = np.flatnonzero(counts)
        if not len(found) or not self.languages:
            return UNKNOWN, 0.0
        order = counts[found] * np.int64(len(key) + 1) + key[found]
        if len(found) > self.size:
            top = np.argpartition(order, -self.size)[-self.size :]
            found, order = found[top], order[top]
        found = found[np.argsort(order)[::-1]]
        theirs = ranks[:, found]
        away = np.where(theirs == self.size, self.size, np.abs(theirs - np.arange(len(found)))).sum(axis=1)
        best = int(np.argmin(away))
        return self.languages[best], float(1.0 - away[best] / (self.size * len(found)))

    def predict(self, texts: list[str], letters: Letters) -> tuple[list[str], list[float]]:
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        short = [i for i, t in enumerate(texts) if len(t) <= LONG_TEXT]
        table = None
        for first, counts, names in dense_counts([texts[i] for i in short], letters):
            if table is None:  # the same n-grams in every block
                ranks, place = self._table(names)
                table = ranks, len(place) - place
            for k, row in enumerate(counts):
                out[short[first + k]] = self._nearest(row, *table)
        for i, t in enumerate(texts):
            if len(t) > LONG_TEXT:
                counts, names = long_counts(t, letters)
                ranks, place = self._table(names)
                out[i] = self._nearest(counts, ranks, len(place) - place)
        return [o[0] for o in out], [o[1] for o in out]


TASK_GRAMS = 500_000  # counts that a task holds before it hands them on


def gram_counts(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, gram, n) over all rows with a language."""
    rows = df.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def made(totals: dict) -> Iterator[pa.RecordBatch]:
        for lang, have in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(have), pa.string()), pa.array(list(have), pa.string()), pa.array(list(have.values()), pa.int64())],
                ["lang", "gram", "n"],
            )

    def count(batches):
        letters, totals = Letters(), {}
        for batch in batches:
            for piece in common.pieces(batch, "text"):
                langs = np.array(piece.column("lang").to_pylist(), object)
                texts = [c for t in common.strings(common.clean_texts(piece.column("text"))) for c in [_cuts(t)]]
                langs = np.repeat(langs, [len(c) for c in texts])
                for first, counts, names in dense_counts([p for c in texts for p in c], letters):
                    mine = langs[first : first + len(counts)]
                    for lang in dict.fromkeys(mine.tolist()):
                        sums = counts[mine == lang].sum(axis=0)
                        have = totals.setdefault(lang, Counter())
                        for i in np.flatnonzero(sums).tolist():
                            have[names[i]] += int(sums[i])
                    if sum(map(len, totals.values())) > TASK_GRAMS:
                        yield from made(totals)
                        totals = {}
        yield from made(totals)

    return rows.mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE_SIZE) -> Profiles:
    """Profiles of every language of ``df``. What comes to the driver are the
    profiles: ``size`` n-grams a language."""
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    counts = gram_counts(df, text_col, lang_col)
    top = counts.withColumn("r", F.row_number().over(best)).where(F.col("r") <= size).collect()
    return profiles_of([(r.lang, r.gram, r.n, r.r - 1) for r in top], size)


def profiles_of(rows: list[tuple[str, str, int, int]], size: int) -> Profiles:
    """From (language, n-gram, count, rank)."""
    languages = sorted({r[0] for r in rows})
    at = {lang: i for i, lang in enumerate(languages)}
    sums, shares, ranks = Counter(), Counter(), {}
    for lang, _, n, _ in rows:
        sums[lang] += n
    for lang, gram, n, rank in sorted(rows):
        ranks.setdefault(gram, np.full(len(languages), size, np.int64))[at[lang]] = rank
        shares[gram] += n / sums[lang]
    places = {g: i for i, g in enumerate(sorted(shares, key=lambda g: (-shares[g], g)))}
    return Profiles(languages, size, ranks, places)


def identify(df: DataFrame, profiles: Profiles, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` with ``lang_pred`` and ``score``; columns of these names are
    replaced. No shuffle: the profiles go with the job."""
    fields = [StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    letters = []  # one for each task's copy of this function

    def work(piece: pa.RecordBatch) -> list:
        if not letters:
            letters.append(Letters())
        langs, scores = profiles.predict(common.strings(common.clean_texts(piece.column(text_col))), letters[0])
        return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

    return common.add_columns(df, text_col, fields, work, keep)
