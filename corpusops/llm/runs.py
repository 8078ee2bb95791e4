"""Periodic runs of words by longest common extensions (LCE) over a difference cover.

A run is a stretch of words with smallest period ``q`` and at least ``max(6, 4 * q)`` words that cannot be
extended. The texts of an Arrow batch become one sequence of word numbers, longest text first, with a number
of its own between any two texts, so nothing extends from one text into another.

1. **Harmonic grid**: a run of ``4 * q`` words holds at least ``3 * q`` consecutive places ``i`` with equal words
   at ``i`` and ``i + q``. For every ``q`` a grid of step ``3 * q`` over the texts long enough therefore meets each run;
   all grids together have ``n log n / 3`` places. Places with unequal words are left out at once.
2. **Few words**: what remains is compared word by word, forwards and backwards, for one cover length.
   Nearly all places end here.
3. **Difference cover**: for texts with longer extensions, only the suffixes whose place is in the cover modulo ``v``
   are sorted. They are suffixes of a sequence of letters of ``v`` words, sorted by prefix doubling. Any
   two places reach places that are both in the cover after fewer than ``v`` words; from there the
   extension is the minimum of the common prefixes between their ranks, read from a sparse table, and
   fewer than ``v`` further words. The same on the reversed sequence gives backward extensions.
4. Periods of one stretch are multiples of its smallest, so the smallest one found per stretch is kept.

Texts are independent rows, so nothing is shuffled; a batch bounds the memory, and a text longer than a
batch is a batch of its own, with a wider cover (fewer suffixes) the longer it is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusops.llm.common import as_bytes, bound_batches

LEAST_WORDS = 6
LEAST_EXPONENT = 4
# Places resolved at once; the rest of a batch follows.
PLACES = 1_000_000
# Runs of so many words are looked up before places inside them are compared again.
LONG_RUN = 32

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(RUN)),
        T.StructField("collapsed", T.StringType()),
    ]
)


def difference_cover(side: int) -> np.ndarray:
    """Which residues modulo ``side ** 2`` are in the cover: every difference is a multiple of ``side`` less a small one."""
    cover = np.zeros(side * side, bool)
    cover[:side] = True
    cover[::side] = True
    return cover


def cover_side(n: int) -> int:
    return 8 if n < 2_000_000 else 16 if n < 16_000_000 else 32


class CommonExtensions:
    """Longest common extensions in ``words``, whose last word occurs nowhere else."""

    def __init__(self, words: np.ndarray, side: int | None = None):
        self.words = words
        self.cover = difference_cover(side or cover_side(len(words)))
        self.v = v = len(self.cover)
        ranges = np.arange(v)
        # Words from two residues until both places are in the cover.
        self.shift = np.zeros((v, v), np.int16)
        for d in range(v - 1, -1, -1):
            inside = self.cover[(ranges + d) % v]
            self.shift[inside[:, None] & inside[None, :]] = d
        self._sort()

    def _sort(self) -> None:
        n, v = len(self.words), self.v
        residues = np.flatnonzero(self.cover)
        counts = (n - residues + v - 1) // v
        counts[counts < 0] = 0
        # One letter sequence a residue, each with an end of its own.
        self.offset = np.zeros(v, np.int64)
        self.offset[residues] = np.cumsum(counts + 1) - counts - 1
        places = np.concatenate([r + v * np.arange(c) for r, c in zip(residues, counts)])
        letters = np.empty(int((counts + 1).sum()), np.int64)
        ends = self.offset[residues] + counts
        inner = np.ones(len(letters), bool)
        inner[ends] = False
        letters[inner] = self._letters(places) + len(residues)
        letters[ends] = np.arange(len(residues))
        m, width = len(letters), 1
        rank = np.unique(letters, return_inverse=True)[1].astype(np.int64)
        levels = []
        while True:
            levels.append(rank.astype(np.int32))
            following = np.full(m, -1, np.int64)
            following[: m - width] = rank[width:]
            key = rank * (m + 1) + following + 1
            order = np.argsort(key, kind="stable")
            fresh = np.append(0, np.cumsum(key[order][1:] != key[order][:-1]))
            rank = np.empty(m, np.int64)
            rank[order] = fresh
            width *= 2
            if fresh[-1] == m - 1:
                break
        self.rank = rank
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(m - 1, np.int64)
        for power in range(len(levels) - 1, -1, -1):
            level, step = levels[power], 1 << power
            same = (a < m) & (b < m)
            same[same] = level[a[same]] == level[b[same]]
            common[same] += step
            a[same] += step
            b[same] += step
        self.table = [common.astype(np.int32)]
        while 2 * (1 << (len(self.table) - 1)) <= m - 1:
            last, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(last[:-half], last[half:]))

    def _letters(self, places: np.ndarray) -> np.ndarray:
        """A number for the ``v`` words from each place; equal numbers for equal words only."""
        padded = np.append(self.words, np.full(self.v, -1, self.words.dtype))
        base = np.uint64(0x9E3779B97F4A7C15)
        while True:
            value = np.zeros(len(places), np.uint64)
            for t in range(self.v):
                value = (value ^ (value >> np.uint64(29))) * base + padded[places + t].astype(np.uint64)
            order = np.argsort(value, kind="stable")
            equal = np.flatnonzero(value[order][1:] == value[order][:-1])
            a, b = places[order[equal]], places[order[equal + 1]]
            if all((padded[a + t] == padded[b + t]).all() for t in range(self.v)):
                return np.unique(value, return_inverse=True)[1]
            base += np.uint64(0x5851F42D4C957F2E)

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words from ``i`` and ``j`` on, for arrays of different places."""
        v = self.v
        need = self.shift[i % v, j % v].astype(np.int64)
        found = np.zeros(len(i), np.int64)
        open_ = np.arange(len(i))
        while open_.size:
            open_ = open_[found[open_] < need[open_]]
            open_ = open_[self.words[i[open_] + found[open_]] == self.words[j[open_] + found[open_]]]
            found[open_] += 1
        there = np.flatnonzero(found == need)
        a, b = (x[there] + need[there] for x in (i, j))
        a, b = (self.rank[self.offset[x % v] + x // v] for x in (a, b))
        low, high = np.minimum(a, b), np.maximum(a, b)
        power = np.frexp((high - low).astype(float))[1] - 1
        least = np.zeros(len(there), np.int64)
        for p in np.unique(power):
            at = np.flatnonzero(power == p)
            row = self.table[p]
            least[at] = np.minimum(row[low[at]], row[high[at] - (1 << int(p))])
        found[there] += least * v
        tail, _ = compare(self.words, i[there] + found[there], j[there] + found[there], 1, v)
        found[there] += tail
        return found


def compare(words: np.ndarray, i: np.ndarray, j: np.ndarray, step: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Equal words from ``i`` and ``j`` in direction ``step``, up to ``most``; and which pairs got that far."""
    found = np.zeros(len(i), np.int64)
    open_ = np.arange(len(i))
    for t in range(most):
        open_ = open_[words[i[open_] + step * t] == words[j[open_] + step * t]]
        if not open_.size:
            break
        found[open_] += 1
    return found, open_


def extend(words: np.ndarray, starts: np.ndarray, i: np.ndarray, j: np.ndarray, side: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Equal words before and from the places ``i`` and ``j``, each pair within one text."""
    most = 64
    ahead, long_ahead = compare(words, i, j, 1, most)
    back, long_back = compare(words, i - 1, j - 1, -1, most)
    if long_ahead.size or long_back.size:
        # Only texts with long extensions are indexed: they are brought together, each behind its separator.
        text = np.searchsorted(starts, i, "right") - 1
        used = np.unique(text[np.concatenate([long_ahead, long_back])])
        ends = np.append(starts[1:] - 1, len(words) - 1)
        lengths = ends[used] - starts[used] + 1
        at = np.append(0, np.cumsum(lengths))
        sub = np.concatenate([words[:1], *(words[starts[t] : ends[t] + 1] for t in used)])
        move = np.zeros(len(starts), np.int64)
        move[used] = at[:-1] + 1 - starts[used]
        if long_ahead.size:
            by = move[text[long_ahead]]
            ahead[long_ahead] = CommonExtensions(sub, side).of(i[long_ahead] + by, j[long_ahead] + by)
        if long_back.size:
            by, last = move[text[long_back]], len(sub) - 1
            reverse = CommonExtensions(sub[::-1].copy(), side)
            back[long_back] = reverse.of(last - (i[long_back] + by - 1), last - (j[long_back] + by - 1))
    return back, ahead


def runs_of(texts: list[np.ndarray], side: int | None = None) -> list[np.ndarray]:
    """Rows ``start, length, period`` of the runs of each sequence of word numbers, by start, then period."""
    out = [np.zeros((0, 3), np.int64)] * len(texts)
    order = sorted((k for k, x in enumerate(texts) if len(x) >= LEAST_WORDS), key=lambda k: -len(texts[k]))
    if not order:
        return out
    lengths = np.array([len(texts[k]) for k in order])
    starts = np.cumsum(lengths + 1) - lengths
    top = 1 + max(int(texts[k].max()) for k in order)
    words = np.empty(int(lengths.sum()) + len(order) + 1, np.int64)
    words[0] = top
    for n, (k, at) in enumerate(zip(order, starts)):
        words[at : at + len(texts[k])] = texts[k]
        words[at + len(texts[k])] = top + 1 + n
    found: list[np.ndarray] = []
    pending: list[tuple[np.ndarray, int]] = []

    def resolve() -> None:
        if not pending:
            return
        i = np.concatenate([p for p, _ in pending])
        q = np.repeat([q for _, q in pending], [len(p) for p, _ in pending])
        pending.clear()
        text = np.searchsorted(starts, i, "right") - 1
        within = i + q < starts[text] + lengths[text]
        i, q = i[within], q[within]
        back, ahead = extend(words, starts, i, i + q, side)
        length = back + ahead + q
        good = length >= np.maximum(LEAST_WORDS, LEAST_EXPONENT * q)
        found.append(_smallest(np.stack([i - back, length, q], 1)[good]))
        long = found[-1][found[-1][:, 1] >= LONG_RUN]
        for start, size, period in long[np.argsort(long[:, 1], kind="stable")]:
            known_end[start : start + size] = start + size
            known_period[start : start + size] = period

    held, resolve_at = 0, 1
    known_end, known_period = np.zeros(len(words), np.int64), np.ones(len(words), np.int64)
    for q in range(1, int(lengths[0]) // LEAST_EXPONENT + 1):
        texts_left = np.searchsorted(-lengths, -max(LEAST_WORDS, LEAST_EXPONENT * q), "right")
        if not texts_left:
            break
        end, step = starts[texts_left - 1] + lengths[texts_left - 1], (LEAST_EXPONENT - 1) * q
        hits = np.flatnonzero(words[1 : end - q : step] == words[1 + q : end : step]) * step + 1
        # A multiple of the period of a run that holds both places shows the same stretch again.
        hits = hits[(known_end[hits] <= hits + q) | (q % known_period[hits] != 0)]
        for part in np.array_split(hits, len(hits) // PLACES + 1):
            pending.append((part, q))
            held += len(part)
            if held >= PLACES or q >= resolve_at:
                resolve()
                held, resolve_at = 0, 2 * q
    resolve()
    rows = _smallest(np.concatenate(found)) if found else np.zeros((0, 3), np.int64)
    text = np.searchsorted(starts, rows[:, 0], "right") - 1
    rows[:, 0] -= starts[text]
    for n in np.unique(text):
        mine = rows[text == n]
        out[order[n]] = mine[np.lexsort((mine[:, 2], mine[:, 0]))]
    return out


def _smallest(rows: np.ndarray) -> np.ndarray:
    """The smallest period of each stretch, in order of the stretches."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    return rows[np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(1))[: len(rows)]]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Places of the words in no run, or among the first ``period`` words of every run that holds them."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.flatnonzero(np.cumsum(change)[:n] == 0)


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def periodic_runs(text: Column) -> Column:
    """``n_words``, ``runs`` (``start, length, period`` in words) and ``collapsed`` of each text."""

    @F.arrow_udf(FOUND)
    def searched(texts: pa.Array) -> pa.Array:
        numbers = _Numbers()
        words = [(t or b"").split() for t in as_bytes(texts)]
        found = runs_of([np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)) for w in words])
        collapsed = []
        for w, runs in zip(words, found):
            collapsed.append(b" ".join([w[k] for k in kept_words(len(w), runs)] if len(runs) else w))
        rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        values = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], ["start", "length", "period"])
        offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
        return pa.StructArray.from_arrays(
            [
                pa.array([len(w) for w in words], pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets), values),
                pa.array(collapsed, pa.binary()).cast(pa.string()),
            ],
            ["n_words", "runs", "collapsed"],
        )

    return searched.asNondeterministic()(text)


def find_runs(docs: DataFrame, text: str | Column = "text", result: str = "periodic") -> DataFrame:
    """``docs`` with a struct ``result``: ``n_words``, ``runs`` and ``collapsed``.

    Words are separated by ASCII whitespace. ``runs`` lists every run by start, then period. ``collapsed`` joins by one
    space the words that no run holds after its first ``period`` words. A null text counts as empty: no
    words, no runs, an empty ``collapsed``. Every row is judged alone, so repeated rows get equal results; no
    other column is read, and a column named ``result`` is replaced. An empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    column = F.col(f"`{text}`") if isinstance(text, str) else text
    return docs.withColumn(result, periodic_runs(column))


def strongest(runs: Column) -> Column:
    """The run with the greatest length over period; of equal ones the first by start, then period."""

    def better(a: Column, b: Column) -> Column:
        left, right = a["length"] * b["period"], b["length"] * a["period"]
        first = (a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] <= b["period"]))
        return F.when((left > right) | ((left == right) & first), a).otherwise(b)

    return F.when(F.size(runs) > 0, F.aggregate(runs, runs[0], better))
