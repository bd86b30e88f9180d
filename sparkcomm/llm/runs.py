"""Periodic runs of words: maximal pairs from a bottom-up LCP-interval tree."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkcomm.llm.common import let, words

#: Words that make a run, and how often its period fits in.
MIN_LENGTH, MIN_EXPONENT = 12, 2
#: Words that a task sorts together; a longer text is sorted alone.
TOGETHER = 1 << 19

_RUN = "struct<start:bigint,length:bigint,period:bigint>"


def _ranks(values: np.ndarray) -> np.ndarray:
    """Rank of every value: how many values are smaller. A group of equal ones has as many ranks in reserve as members."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    out = np.empty(len(values), np.int64)
    place = np.arange(len(values))
    out[order] = np.maximum.accumulate(np.where(np.append(True, ordered[1:] != ordered[:-1]), place, 0))
    return out


def _repeated(rank: np.ndarray) -> np.ndarray:
    """Positions whose rank stands more than once."""
    return np.flatnonzero(np.bincount(rank)[rank] > 1)


def sorted_suffixes(ids: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """Positions in suffix order, text after text, of the suffixes whose first ``width`` words stand twice or more in their text.

    Prefix doubling; a suffix leaves the sort as soon as its rank is its own. A text's end sorts before all words.
    """
    n = len(ids)
    if not n:
        return np.zeros(0, np.int64)
    end = np.repeat(np.cumsum(sizes), sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    rank = _ranks(owner * (int(ids.max()) + 1) + ids)
    live, reach = _repeated(rank), 1
    kept = live
    while len(live):
        # order inside a group of equal ranks by the rank of what follows `step` words on
        step = min(reach, width - reach) if reach < width else reach
        then = live + step
        follow = np.where(then < end[live], rank[np.minimum(then, n - 1)] + 1, 0)
        key = rank[live] * (n + 1) + follow
        order = np.argsort(key, kind="stable")
        live, key = live[order], key[order]
        group, place = rank[live], np.arange(len(live))
        first = np.append(True, group[1:] != group[:-1])
        new = np.append(True, key[1:] != key[:-1])
        rank[live] = group + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(first, place, 0))
        live = np.sort(live[~new | np.append(~new[1:], False)])
        reach += step
        if reach <= width:
            kept = live
    return kept[np.argsort(rank[kept], kind="stable")]


def common_prefixes(order: list[int], word: list[int], width: int) -> list[int]:
    """Length of the common prefix of each suffix with the one before it in suffix order (Kasai); the first has 0."""
    before = dict(zip(order[1:], order, strict=False))
    n, length, last = len(word), 0, -2
    out = dict.fromkeys(order, 0)
    for i in sorted(order):
        length = length - 1 if i == last + 1 and length > width else 0  # shorter ones may lead to a suffix that is not here
        last = i
        j = before.get(i)
        if j is None:
            length = 0
            continue
        while i + length < n and j + length < n and word[i + length] == word[j + length]:
            length += 1
        out[i] = length
    return [out[i] for i in order]


def maximal_pairs(order: list[int], lcp: list[int], word: list[int], min_length: int) -> dict[tuple[int, int], int]:
    """Period by (start, end) of the runs of one text.

    The LCP-interval tree is walked bottom-up. An interval of depth l has its positions in order, each in the class of
    the word on its left. Positions of different children are alike for exactly l words; if their classes differ they are
    a maximal pair, and if their distance q is at most l the q + l words from the first one on have period q and
    cannot grow: a run. A run's own pair is made of neighbours (an occurrence between them would be a smaller
    period), so each position meets the nearest ones of the other child; a pair whose distance is a multiple of
    the period has the same stretch, and the least distance stays.
    """
    runs: dict[tuple[int, int], int] = {}
    left = [-1, *word]  # left[i]: class of position i

    def pair(i: int, j: int, depth: int) -> None:
        q = j - i
        if q <= depth and q + depth >= min_length and (i == 0 or left[i] != left[j]):
            stretch = (i, j + depth)
            if runs.get(stretch, q) >= q:
                runs[stretch] = q

    def joined(a: list[int], b: list[int], depth: int) -> list[int]:
        if len(a) < len(b):
            a, b = b, a
        for x in b:
            p = bisect_left(a, x)
            if p:
                pair(a[p - 1], x, depth)
            if p < len(a):
                pair(x, a[p], depth)
        if len(b) * 16 < len(a):
            for x in b:
                insort(a, x)
        else:
            a += b
            a.sort()
        return a

    stack: list[tuple[int, list[int]]] = []
    least = -(-min_length // 2)  # a shorter common prefix makes no run
    for i, depth in chain(zip(order, lcp, strict=True), [(None, 0)]):
        if stack or i is not None:
            current = None
            while stack and stack[-1][0] > depth:
                top, positions = stack.pop()
                current = positions if current is None else joined(positions, current, top)
            if current is not None and depth >= least:
                if stack and stack[-1][0] == depth:
                    stack[-1] = (depth, joined(stack[-1][1], current, depth))
                else:
                    stack.append((depth, current))
        if i is not None:
            stack.append((len(word) + 1, [i]))  # a leaf: deeper than any interval
    return runs


def runs_of(texts: list[str | None], min_length: int = MIN_LENGTH) -> list[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """Words of every text, and its runs as (start, length, period) in this order."""
    split = [t.encode().split() if t else [] for t in texts]
    found: list[list[tuple[int, int, int]]] = [[] for _ in split]
    sizes = np.array([len(w) for w in split], np.int64)
    lot = (np.cumsum(sizes) - sizes) // TOGETHER
    for lo, hi in zip(np.searchsorted(lot, lots := np.unique(lot)), np.searchsorted(lot, lots, "right"), strict=True):
        _runs(split[lo:hi], sizes[lo:hi], found[lo:hi], min_length)
    return list(zip(split, found, strict=True))


def _runs(split: list[list[bytes]], sizes: np.ndarray, found: list[list], min_length: int) -> None:
    number: dict[bytes, int] = defaultdict(count().__next__)
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
    width = -(-min_length // 2)
    order = sorted_suffixes(ids, sizes, width)
    starts = np.cumsum(sizes) - sizes
    borders = np.searchsorted(np.searchsorted(starts, order, "right") - 1, np.arange(len(sizes) + 1))
    for d in np.flatnonzero(np.diff(borders)).tolist():
        here = (order[borders[d] : borders[d + 1]] - starts[d]).tolist()
        word = ids[starts[d] : starts[d] + sizes[d]].tolist()
        pairs = maximal_pairs(here, common_prefixes(here, word, width), word, min_length)
        found[d].extend(sorted((s, e - s, q) for (s, e), q in pairs.items()))


def collapsed(split: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run repeats after its first period."""
    if not runs:
        return b" ".join(split)
    edge = np.zeros(len(split) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return b" ".join(split[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist())


def find_runs(docs: DataFrame, *, key: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """Key, runs (array of start, length, period; by start, then period) and collapsed (the text with each run cut to one period).

    A run is a stretch of words with smallest period q, at least ``min_length`` words and 2 q long, that no neighbouring
    word extends. Words are exact, case included, numbered from 0. Null and empty texts have no runs and an empty
    ``collapsed``. Rows go by their own text, whatever their key. A text is the work of one task: a sort of its repeated
    suffixes and a walk over them; other texts cost a few vector sorts a word.
    """
    kind = docs.select(key).schema[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                told = runs_of(batch.column(1).to_pylist(), min_length)
                flat = np.array([r for _, runs in told for r in runs], np.int64).reshape(-1, 3)
                offsets = np.cumsum([0, *(len(runs) for _, runs in told)]).astype(np.int32)
                structs = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], ["start", "length", "period"])
                texts = pa.array([collapsed(*t) for t in told], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), structs), texts], [key, "runs", "collapsed"])

    schema = T.StructType([kind, *T.StructType.fromDDL(f"runs array<{_RUN}>, collapsed string")])
    return docs.select(key, text).mapInArrow(run, schema)


def repeat_tails(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and text; of the texts whose crc32 h of the key (as text; null: empty) ends in 0, the words from a on give way to repetitions.

    With n words and g = floor(h / 10), a is g mod n, and word i >= a becomes word a + (i - a) mod p of the text, where
    p = 1 + floor((n - a) / (3 + g mod 8)). Such a text's words are joined by one space; texts without words stay.
    """
    h = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)

    def tail(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p))
        moved = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, place(i).cast("int")))
        return F.when(n > 0, F.array_join(moved, " ")).otherwise(F.col(text))

    return docs.select(key, F.when(h % 10 == 0, let(words(F.col(text)), tail)).otherwise(F.col(text)).alias(text))
