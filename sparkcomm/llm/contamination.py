"""Benchmark decontamination: texts streamed through a generalised suffix automaton of the test items."""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkcomm.session import materialize

#: Words of a window. An item of fewer words is one window.
WINDOW = 10
#: Words of the items in one automaton (about: items are dealt by a hash, long ones in overlapping pieces), which is what a worker holds.
BLOCK_WORDS, PIECE_WORDS = 200_000, 20_000
#: Automata that follow each other in one stage.
CHAIN = 4
#: Characters outside words; case is folded for A-Z only.
_APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_TABLE = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # with A-Z, as in a text whose case is kept

_SPANS = "array<struct<start:bigint,end:bigint>>"


def normal_words(text: str | None) -> list[bytes]:
    return text.encode().translate(_TABLE).split() if text else []


class Automaton:
    """Suffix automaton of several word sequences, and the windows that end in its states.

    ``step`` has the transitions by state * number of words + word, ``link`` the suffix links, ``length`` the longest string of a
    state. ``window`` names for each state the state on its suffix path that holds its last WINDOW words (-1: it is shorter);
    ``short`` the nearest one in which a short item ends (-1: none).
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.number = {w: i for i, w in enumerate(sorted({w for _, words in items for w in words}))}
        self.width, self.size = len(self.number), window
        coded = [(item, [self.number[w] for w in words]) for item, words in items]
        out: list[dict[int, int]] = [{}]
        link, length = [-1], [0]

        def grow(last: int, c: int) -> int:
            q = out[last].get(c)
            if q is not None:  # read before, in another item
                return q if length[q] == length[last] + 1 else split(last, c, q)
            new = len(out)
            out.append({})
            length.append(length[last] + 1)
            link.append(0)
            while last >= 0 and c not in out[last]:
                out[last][c] = new
                last = link[last]
            if last >= 0:
                q = out[last][c]
                link[new] = q if length[q] == length[last] + 1 else split(last, c, q)
            return new

        def split(last: int, c: int, q: int) -> int:
            clone = len(out)
            out.append(dict(out[q]))
            length.append(length[last] + 1)
            link.append(link[q])
            link[q] = clone
            while last >= 0 and out[last].get(c) == q:
                out[last][c] = clone
                last = link[last]
            return clone

        for _, words in coded:
            state = 0
            for c in words:
                state = grow(state, c)
        n = len(out)
        self.step = {s * self.width + c: t for s, steps in enumerate(out) for c, t in steps.items()}
        self.link, self.window, self.short = link, [-1] * n, [-1] * n
        found: dict[int, set[str]] = {}
        ends: dict[int, set[tuple[int, str]]] = {}
        order = sorted(range(1, n), key=length.__getitem__)
        for s in order:
            if length[s] >= window:
                self.window[s] = s if length[link[s]] < window else self.window[link[s]]
        for item, words in coded:
            state = 0
            for c in words:
                state = self.step[state * self.width + c]
                if self.window[state] >= 0:
                    found.setdefault(self.window[state], set()).add(item)
            if 0 < len(words) < window:
                ends.setdefault(state, set()).add((len(words), item))
        for s in order:
            self.short[s] = s if s in ends else self.short[link[s]]
        self.length = length
        self.items = {s: sorted(v) for s, v in found.items()}
        self.ends = {s: sorted(v) for s, v in ends.items()}

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Stretches of the words (start, end; disjoint, ascending) that windows cover, and the items of these windows."""
        step, link, lengths, window, short, width, size = self.step.get, self.link, self.length, self.window, self.short, self.width, self.size
        spans: list[tuple[int, int]] = []
        seen: set[str] = set()
        asked: set[int] = set()
        state = length = 0

        def hit(start: int, end: int) -> None:
            while spans and spans[-1][1] >= start:
                start = min(start, spans.pop()[0])
            spans.append((start, end))

        for i, c in enumerate(map(self.number.get, words), 1):
            if c is None:
                state = length = 0
                continue
            to = step(state * width + c)
            if to is None:
                while to is None and state:
                    state = link[state]
                    to = step(state * width + c)
                if to is None:
                    length = 0
                    continue
                length = lengths[state]
            state = to
            length += 1
            if length >= size:
                hit(i - size, i)
                if (w := window[state]) not in asked:
                    asked.add(w)
                    seen.update(self.items[w])
            s = short[state]
            while s >= 0:
                for n, item in self.ends[s]:
                    if n <= length:
                        hit(i - n, i)
                        seen.add(item)
                s = short[link[s]]
        return spans, seen


def _lower(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def automata(items: DataFrame, *, item: str = "item_id", text: str = "text", window: int = WINDOW) -> Iterator[bytes]:
    """Pickled automata over the items, each of at most 2 x BLOCK_WORDS words; at least one.

    Items are taken as distinct (id as text, words) and long ones as pieces that overlap by a window less one word, so that no window is
    lost. A null id counts as ``null``.
    """
    words = F.filter(F.split(_lower(F.col(text)), _APART), lambda w: w != "")
    rows = items.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"), words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)), F.lit(PIECE_WORDS))
    pieces = rows.select("item", "w", F.explode(starts).alias("at")).select("item", F.slice("w", F.col("at") + 1, F.lit(PIECE_WORDS + window - 1)).alias("w"))
    pieces = materialize(pieces.distinct())
    blocks = -(-int(pieces.agg(F.sum(F.size("w"))).first()[0] or 0) // BLOCK_WORDS)
    while blocks > 1:
        dealt = pieces.groupBy(F.pmod(F.xxhash64("item", "w"), F.lit(blocks)).alias("block")).agg(F.sum(F.size("w")).alias("n"))
        if dealt.agg(F.max("n")).first()[0] <= 2 * BLOCK_WORDS:
            break
        blocks *= 2

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        made = Automaton([(i, [x.encode() for x in w]) for i, w in zip(pdf["item"], pdf["w"], strict=True)], window)
        return pd.DataFrame({"automaton": [pickle.dumps(made)]})

    if not blocks:
        yield pickle.dumps(Automaton([], window))
        return
    made = pieces.withColumn("block", F.pmod(F.xxhash64("item", "w"), F.lit(blocks))).groupBy("block").applyInPandas(build, "automaton binary")
    for row in materialize(made).toLocalIterator():
        yield bytes(row[0])


def _pass(rows: DataFrame, automaton: Broadcast, keep: list[str]) -> DataFrame:
    """Stream the texts through one automaton; what it finds joins the columns spans and items of rows, if there are such."""
    first = "spans" not in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = pickle.loads(automaton.value).hits
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                sizes, spans, items = [], [], []
                for t in batch.column("_t").to_pylist():
                    words = normal_words(t)
                    found, seen = hits(words)
                    sizes.append(len(words))
                    spans.append([{"start": a, "end": b} for a, b in found])
                    items.append(sorted(seen))
                if not first:
                    old = zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True)
                    both = [(_union(a + b), sorted({*c, *d})) for (a, c), b, d in zip(old, spans, items, strict=True)]
                    spans, items = [a for a, _ in both], [b for _, b in both]
                span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(items, pa.list_(pa.string()))], [*keep, "n_words", "spans", "items"])

    schema = T.StructType([*(rows.schema[c] for c in keep), *T.StructType.fromDDL(f"n_words long, spans {_SPANS}, items array<string>")])
    return rows.mapInArrow(run, schema)


def _union(spans: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: s["start"]):
        if out and out[-1]["end"] >= s["start"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append(dict(s))
    return out


def scan(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, carry: bool = False) -> DataFrame:
    """Key (with ``carry``: row, the whole row), n_words, spans (start, end of the words hit; ascending, apart) and items (ids as text, sorted).

    A word is hit if ``window`` words in a row around it, or an item of fewer words, stand in an item. Letter case A-Z and ASCII
    signs do not count; null and empty texts have no words. One pass over each text for every automaton of
    ``automata``; nothing is shuffled, and a worker holds at most CHAIN automata at a time.
    """
    name = "row" if carry else key
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("_t")) if carry else docs.select(key, F.col(text).alias("_t"))
    for i, automaton in enumerate(automata(items, item=item, text=item_text, window=window)):
        if i and i % CHAIN == 0:
            rows = materialize(rows)
        rows = _pass(rows, docs.sparkSession.sparkContext.broadcast(automaton), [name, "_t"])
    return rows.select(name, "n_words", "spans", "items")


def decontaminate(docs: DataFrame, items: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, max_span: int = 0, max_coverage: float = 0.5) -> DataFrame:
    """docs without what it shares with the items: rows hit on more than ``max_coverage`` of their words go, of the others every hit
    stretch of more than ``max_span`` words is cut out of the text (from its first word to the next word left)."""

    @F.pandas_udf("string")
    def without(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else cut(t, [(s["start"], s["end"]) for s in where]) for t, where in zip(texts, spans, strict=True)])

    found = scan(docs, items, text=text, item=item, item_text=item_text, window=window, carry=True)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    long = F.filter("spans", lambda s: s["end"] - s["start"] > max_span)
    left = F.when(F.size(long) > 0, without(F.col(f"row.`{text}`"), long)).otherwise(F.col(f"row.`{text}`"))
    kept = found.where(n_hit <= max_coverage * F.col("n_words"))
    return kept.select(*[left.alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns])


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them and the next word."""
    starts = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    edges = [0, *(starts[i] for span in spans for i in span), len(text)]
    return "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
