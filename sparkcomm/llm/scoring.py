"""Language-model scores from a log-frequency Bloom filter of n-gram counts."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcomm.llm.common import byte_words, pack_sorted, unpack_sorted
from sparkcomm.session import materialize

#: Counts are kept as powers of BASE: level j stands in the filter if the count is BASE^(j-1) or more.
BASE = 1.5
#: Bits set per level, bits of a segment (all bits of an n-gram lie in one), and bits per level for that many probes.
PROBES, SEGMENT, BITS_PER_LEVEL = 4, 1 << 16, float(4 / np.log(2))
#: Bounds of the broadcast filter and of its part for word pairs. Whole levels from the top are in it; the levels of rarer
#: words are a table that the texts' words meet in a join, those of rarer pairs a packed table by blocks of the hash range.
MAX_FILTER_BYTES, MAX_PAIR_BYTES = 64 << 20, 4 << 20
#: Bound of the broadcast table of exact counts; rarer tokens meet their counts in a join.
MAX_FREQUENT = 1 << 18
#: Weight, in tokens, of the unigram estimate in a word pair's probability.
PRIOR = 200.0
#: N-grams gathered in a task before they are added up, and texts whose open pairs are looked up together.
FLUSH, TEXTS = 2_000_000, 50_000
#: Bits of a pair's hash that are kept, and training tokens for each block of the hash range in which pairs are counted.
PAIR_BITS, BLOCK_TOKENS = 48, 2_000_000
#: Words whose hashes a worker keeps.
HASHES = 200_000

_U = np.uint64
END = xxhash.xxh3_64_intdigest(b"\n")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * _U(0x9E3779B97F4A7C15) + second)


class Hashes(dict):
    """64-bit hashes by word; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > HASHES:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = Hashes()


def token_hashes(text: str | None) -> np.ndarray:
    """Hashes of the tokens of a text, the end included."""
    words = byte_words(text)
    out = np.empty(len(words) + 1, _U)
    out[:-1] = np.fromiter(map(_HASHES.__getitem__, words), _U, len(words))
    out[-1] = END
    return out


def short_pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The upper PAIR_BITS bits of ``pair_hash``; the others are 0."""
    return pair_hash(first, second) >> _U(64 - PAIR_BITS) << _U(64 - PAIR_BITS)


def _pairs(tokens: np.ndarray) -> np.ndarray:
    """Each token with the one before it; the end of a text also stands before its first word."""
    return short_pair_hash(np.concatenate(([_U(END)], tokens[:-1])), tokens)


def _lots(batches: Iterator[pa.RecordBatch], grams) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct n-gram hashes of some FLUSH tokens at a time, in order, with their counts."""
    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        for t in batch.column(0).to_pylist():
            held.append(grams(token_hashes(t)))
            size += len(held[-1])
            if size >= FLUSH:
                yield np.unique(np.concatenate(held), return_counts=True)
                held, size = [], 0
    if held:
        yield np.unique(np.concatenate(held), return_counts=True)


def gathered(docs: DataFrame, text: str, grams) -> DataFrame:
    """h, n: n-gram hashes with their counts, added up within the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, n in _lots(batches, grams):
            for at in range(0, len(h), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(h[at : at + 100_000].view(np.int64)), pa.array(n[at : at + 100_000])], ["h", "n"])

    return docs.select(text).mapInArrow(run, "h long, n long").repartition("h").groupBy("h").agg(F.sum("n").alias("n"))


def dealt(h: np.ndarray, blocks: int) -> Iterator[tuple[int, slice, bytes]]:
    """Blocks of the hash range (a power of two) that pairs in order fall into, where they stand, and their hashes packed."""
    bits = PAIR_BITS + 1 - blocks.bit_length()
    h = (h >> _U(64 - PAIR_BITS)).astype(np.int64)
    cuts = np.searchsorted(h, np.arange(blocks + 1) << bits)
    for block in np.flatnonzero(np.diff(cuts)).tolist():
        own = slice(cuts[block], cuts[block + 1])
        yield block, own, pack_sorted(h[own] & (1 << bits) - 1, bits)


def undealt(packed: bytes, blocks: int, block: int = 0) -> np.ndarray:
    bits = PAIR_BITS + 1 - blocks.bit_length()
    return (unpack_sorted(packed, bits) | block << bits).view(_U) << _U(64 - PAIR_BITS)


def pack_counts(n: np.ndarray) -> bytes:
    """Counts as bytes, those of 255 or more at the end."""
    return zlib.compress(np.minimum(n, 255).astype(np.uint8).tobytes() + n[n >= 255].astype("<i8").tobytes(), 1)


def unpack_counts(packed: bytes, size: int) -> np.ndarray:
    raw = zlib.decompress(packed)
    out = np.frombuffer(raw, np.uint8, size).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, "<i8", offset=size)
    return out


def _levels(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8)


def counted_pairs(docs: DataFrame, text: str, blocks: int) -> DataFrame:
    """block, h, level, sizes: the word pairs of every block of the hash range, packed, their levels, and how many have each level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, n in _lots(batches, _pairs):
            rows = [(block, packed, pack_counts(n[own])) for block, own, packed in dealt(h, blocks)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["block", "h", "n"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [undealt(x, blocks) for x in pdf["h"]]
        n = np.concatenate([unpack_counts(x, len(h)) for x, h in zip(pdf["n"], parts, strict=True)])
        h = np.concatenate(parts)
        order = np.argsort(h)
        h, n = h[order], n[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        level = (np.floor(np.log(np.add.reduceat(n, first)) / np.log(BASE) + 1e-9) + 1).astype(np.uint8)
        packed = pack_sorted((h[first] >> _U(64 - PAIR_BITS)).astype(np.int64), PAIR_BITS + 1 - blocks.bit_length())
        return pd.DataFrame([(pdf["block"].iloc[0], packed, zlib.compress(level.tobytes(), 1), np.bincount(level))], columns=["block", "h", "level", "sizes"])

    found = docs.select(text).mapInArrow(run, "block long, h binary, n binary")
    return found.groupBy("block").applyInPandas(add, "block long, h binary, level binary, sizes array<long>")


def pairs_from(pairs: DataFrame, least: int, blocks: int) -> DataFrame:
    """h, level: the pairs of at least a level, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                level = _levels(row["level"])
                h = undealt(row["h"], blocks, row["block"])[level >= least]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(level[level >= least].astype(np.int32))], ["h", "level"])

    return pairs.select("block", "h", "level").mapInArrow(run, "h long, level int")


def level_of(n: Column) -> Column:
    return (F.floor(F.log(n.cast("double")) / F.lit(float(np.log(BASE))) + F.lit(1e-9)) + 1).cast("int")


def estimate(level: np.ndarray) -> np.ndarray:
    """Middle of the counts of a level; 0 stays 0."""
    low = np.ceil(BASE ** (level - 1.0) - 1e-6)
    high = np.maximum(np.ceil(BASE ** level.astype(float) - 1e-6) - 1, low)
    return np.where(level > 0, (low + high) / 2, 0.0)


def _bits(h: np.ndarray, level: int) -> tuple[np.ndarray, ...]:
    """Offsets in the segment, 16 bits each."""
    x = mix(h + _U((level * 0xD1B54A32D192ED03) & (2**64 - 1)))
    return tuple((x >> _U(16 * i)) & _U(SEGMENT - 1) for i in range(PROBES))


def segment_of(h: np.ndarray, segments: int) -> np.ndarray:
    return ((h >> _U(32)) * _U(segments)) >> _U(32)


@dataclass
class Filter:
    segments: int
    bits: np.ndarray

    def levels(self, h: np.ndarray) -> np.ndarray:
        """Probe level after level; a level counts while all its bits are set."""
        out = np.zeros(len(h), np.int16)
        at = np.arange(len(h))
        base = segment_of(h, self.segments) * _U(SEGMENT)
        level = 0
        while len(at):
            level += 1
            found = np.ones(len(at), bool)
            for offset in _bits(h, level):
                p = base + offset
                found &= ((self.bits[(p >> _U(3)).astype(np.int64)] >> (p & _U(7)).astype(np.uint8)) & np.uint8(1)).astype(bool)
            at, h, base = at[found], h[found], base[found]
            out[at] = level
        return out


@dataclass
class Model:
    tokens: int
    distinct: int
    counts: DataFrame
    frequent: tuple[np.ndarray, np.ndarray]
    filter: Filter
    #: Least levels of words and pairs in the filter, and tables of those below them; None if there are none.
    low: tuple[int, int] = (1, 1)
    rare_words: DataFrame | None = None
    rare_pairs: DataFrame | None = None
    #: Blocks of the hash range in the table of pairs (see ``counted_pairs``).
    blocks: int = 1


def build_filter(grams: DataFrame, segments: int) -> Filter:
    """Every segment is filled by one task from the n-grams (h, level) that hash to it; the driver puts them side by side."""

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        h = pdf["h"].to_numpy().view(_U)
        level = pdf["level"].to_numpy()
        seg = segment_of(h, segments)
        first = int(seg.min())
        bits = np.zeros((int(seg.max()) - first + 1) * SEGMENT, np.uint8)
        base = (seg - _U(first)) * _U(SEGMENT)
        for j in range(1, int(level.max()) + 1):
            at = level >= j
            for offset in _bits(h[at], j):
                bits[(base[at] + offset).astype(np.int64)] = 1
        return pd.DataFrame({"first": [first], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    # a group: 16 neighbouring segments, 128 KB of bits and about 200,000 levels
    group = F.shiftright(F.shiftrightunsigned("h", 32) * segments, 36)
    bits = np.zeros(segments * SEGMENT // 8, np.uint8)
    for r in grams.select("h", "level", group.alias("g")).groupBy("g").applyInPandas(fill, "first long, bits binary").toLocalIterator():
        part = np.frombuffer(r["bits"], np.uint8)
        at = r["first"] * SEGMENT // 8
        bits[at : at + len(part)] = part
    return Filter(segments, bits)


def train(docs: DataFrame, *, text: str = "text", max_filter_bytes: int = MAX_FILTER_BYTES) -> Model:
    """Count tokens and word pairs of all rows; null texts count as empty. Counts are kept by hashes of 64 bits, of pairs 48."""
    words = materialize(gathered(docs, text, lambda t: t))
    total = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    blocks = 1 << min(max((total["n"] or 0) // BLOCK_TOKENS, 0).bit_length(), 24)
    pairs = materialize(counted_pairs(docs, text, blocks))
    sizes = sorted((r["level"], r["n"]) for r in words.groupBy(level_of(F.col("n")).alias("level")).agg(F.count("*").alias("n")).collect())
    pair_sizes = pairs.select(F.posexplode("sizes").alias("level", "n")).where("n > 0").groupBy("level").agg(F.sum("n").alias("n"))
    pair_sizes = sorted((r["level"], r["n"]) for r in pair_sizes.collect())

    least, kept = 0, 0
    for level, n in reversed(sizes):  # commonest first, whole levels
        if kept + n > MAX_FREQUENT:
            break
        least, kept = level, kept + n
    rows = words.where(level_of(F.col("n")) >= least).toArrow() if least else None
    h = rows["h"].to_numpy().view(_U) if least else np.zeros(0, _U)
    n = rows["n"].to_numpy() if least else np.zeros(0, np.int64)
    order = np.argsort(h)

    low, used = [], 0
    for found, bound in ((sizes, max_filter_bytes), (pair_sizes, MAX_PAIR_BYTES)):  # whole levels from the top, words before pairs
        room = min(bound * 8 / BITS_PER_LEVEL, max_filter_bytes * 8 / BITS_PER_LEVEL - used)
        least = 1000
        for level, count in reversed(found):
            if level * count > room:
                break
            least, used, room = level, used + level * count, room - level * count
        low.append(1 if not found or least == found[0][0] else least)
    leveled = words.select("h", level_of(F.col("n")).alias("level"))
    grams = leveled.where(F.col("level") >= low[0]).unionAll(pairs_from(pairs, low[1], blocks))
    rare_words, rare_pairs = None if low[0] == 1 else leveled.where(F.col("level") < low[0]), None if low[1] == 1 else pairs
    bits = build_filter(grams, int(used * BITS_PER_LEVEL / SEGMENT) + 1)
    return Model(total["n"] or 0, total["v"], words, (h[order], n[order]), bits, (low[0], low[1]), rare_words, rare_pairs, blocks)


def _with_rare_words(rows: DataFrame, model: Model) -> DataFrame:
    """rows (_row, key, text) with rare_h, rare_level: the words of each text that the filter has no room for."""
    shared = rows.sparkSession.sparkContext.broadcast((model.filter.segments, model.filter.bits))
    low = model.low[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = Filter(*shared.value).levels
        for batch in batches:
            for row, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = np.unique(token_hashes(t))
                own = own[probe(own) < low]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), row)), pa.array(own.view(np.int64))], ["_row", "h"])

    rows = rows.repartition("_row")  # this exchange serves both sides of the join below: all columns are read
    found = rows.mapInArrow(run, "_row long, h long").join(model.rare_words, "h")
    found = found.groupBy("_row").agg(F.collect_list(F.struct("h", "level")).alias("rare"))
    return rows.join(found, "_row", "left").select(*rows.columns, F.col("rare.h").alias("rare_h"), F.col("rare.level").alias("rare_level"))


def _with_open_pairs(shipped: DataFrame, model: Model, room: float, schema: str) -> DataFrame:
    """The rows of every lot of texts, with what their open pairs add to the scores.

    ``shipped`` has two kinds of rows: g = -1 - block asks for the levels of a lot's distinct pairs in a block, g = lot holds
    the lot's rows and, for each of these pairs, the texts it stands in.
    """
    blocks = model.blocks
    table = model.rare_pairs.select((-1 - F.col("block")).alias("g"), "h", "level")

    def answer(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(asked) and asked["g"].iloc[0] < 0:
            own = undealt(known["h"].iloc[0], blocks) if len(known) else np.zeros(0, _U)
            level = np.append(_levels(known["level"].iloc[0]) if len(known) else np.zeros(0, np.uint8), np.uint8(0))
            for lot, data in zip(asked["lot"], asked["data"], strict=True):
                h = undealt(data[0], blocks)
                at = np.searchsorted(own, h)
                at[at < len(own)] = np.where(own[at[at < len(own)]] == h[at < len(own)], at[at < len(own)], len(own))
                rows.append((lot, -1 - asked["g"].iloc[0], zlib.compress(level[at].tobytes(), 1)))
        return pd.DataFrame(rows, columns=["g", "block", "level"])

    known = estimate(np.arange(128))
    rest = PRIOR * ((known[:, None] + 0.1) / room)
    gains = np.log10(known[None, :] + rest) - np.log10(rest)  # by the level of the second word and that of the pair

    def finish(lot: pa.Table, found: pa.Table) -> pa.Table:
        if not lot.num_rows or lot.column("g")[0].as_py() < 0:
            return empty
        row = lot.to_pylist()[0]
        docs = pa.ipc.open_stream(row["docs"]).read_all()
        level = [_levels(r["level"]) for r in sorted(found.to_pylist(), key=lambda r: r["block"])]
        level = np.concatenate(level) if level else np.zeros(0, np.uint8)
        texts, times, doc, word, most = row["data"]
        pair = np.minimum(np.repeat(level, unpack_counts(texts, len(level))), _levels(most))
        gain = unpack_counts(times, len(pair)) * gains[_levels(word), pair]
        gain = np.bincount(np.frombuffer(zlib.decompress(doc), "<u2"), gain, minlength=docs.num_rows)
        at = docs.schema.get_field_index("score")
        return docs.set_column(at, "score", pa.array(docs.column(at).to_numpy() + gain))

    empty = shipped.sparkSession.createDataFrame([], schema).toArrow()
    asked = shipped.groupBy("g")
    answers = asked.cogroup(table.groupBy("g")).applyInPandas(answer, "g long, block long, level binary")
    return asked.cogroup(answers.groupBy("g")).applyInArrow(finish, schema)


def _lot(docs: list[pa.RecordBatch], doc: np.ndarray, pairs: np.ndarray, times: np.ndarray, word: np.ndarray, most: np.ndarray, blocks: int) -> pa.RecordBatch:
    """Rows of ``shipped`` for a lot of texts: doc, pairs, times, word, most are its open pairs, once for a text."""
    lot = docs[0].column(0)[0].as_py()
    order = np.argsort(pairs, kind="stable")
    pairs, doc, times, word, most = (x[order] for x in (pairs, doc, times, word, most))
    first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, docs[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        for batch in docs:
            out.write_batch(batch)
    state = [pack_counts(np.diff(np.append(first, len(pairs)))), pack_counts(times), *[zlib.compress(x.tobytes(), 1) for x in (doc, word, most)]]
    rows = [(lot, lot, sink.getvalue().to_pybytes(), state), *[(-1 - block, lot, None, [packed]) for block, _, packed in dealt(pairs[first], blocks)]]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], ["g", "lot", "docs", "data"])


def score(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, n_tokens, n_known, base_score (unigram, exact counts), score (the filter's model); logarithms to base 10.

    A null or empty text is its end alone. Repeated rows are scored one by one. In ``score`` the probability of a
    token after another is (pair count + PRIOR x unigram estimate) / (count of the one before + PRIOR), with all
    counts as their levels tell, read from the filter or, for n-grams it has no room for, from the tables of rare ones; a
    pair count is at most the count of either token. Pairs that the filter does not tell are asked for packed, once for
    some FLUSH tokens of texts, and only their levels come back.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.frequent, model.filter.segments, model.filter.bits))
    (low_word, low_pair), some_rare = model.low, model.rare_words is not None
    room = model.tokens + 0.1 * (model.distinct + 1)
    blocks = model.blocks

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, tuple[np.ndarray, ...], int]]:
        """Rows of 250 texts at a time, their open pairs (text, pair, times, levels) and how many tokens they have."""
        (known, count), segments, bits = shared.value
        probe = Filter(segments, bits).levels
        for whole in batches:
            for start in range(0, whole.num_rows, 250):
                batch = whole.slice(start, 250)
                parts = [token_hashes(t) for t in batch.column(2).to_pylist()]
                sizes = np.array([len(p) for p in parts])
                tokens = np.concatenate(parts)
                own, where = np.unique(tokens, return_inverse=True)
                level = probe(own)
                level[level < low_word] = 0  # no n-gram of the filter reads as less than its level
                if some_rare:
                    at = np.searchsorted(own, batch.column(3).flatten().to_numpy().view(_U))
                    level[at] = batch.column(4).flatten().to_numpy()
                rough = estimate(level)
                prob = (rough + 0.1) / room
                before = np.concatenate(([0], where[:-1]))
                starts = np.cumsum(sizes) - sizes
                before[starts] = np.searchsorted(own, _U(END))
                pairs = short_pair_hash(own[before], tokens)
                pair_level = probe(pairs)
                pair_level[pair_level < low_pair] = 0
                most = np.minimum(level[before], level[where])
                pair = estimate(np.minimum(pair_level, most))
                logs = np.log10((pair + PRIOR * prob[where]) / (rough[before] + PRIOR))
                at = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
                common = known[at] == own if len(known) else np.zeros(len(own), bool)
                exact = np.where(common, np.log10((count[at] + 0.1) / room), 0.0) if len(known) else np.zeros(len(own))
                rare = ~common[where]
                ends = np.cumsum([rare[s : s + n].sum() for s, n in zip(starts, sizes, strict=True)])
                offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32))
                doc = np.repeat(np.arange(len(parts)), sizes)
                held = np.flatnonzero((pair_level == 0) & (most > 0)) if low_pair > 1 else np.zeros(0, int)
                held = held[np.lexsort((pairs[held], doc[held]))]
                new = np.flatnonzero(np.append(True, (pairs[held][1:] != pairs[held][:-1]) | (doc[held][1:] != doc[held][:-1]))[: len(held)])
                times = np.diff(np.append(new, len(held)))
                held = held[new]
                found = pa.RecordBatch.from_arrays(
                    [
                        *batch.columns[:2],
                        pa.array(sizes.astype(np.int64)),
                        pa.array(sizes - np.diff(np.concatenate(([0], ends)))),
                        pa.array(np.add.reduceat(exact[where], starts)),
                        pa.array(np.add.reduceat(logs, starts)),
                        pa.ListArray.from_arrays(offsets, pa.array(tokens[rare].view(np.int64))),
                    ],
                    ["_row", key, "n_tokens", "n_common", "common_score", "score", "rare"],
                )
                yield found, (doc[held], pairs[held], times, level[where[held]], most[held]), len(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, _, _ in scores(batches):
            yield found

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, held, texts, size = [], [], 0, 0
        for found, (doc, pairs, times, word, most), n in scores(batches):
            docs.append(found)
            held.append(((doc + texts).astype("<u2"), pairs, times.astype(np.int32), word.astype(np.uint8), most.astype(np.uint8)))
            texts, size = texts + found.num_rows, size + n
            if size >= FLUSH or texts >= TEXTS:
                yield _lot(docs, *map(np.concatenate, zip(*held, strict=True)), blocks)
                docs, held, texts, size = [], [], 0, 0
        if docs:
            yield _lot(docs, *map(np.concatenate, zip(*held, strict=True)), blocks)

    rows = docs.select(F.monotonically_increasing_id().alias("_row"), key, text)
    kind = rows.schema[1].dataType.simpleString()
    if some_rare:
        rows = _with_rare_words(rows, model)
    schema = f"_row long, `{key}` {kind}, n_tokens long, n_common long, common_score double, score double, rare array<long>"
    if model.rare_pairs is None:
        scored = rows.mapInArrow(run, schema)
    else:
        scored = _with_open_pairs(rows.mapInArrow(ship, "g long, lot long, docs binary, data array<binary>"), model, room, schema)
    scored = materialize(scored)
    rare = scored.select("_row", F.explode("rare").alias("h")).join(model.counts, "h", "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    rare = rare.groupBy("_row").agg(F.sum(F.log10((n + 0.1) / F.lit(room))).alias("rare_score"), F.sum((n > 0).cast("long")).alias("n_rare"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = scored.drop("rare").join(rare, "_row", "left")
    return out.select(key, "n_tokens", (F.col("n_common") + zero("n_rare")).alias("n_known"), (F.col("common_score") + zero("rare_score")).alias("base_score"), "score")
