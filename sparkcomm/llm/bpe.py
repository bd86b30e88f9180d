"""Byte-level BPE with a rank queue of buckets under a hierarchical bitmap."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Worker cache of pre-tokens: entries, and ids of them, beyond which it is emptied.
CACHE_ENTRIES, CACHE_IDS = 120_000, 2_000_000
#: Texts beyond this many characters are split into pre-tokens piece by piece.
LONG_TEXT = 1 << 20
#: Rows, and characters of their texts, that are encoded together.
ROWS, TOGETHER = 1_000, 1 << 20


class RankQueue:
    """Smallest rank first: a bucket of positions per rank; two levels of 256-bit words tell which ranks have one.

    Find-first-set on the upper word and then on a lower one gives the least rank.
    """

    __slots__ = ("buckets", "low", "top")

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.low: dict[int, int] = {}
        self.top = 0

    def open(self, rank: int, positions: list) -> None:
        """A bucket for a rank that has none. Entries are positions, or arrays of them."""
        self.buckets[rank] = positions
        a = rank >> 8
        self.low[a] = self.low.get(a, 0) | 1 << (rank & 255)
        self.top |= 1 << a

    def push(self, rank: int, position) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.open(rank, [position])
        else:
            bucket.append(position)

    def pop(self) -> tuple[int, list] | None:
        """The smallest rank and its bucket."""
        if not self.top:
            return None
        a = (self.top & -self.top).bit_length() - 1
        word = self.low[a]
        bit = word & -word
        if word == bit:
            del self.low[a]
            self.top ^= 1 << a
        else:
            self.low[a] = word ^ bit
        rank = (a << 8) + bit.bit_length() - 1
        return rank, self.buckets.pop(rank)


class Vocabulary:
    """Ranks by token, and those of the pairs of tokens that make another one."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.pair = np.full(65_536, -1, np.int64)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.pair[token[0] * 256 + token[1]] = rank
        made = sorted((ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks)
        self.key, self.made = np.array([k for k, _ in made], np.int64), np.array([r for _, r in made], np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of token ids; -1 if they make no token."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.made[at], -1)


#: Bytes of the longest pre-token that goes with the many.
SHORT = 256


def merge(pieces: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of many pre-tokens, one after the other, and how many each has, by a rank queue over all of them: buckets of whole arrays for
    short ones, of single positions for long ones."""
    short = [p for p in pieces if len(p) <= SHORT]
    if len(short) == len(pieces):
        return _merge_many(pieces, vocabulary)
    parts = [iter(np.split(ids, np.cumsum(sizes)[:-1])) for ids, sizes in (_merge_many(short, vocabulary), _merge_long([p for p in pieces if len(p) > SHORT], vocabulary))]
    ids = [next(parts[len(p) > SHORT]) for p in pieces]
    return np.concatenate(ids), np.fromiter(map(len, ids), np.int64, len(ids))


def _placed(pieces: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, ...]:
    """The pieces in one buffer, a free place after each: where these are, and of every place the end of its part (0: free), the part
    before (-1: none), its token (-1: free) and the rank of its pair with the next part (-1: none)."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    stops = np.cumsum(sizes + 1) - 1
    raw = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8).astype(np.int64)
    pair = np.append(vocabulary.pair[raw[:-1] * 256 + raw[1:]], -1)
    pair[stops] = pair[stops[sizes > 0] - 1] = -1
    end, before, token = np.arange(1, len(raw) + 1), np.arange(-1, len(raw) - 1), vocabulary.byte[raw]
    end[stops], before[stops - sizes], token[stops] = 0, -1, -1
    return stops, end, before, token, pair


def _grouped(ranks: np.ndarray, positions: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Positions by rank, in their order."""
    order = np.argsort(ranks, kind="stable")
    ranks, positions = ranks[order], positions[order]
    edge = np.flatnonzero(np.append(True, ranks[1:] != ranks[:-1])) if len(ranks) else ranks
    cut = [*edge.tolist(), len(ranks)]
    return ((r, positions[a:b]) for r, a, b in zip(ranks[edge].tolist(), cut, cut[1:], strict=False))


def _ids(token: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    left = token >= 0
    return token[left].astype(np.int32), np.diff(np.cumsum(left)[stops], prepend=0)


def _merge_many(pieces: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """A bucket at a time: of each piece its first position, as the pieces do not touch; further ones go back to the queue, where a
    smaller rank that the merge brings up comes before them. Entries whose pair has changed since are stale."""
    if not pieces:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    stops, end, before, token, pair = _placed(pieces, vocabulary)
    owner = np.searchsorted(stops, np.arange(len(end)))
    queue = RankQueue()
    at = np.flatnonzero(pair >= 0)
    for rank, positions in _grouped(pair[at], at):
        queue.push(rank, positions)
    while (entry := queue.pop()) is not None:
        rank, bucket = entry
        i = np.concatenate(bucket) if len(bucket) > 1 else bucket[0]
        i = np.sort(i[pair[i] == rank])
        if not len(i):
            continue
        first = np.append(True, owner[i[1:]] != owner[i[:-1]])
        if not first.all():
            queue.push(rank, i[~first])
            i = i[first]
        j = end[i]
        k = end[j]
        end[i], token[i] = k, rank
        token[j] = pair[j] = pair[i] = -1
        more = end[k] > 0
        before[k[more]] = i[more]
        h = before[i]
        h = h[h >= 0]
        left, right = np.append(h, i[more]), np.append(end[h], k[more])
        new = vocabulary.merged(token[left], token[right])
        pair[left] = new
        good = new >= 0
        for r, positions in _grouped(new[good], left[good]):
            queue.push(r, positions)
    return _ids(token, stops)


def _merge_long(pieces: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """A position at a time, from the left; where a merge brings up a smaller rank, the later positions of its piece go back to the queue."""
    buffer = b"\0".join(pieces) + b"\0"
    stops, *places = _placed(pieces, vocabulary)
    first = places[3]
    end, before, token, pair = (x.tolist() for x in places)
    queue = RankQueue()
    at = np.flatnonzero(first >= 0)
    for rank, positions in _grouped(first[at], at):
        queue.open(rank, positions.tolist())
    rank_of, buckets, opened, pop = vocabulary.ranks.get, queue.buckets, queue.open, queue.pop
    while (entry := pop()) is not None:
        rank, bucket = entry
        hold = 0
        for i in sorted(bucket):
            if pair[i] != rank:
                continue
            if i < hold:
                queue.push(rank, i)
                continue
            j = end[i]
            k = end[i] = end[j]
            token[i], token[j] = rank, -1
            pair[j] = -1
            after = end[k]
            if after:
                before[k] = i
                new = pair[i] = rank_of(buffer[i:after], -1)
                if new >= 0:
                    if (there := buckets.get(new)) is not None:
                        there.append(i)
                    else:
                        opened(new, [i])
                    if new < rank:
                        hold = int(stops[np.searchsorted(stops, i)])
            else:
                pair[i] = -1
            h = before[i]
            if h >= 0:
                new = pair[h] = rank_of(buffer[h:k], -1)
                if new >= 0:
                    if (there := buckets.get(new)) is not None:
                        there.append(h)
                    else:
                        opened(new, [h])
                    if new < rank:
                        hold = int(stops[np.searchsorted(stops, i)])
    return _ids(np.array(token), stops)


class Cache(dict):
    """Slots by pre-token; a slot has a stretch of ids in ``pool``. The misses of a whole list are merged together. Emptied when full."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__()
        self.vocabulary = Vocabulary(ranks)
        self.empty()

    def empty(self) -> None:
        self.clear()
        self.fresh: list[str] = []
        self.pool, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __missing__(self, piece: str) -> int:
        slot = self[piece] = len(self.size) + len(self.fresh)
        self.fresh.append(piece)
        return slot

    def ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, one after the other, and how many each piece has."""
        slot = np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))
        if self.fresh:
            self._merge_fresh()
        size = self.size[slot]
        first = np.cumsum(size) - size
        flat = self.pool[np.arange(int(size.sum())) + np.repeat(self.start[slot] - first, size)]
        if len(self) > CACHE_ENTRIES or len(self.pool) > CACHE_IDS:
            self.empty()
        return flat, size

    def _merge_fresh(self) -> None:
        raw = [p.encode() for p in self.fresh]
        whole = np.fromiter((-1 if r is None else r for r in map(self.vocabulary.ranks.get, raw)), np.int64, len(raw))
        parts = np.flatnonzero(whole < 0)
        ids, sizes = merge([raw[i] for i in parts.tolist()], self.vocabulary)
        size, start = np.ones(len(raw), np.int64), np.empty(len(raw), np.int64)
        base, tokens = len(self.pool), whole[whole >= 0]
        start[whole >= 0] = base + np.arange(len(tokens))
        size[parts], start[parts] = sizes, base + len(tokens) + np.cumsum(sizes) - sizes
        self.pool = np.concatenate((self.pool, tokens.astype(np.int32), ids))
        self.start, self.size = np.append(self.start, start), np.append(self.size, size)
        self.fresh = []


_ENCODERS: dict[tuple[str, str], tuple] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) }


def encoder(path: str, pattern: str) -> tuple:
    """Splitter and cache of this worker, made once per vocabulary."""
    key = (path, pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = regex.compile(pattern), Cache(read_ranks(path))
    return _ENCODERS[key]


def encode_texts(texts: list[str | None], splitter: regex.Pattern, cache: Cache) -> list[np.ndarray]:
    """Ids of every text. Texts in lots, and a long one piece by piece, go through the cache together."""
    out: list[np.ndarray] = []
    lot: list[list[str]] = []

    def flush() -> None:
        ids, sizes = cache.ids(list(chain.from_iterable(lot)))
        ends = np.append(0, np.cumsum(sizes))[np.cumsum(np.fromiter(map(len, lot), np.int64, len(lot)))]
        out.extend(np.split(ids, ends[:-1]) if lot else ())
        lot.clear()

    size = 0
    for text in texts:
        if text and len(text) >= LONG_TEXT:
            flush()
            pieces = (m[0] for m in splitter.finditer(text))
            out.append(np.concatenate([cache.ids(part)[0] for part in iter(lambda: list(islice(pieces, LONG_TEXT // 4 + 1)), [])]))
            continue
        lot.append(splitter.findall(text) if text else [])
        size += len(text or "")
        if size >= TOGETHER:
            flush()
            size = 0
    flush()
    return out


def encode_text(text: str | None, splitter: regex.Pattern, cache: Cache) -> np.ndarray:
    """Token ids of one text."""
    return encode_texts([text], splitter, cache)[0]


def ragged(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else [], kind))


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Token ids of every text: key, ids (array of int).

    ``ranks_path`` must be readable on every worker (a vocabulary file installed there). The pattern's groups
    must not capture. Null and empty texts have no ids. Pre-tokens may be of any length: merging costs a
    constant number of queue steps per byte.
    """

    return _append_ids(docs.select(key, text), text, ranks_path, pattern, [key])


def with_ids(docs: DataFrame, ranks_path: str, pattern: str, *, text: str = "text") -> DataFrame:
    """All columns of docs with ids, n_tokens and round_trip (the decoded ids are the text, a null one as empty); these replace columns of their names."""
    docs = docs.drop("ids", "n_tokens", "round_trip")
    rows = _append_ids(docs, text, ranks_path, pattern, docs.columns, check=True)
    return rows.select(*docs.columns, "ids", F.size("ids").cast("long").alias("n_tokens"), "round_trip")


def _append_ids(rows: DataFrame, text: str, ranks_path: str, pattern: str, keep: list[str], *, check: bool = False) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, cache = encoder(ranks_path, pattern)
        token = tokens(ranks_path).__getitem__ if check else None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = part.column(text).to_pylist()
                ids = encode_texts(texts, splitter, cache)
                columns, names = [*(part.column(c) for c in keep), ragged(ids, pa.int32())], [*keep, "ids"]
                if check:
                    back = [b"".join(map(token, i.tolist())) == (t or "").encode() for i, t in zip(ids, texts, strict=True)]
                    columns, names = [*columns, pa.array(back, pa.bool_())], [*names, "round_trip"]
                yield pa.RecordBatch.from_arrays(columns, names)
        cache.empty()  # workers live on

    more = [T.StructField("ids", T.ArrayType(T.IntegerType()))] + ([T.StructField("round_trip", T.BooleanType())] if check else [])
    return rows.mapInArrow(run, T.StructType([*rows.select(*keep).schema.fields, *more]))


_TOKENS: dict[str, dict[int, bytes]] = {}


def tokens(ranks_path: str) -> dict[int, bytes]:
    if ranks_path not in _TOKENS:
        _TOKENS[ranks_path] = {rank: token for token, rank in read_ranks(ranks_path).items()}
    return _TOKENS[ranks_path]


def decode(rows: DataFrame, ranks_path: str, *, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes that the ids stand for. Null ids give null; an id outside the vocabulary is an error."""

    @F.pandas_udf("binary")
    def bytes_of(column):
        token = tokens(ranks_path).__getitem__
        return column.map(lambda x: None if x is None else b"".join(map(token, x.tolist())))

    return rows.withColumn(out, bytes_of(F.col(ids)))
