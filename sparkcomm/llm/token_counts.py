"""Token counts from a broadcast table of frequent pre-token lengths, with worker caches for the rest."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcomm.llm.common import crc_mod

#: The broadcast table: pre-tokens at most, and the rows looked at to choose them (about; by a hash of the id).
TABLE_ENTRIES, SAMPLE_ROWS = 50_000, 20_000
CACHE_ENTRIES, CACHE_CHARS = 400_000, 64
LONG_TEXT = 1 << 20
PRE_TOKEN = re.compile(" *[^ ]*")

_MODELS: dict[str, object] = {}


def model(path: str):
    if path not in _MODELS:
        import sentencepiece

        _MODELS[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _MODELS[path]


def pre_tokens(text: str) -> list[str]:
    """Parts that are encoded alone: a run of spaces with what follows it, without the first space.

    The library puts a space before a text; the first part stands for that one. ``None`` is a lone space at the end.
    """
    if "▁" in text:  # the library's sign for a space counts as one
        text = text.replace("▁", " ")
    parts = text.split(" ")
    if "" not in parts:
        return parts
    parts = [m[1:] for m in re.findall(" +[^ ]*", f" {text}")]
    if parts[-1] == "":
        parts[-1] = None
    return parts


class Lengths(dict):
    """Token counts by pre-token: the broadcast table, then what this worker has encoded (emptied when full)."""

    def __init__(self, path: str, table: dict[str, int]) -> None:
        super().__init__(table)
        self.path, self.table = path, table
        self[None] = 1

    def __missing__(self, part: str) -> int:
        n = len(model(self.path).encode(part, num_threads=1))
        if len(part) <= CACHE_CHARS:
            if len(self) >= len(self.table) + CACHE_ENTRIES:
                self.clear()
                self.update(self.table)
                self[None] = 1
            self[part] = n
        return n


def pack(counts: Counter, path: str) -> tuple[bytes, bytes]:
    """The compact table: texts parted by a NUL, and two bytes of length each. Texts with a NUL are left to the caches."""
    top = [p for p, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:TABLE_ENTRIES] if "\0" not in p]
    lengths = [len(model(path).encode(p, num_threads=1)) for p in top]
    return "\0".join(top).encode(), np.array(lengths, "<u2").tobytes()


def unpack(table: tuple[bytes, bytes]) -> dict[str, int]:
    return dict(zip(table[0].decode().split("\0"), np.frombuffer(table[1], "<u2").tolist(), strict=False)) if table[1] else {}


def frequent(docs: DataFrame, model_path: str, *, key: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> tuple[bytes, bytes]:
    """Packed lengths of the commonest pre-tokens in a sample. The table only saves time; it never changes a count."""
    n = docs.count()
    share = int(min(1.0, sample_rows / max(n, 1)) * 2**31)
    rows = docs.where(crc_mod(F.col(key), 2**31) < share).select(text).repartition(8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    seen.update(p for p in pre_tokens(t) if p is not None and len(p) <= CACHE_CHARS)
        top = seen.most_common(TABLE_ENTRIES)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([c for _, c in top], pa.int64())], ["part", "n"])

    total: Counter = Counter()
    for part, count in rows.mapInArrow(run, "part string, n long").toLocalIterator():  # at most 8 x TABLE_ENTRIES rows
        total[part] += count
    return pack(total, model_path)


_TABLES: dict[tuple[str, int], Lengths] = {}


def count_tokens(docs: DataFrame, model_path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, text and n_tokens (long): tokens of every whole text, as the sentencepiece library gives them.

    For models that leave texts as they are but for one space put before, and whose pieces have the space sign at
    their start only (checked). Null and empty texts have no tokens. Nothing is shuffled by pre-token.
    """
    pieces = model(model_path)
    plain = "".join(pieces.encode(" a  b ", out_type=str)) == "▁▁a▁▁b▁" and "fi" not in "".join(pieces.encode("ﬁ", out_type=str))
    if not plain or any("▁" in pieces.id_to_piece(i).lstrip("▁") for i in range(pieces.vocab_size())):
        raise ValueError("Pieces of this model cross pre-tokens, or it rewrites texts.")
    shared = docs.sparkSession.sparkContext.broadcast(frequent(docs, model_path, key=key, text=text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = (model_path, hash(shared.value))
        if slot not in _TABLES:
            _TABLES.clear()
            _TABLES[slot] = Lengths(model_path, unpack(shared.value))
        length = _TABLES[slot].__getitem__
        for batch in batches:
            counts = [sum(map(length, pre_tokens(t))) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], [key, text, "n_tokens"])

    rows = docs.select(key, text)
    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, `{text}` string, n_tokens long")
