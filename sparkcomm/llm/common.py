"""Small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
MASK = (1 << 64) - 1


def words(text: Column) -> Column:
    """Array of the words of a text, in order; null counts as empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def byte_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words; bytes.split() parts at exactly the six characters of SPACE."""
    return text.encode().lower().split() if text else []


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def per_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | list], schema: str) -> DataFrame:
    """Run fn over the Arrow batches of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield fn(batch)

    return df.mapInArrow(run, schema)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once however often the body or its lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def row_key(key: str, text: str) -> tuple[Column, Column]:
    """_k and _h: a row by its key as text and a hash of its text, for joins that must survive null and repeated keys."""
    return F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("_k"), F.xxhash64(text).alias("_h")


def pack_sorted(values: np.ndarray, bits: int) -> bytes:
    """Distinct numbers below 2^bits in order: the upper bits as gaps of a bit row, the lower ones side by side (Elias-Fano)."""
    n = len(values)
    low = bits - max(n.bit_length() - 1, 0)
    row = np.zeros(n + (1 << bits - low), np.uint8)
    row[(values >> low) + np.arange(n)] = 1
    tails = []
    for at in range(0, n, 1 << 16):  # whole bytes in each part
        part = values[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)[:, : -(-low // 8)]
        tails.append(np.packbits(np.unpackbits(part, axis=1, bitorder="little")[:, :low]).tobytes())
    return n.to_bytes(4, "little") + np.packbits(row).tobytes() + b"".join(tails)


def unpack_sorted(packed: bytes, bits: int) -> np.ndarray:
    n = int.from_bytes(packed[:4], "little")
    low = bits - max(n.bit_length() - 1, 0)
    size, raw = n + (1 << bits - low), np.frombuffer(packed, np.uint8, offset=4)
    out = (np.flatnonzero(np.unpackbits(raw[: -(-size // 8)], count=size)) - np.arange(n)) << low
    raw = raw[-(-size // 8) :]
    for at in range(0, n, 1 << 16):
        m = min(n - at, 1 << 16)
        tails = np.zeros((m, 64), np.uint8)
        tails[:, :low] = np.unpackbits(raw[at * low // 8 :][: -(-m * low // 8)], count=m * low).reshape(m, low)
        out[at : at + m] |= np.packbits(tails, axis=1, bitorder="little").view("<i8").reshape(m)
    return out
