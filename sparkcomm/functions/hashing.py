"""Seeded pseudo-randomness from hashes: repeatable across runs, retries and engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 52


def hash_long(*parts: Column | str | int) -> Column:
    """Uniform integer in [0, 2**52) from the md5 of the ``|``-joined parts."""
    cols = [F.lit(str(p)) if isinstance(p, int) else (F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols).cast("binary")), 1, 13), 16, 10).cast("bigint")


def hash_unit(*parts: Column | str | int) -> Column:
    """Uniform double in [0, 1)."""
    return hash_long(*parts) / F.lit(float(1 << HASH_BITS))


def hash_bucket(value: Column, bits: int = 12) -> Column:
    """Leading bits of a hash: an order-preserving bucket of equal expected size."""
    return F.shiftright(value, HASH_BITS - bits).cast("int")
