"""Order statistics, running totals and top-n that never hold one key in one task.

A key may own a third of all rows, so nothing here sorts a whole key in a single window.
Values go to order-preserving buckets; a partial aggregate counts the buckets of each key
(map side, small shuffle), prefix sums run over the few buckets, and only rows inside one
bucket are ordered against each other. All results are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

_OFFSET = 20000


def value_bucket(value: Column, per_log_unit: int = 16) -> Column:
    """Order-preserving bucket of a double: steps of constant ratio, zero in the middle."""
    size = (F.floor(F.log(F.abs(value)) * per_log_unit) + _OFFSET).cast("int")
    return F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0))


def unit_bucket(value: Column, buckets: int = 1024) -> Column:
    """Order-preserving bucket of a score that mostly lies in [0, 1]."""
    return F.floor(F.least(F.greatest(value, F.lit(-1.0)), F.lit(2.0)) * buckets).cast("int")


def tie_floor(observed: Column) -> Column:
    """Values from here on count as reaching ``observed``: a relative tolerance, as scores have no fixed scale."""
    return observed - 1e-9 * F.abs(observed)


def reaches(value: Column, observed: Column) -> Column:
    """value is at least observed; sums of the same terms in another order count as equal."""
    return value >= tie_floor(observed)


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    bucket: Column,
    sums: dict[str, Column],
    *,
    descending: bool = False,
) -> DataFrame:
    """Add, for each name in ``sums``, its total over the rows that come earlier in the order.

    ``bucket`` must agree with the first order key. The row itself is not included.
    ``order`` must be a strict order inside a key for repeatable results.
    """
    if not keys:
        out = running_totals(df.withColumn("_all", F.lit(0)), ["_all"], order, bucket, sums, descending=descending)
        return out.drop("_all")
    work = df.withColumn("_bucket", bucket)
    for name, expr in sums.items():
        work = work.withColumn(f"_w_{name}", expr)
    by_bucket = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
    before = Window.partitionBy(*keys).orderBy(by_bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = work.groupBy(*keys, "_bucket").agg(*[F.sum(f"_w_{n}").alias(f"_t_{n}") for n in sums])
    offsets = totals.select(
        *keys,
        "_bucket",
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = work
    for name in sums:
        local = local.withColumn(f"_l_{name}", F.coalesce(F.sum(f"_w_{name}").over(inside), F.lit(0)))
    out = _join_null_safe(local, offsets, [*keys, "_bucket"])
    for name in sums:
        out = out.withColumn(name, F.col(f"_l_{name}") + F.col(f"_o_{name}"))
    drop = ["_bucket"] + [f"_{p}_{n}" for n in sums for p in "wlo"]
    return out.drop(*drop)


def _join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    renamed = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        part = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        cond = part if cond is None else cond & part
    return left.join(renamed, cond).drop(*[f"_k_{k}" for k in keys])


def select_ranks(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    wanted: DataFrame,
    *,
    weight: Column | None = None,
) -> DataFrame:
    """Rows at given 0-based ranks inside each key.

    ``keys`` must not be empty. ``wanted`` carries the keys, a ``rank`` column and any payload; the result is ``wanted``
    with the order columns of the row found at that rank. Two passes over ``rows``: bucket
    counts, then only the buckets that hold a wanted rank.
    """
    work = rows.select(*keys, *order, (weight if weight is not None else F.lit(1).cast("bigint")).alias("_n")).withColumn("_bucket", bucket)
    hist = work.groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumn("_end", F.sum("_n").over(upto)).withColumn("_start", F.col("_end") - F.col("_n")).drop("_n")
    hits = wanted.join(hist, list(keys))
    hits = hits.where((F.col("_start") <= F.col("rank")) & (F.col("rank") < F.col("_end")))
    hits = hits.withColumn("_local", F.col("rank") - F.col("_start")).drop("_start", "_end")
    inside = [*keys, "_bucket"]
    needed = hits.select(*inside).distinct()
    cand = work.join(needed, inside, "left_semi").groupBy(*inside, *order).agg(F.sum("_n").alias("_n"))
    w = Window.partitionBy(*inside).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    cand = cand.withColumn("_e", F.sum("_n").over(w)).withColumn("_s", F.col("_e") - F.col("_n"))
    found = hits.join(cand, inside).where((F.col("_s") <= F.col("_local")) & (F.col("_local") < F.col("_e")))
    return found.select(*wanted.columns, *[c for c in order if c not in wanted.columns])


def values_at(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    positions: Callable[[Column], Sequence[Column]],
    *,
    weight: str | None = None,
    totals: DataFrame | None = None,
    bucket: Column | None = None,
    counts: bool = False,
) -> DataFrame:
    """Exact values at (fractional, linearly interpolated) 0-based positions, as ``q0, q1, ...``.

    ``positions`` maps the row count of a key to the wanted places. ``totals`` (some of the keys,
    and ``n``) states row counts that include zeros missing from ``rows``. ``counts`` adds the
    columns ``n`` and ``n_positive`` (default bucket only). Pass one counts buckets with a
    map-side aggregate; pass two reads only the buckets that hold a wanted place.
    """
    if not keys:
        tot = totals.withColumn("_all", F.lit(0)) if totals is not None else None
        flat = rows.withColumn("_all", F.lit(0))
        return values_at(flat, ["_all"], value, positions, weight=weight, totals=tot, bucket=bucket, counts=counts).drop("_all")
    keys = list(keys)
    size = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    work = rows.select(*keys, F.col(value).alias("_v"), size.alias("_n"), (bucket if bucket is not None else value_bucket(F.col(value))).alias("_b"))
    work = work.where("_n > 0")
    hist = work.groupBy(*keys, "_b").agg(F.sum("_n").alias("_n"))
    if totals is not None:
        stated = [k for k in keys if k in totals.columns]
        seen = hist.groupBy(*keys).agg(F.sum("_n").alias("_s")).join(totals.select(*stated, "n"), stated)
        hist = hist.unionByName(seen.select(*keys, F.lit(0).alias("_b"), (F.col("n") - F.col("_s")).alias("_n")).where("_n > 0"))
        hist = hist.groupBy(*keys, "_b").agg(F.sum("_n").alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    hist = hist.withColumns(
        {"_end": F.sum("_n").over(upto), "_total": F.sum("_n").over(whole), "_positive": F.sum(F.when(F.col("_b") > 0, F.col("_n")).otherwise(0)).over(whole)}
    )
    spots = []
    for i, place in enumerate(positions(F.col("_total"))):
        spots.append(F.struct(F.lit(i).alias("i"), F.lit(0).alias("hi"), F.floor(place).alias("rank"), (place - F.floor(place)).alias("frac")))
        spots.append(F.struct(F.lit(i).alias("i"), F.lit(1).alias("hi"), F.ceil(place).alias("rank"), (place - F.floor(place)).alias("frac")))
    start = F.col("_end") - F.col("_n")
    here = F.filter(F.array(*spots), lambda s: (s["rank"] >= start) & (s["rank"] < F.col("_end")))
    local = F.transform(here, lambda s: F.struct(s["i"].alias("i"), s["hi"].alias("hi"), (s["rank"] - start).alias("rank"), s["frac"].alias("frac")))
    kept = ["_total", "_positive"] if counts else []
    hits = materialize(hist.select(*keys, "_b", *kept, local.alias("_spots")).where(F.size("_spots") > 0))
    # a few rows per key: broadcast while that is checked to be small, so the rows stay put
    cand = work.join(broadcast_within(hits, 1_000_000), [*keys, "_b"])
    if totals is not None:
        # bucket 0 holds only zeros, and those were never stored
        cand = cand.where("_b <> 0")
        at_zero = hits.where("_b = 0").select(*keys, *kept, F.explode("_spots").alias("_p"), F.lit(0.0).alias("_v"))
    cand = cand.groupBy(*keys, "_b", "_v").agg(F.sum("_n").alias("_n"), *[F.first(c).alias(c) for c in (*kept, "_spots")])
    w = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    cand = cand.withColumn("_e", F.sum("_n").over(w))
    inside = F.filter("_spots", lambda s: (s["rank"] >= F.col("_e") - F.col("_n")) & (s["rank"] < F.col("_e")))
    found = cand.select(*keys, *kept, F.explode(inside).alias("_p"), "_v")
    if totals is not None:
        found = found.unionByName(at_zero)
    n_places = len(spots) // 2
    ends = found.groupBy(*keys).agg(
        *[F.max(F.when((F.col("_p.i") == i) & (F.col("_p.hi") == h), F.col("_v"))).alias(f"_q{i}_{h}") for i in range(n_places) for h in (0, 1)],
        *[F.max(F.when(F.col("_p.i") == i, F.col("_p.frac"))).alias(f"_f{i}") for i in range(n_places)],
        *[F.max(c).alias(c) for c in kept],
    )
    lo = lambda i: F.col(f"_q{i}_0")
    named = [F.col("_total").alias("n"), F.col("_positive").alias("n_positive")] if counts else []
    return ends.select(*keys, *named, *[(lo(i) + F.col(f"_f{i}") * (F.col(f"_q{i}_1") - lo(i))).alias(f"q{i}") for i in range(n_places)])


def quantiles(rows: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], **options) -> DataFrame:
    """Exact linear-interpolation quantiles per key as columns ``q0, q1, ...`` (see :func:`values_at`)."""
    return values_at(rows, keys, value, lambda n: [(n - 1) * F.lit(float(p)) for p in probs], **options)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int | str, *, salts: int = 64, rank_name: str | None = None) -> DataFrame:
    """First ``n`` rows of every key; ``n`` is a number or the name of a per-row limit column.

    A salted pass keeps n rows per (key, salt), so the final window sees at most n x salts rows.
    """
    limit = F.lit(n) if isinstance(n, int) else F.col(n)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    thin = salted.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= limit).drop("_salt", "_rn")
    final = Window.partitionBy(*keys).orderBy(*order)
    out = thin.withColumn("_rn", F.row_number().over(final)).where(F.col("_rn") <= limit)
    return out.withColumnRenamed("_rn", rank_name) if rank_name else out.drop("_rn")


def broadcast_within(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Broadcast a side only after its row count was checked; a larger side joins by shuffle."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key, the first by ``order``; a map-side combinable aggregate, no window."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*order) if len(order) > 1 else order[0]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_r"))
    return picked.select(*[c if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])
