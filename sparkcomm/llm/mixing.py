"""Mixing sources to target weights along a curriculum of time-varying weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkcomm.llm.common import WORD
from sparkcomm.session import materialize

#: A schedule: (time, weight) points from time 0 to 1, joined by straight lines. These have the integrals 5, 2 and 1.
Schedule = tuple[tuple[float, float], ...]
FADING, STEADY, RISING = ((0.0, 6.0), (1.0, 4.0)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 0.5), (1.0, 1.5))
SCHEDULES: tuple[Schedule, ...] = (FADING, STEADY, RISING)


def integral(schedule: Schedule) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False))


def time_of(share: Column, schedule: Schedule) -> Column:
    """The time at which a source's cumulative demand reaches this share of its target: the integral, inverted piece by piece."""
    total, done = integral(schedule), 0.0
    pieces = []
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        slope, area = (w1 - w0) / (t1 - t0), (t1 - t0) * (w0 + w1) / 2
        need = F.greatest(share * total - done, F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * need, F.lit(0.0)))
        if area > 0:
            pieces.append((done + area, F.least(t0 + 2 * need / (w0 + root), F.lit(float(t1)))))
        done += area
    out = pieces[-1][1]
    for end, at in reversed(pieces[:-1]):
        out = F.when(share * total <= end, at).otherwise(out)
    return out


def by_class(index: Column, values: list[Column]) -> Column:
    out = values[-1]
    for i, v in reversed(list(enumerate(values[:-1]))):
        out = F.when(index % len(values) == i, v).otherwise(out)
    return out


def targets(totals: DataFrame, *, share: float = 1.5, epochs: int = 2, schedules: tuple[Schedule, ...] = SCHEDULES) -> DataFrame:
    """Add to (source, source_size) the class of each source and its target.

    Sources in code point order, null last, take the schedules in turn; a weight is the integral of its schedule.
    Together the targets are ``share`` of all sizes; a target stops at ``epochs`` times its source's size, and what is
    over goes to the others by weight. In closed form: with sources by size per weight, the level of the rest after
    the first k were filled rises until the first source that is not filled; targets are the least of cap and
    level x weight. One row per source stands in these windows.
    """
    everything = W.partitionBy(F.lit(0))
    named = totals.withColumn("_class", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1)
    named = named.withColumn("_weight", by_class(F.col("_class"), [F.lit(integral(s)) for s in schedules])).withColumn("_cap", F.col("source_size") * float(epochs))
    before = everything.orderBy(F.col("_cap") / F.col("_weight"), "_class").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0.0)
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("_cap").over(before), zero)) / (F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), zero))
    levels = named.withColumn("_level", level).withColumn("_level", F.max("_level").over(everything))
    return levels.select("source", "source_size", "_class", F.least("_cap", F.col("_level") * F.col("_weight")).alias("target"))


def plan(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.5, epochs: int = 2, schedules: tuple[Schedule, ...] = SCHEDULES, seed: str = "mix", carry: bool = False) -> DataFrame:
    """What the mix takes of each document: key, source, size, source_size, target, taken, takes.

    Size counts words; null and empty texts have none. A source's documents stand in the order of a hash of seed, key and
    text, ``epochs`` times over, and the mix takes this stream up to the target, so at most one document of a source is
    taken in part, and none more than ``epochs`` times. ``takes`` lists (epoch, words, position); a position is
    the training time at which the source's schedule asks for the middle word. Null sources are one source. Equal
    rows stand side by side. ``carry`` adds the whole row as the struct ``row``.

    Running totals go over three steps (256 coarse, 65,536 fine hash ranges of a source, then rows), so that no task
    orders a whole source.
    """
    h = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text).cast("binary"), F.lit(b"")))))
    rows = docs.select(
        F.col(key).alias("key"), F.col(source).cast("string").alias("source"), F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        h.alias("h"), F.xxhash64(text).alias("th"), *([F.struct("*").alias("row")] if carry else []),
    )
    name = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("-"))
    rows = rows.withColumn("name", name).withColumn("fine", F.substring("h", 1, 4))
    sums = materialize(rows.groupBy("name", "source", "fine").agg(F.sum("size").alias("n"))).withColumn("coarse", F.substring("fine", 1, 2))
    coarse = sums.groupBy("name", "source", "coarse").agg(F.sum("n").alias("n"))
    wanted = targets(coarse.groupBy("source").agg(F.sum("n").alias("source_size")), share=share, epochs=epochs, schedules=schedules)
    wanted = wanted.withColumn("name", name).drop("source")
    zero = F.lit(0)
    coarse = coarse.select("name", "coarse", F.coalesce(F.sum("n").over(W.partitionBy("name").orderBy("coarse").rowsBetween(W.unboundedPreceding, -1)), zero).alias("c0"))
    fine = sums.join(coarse, ["name", "coarse"]).join(wanted, "name")
    inside = F.coalesce(F.sum("n").over(W.partitionBy("name", "coarse").orderBy("fine").rowsBetween(W.unboundedPreceding, -1)), zero)
    fine = fine.select("name", "fine", (F.col("c0") + inside).alias("f0"), "source_size", "target", "_class")
    here = W.partitionBy("name", "fine").orderBy("h", "key", "size", "th").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.join(fine, ["name", "fine"]).withColumn("start", F.col("f0") + F.coalesce(F.sum("size").over(here), zero))

    words = F.floor(F.round("target", 6)).cast("long")
    takes = []
    for e in range(epochs):
        at = F.col("start") + e * F.col("source_size")
        n = F.greatest(F.least(words - at, F.col("size")), zero).cast("long")
        middle = F.least((at + n / 2) / F.greatest(words, F.lit(1)), F.lit(1.0))
        takes.append(F.struct(F.lit(e).alias("epoch"), n.alias("words"), by_class(F.col("_class"), [time_of(middle, s) for s in schedules]).alias("position")))
    placed = placed.withColumn("takes", F.filter(F.array(*takes), lambda t: t["words"] > 0))
    taken = F.aggregate("takes", F.lit(0).cast("long"), lambda a, t: a + t["words"])
    return placed.select(F.col("key").alias(key), "source", "size", "source_size", "target", taken.alias("taken"), "takes", *(["row"] if carry else []))


def curriculum(docs: DataFrame, **options) -> DataFrame:
    """The plan in training order: ``position`` is that of a document's first take (null, and last, if it is not taken); ties by key."""
    key = options.get("key", "doc_id")
    rows = plan(docs, **options).withColumn("position", F.get("takes", F.lit(0))["position"]).withColumn("_late", F.col("position").isNull())
    n = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return rows.repartitionByRange(int(n), "_late", "position", key).sortWithinPartitions("_late", "position", key).drop("_late")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs in training order, as often as the mix takes them, with all their columns.

    A document cut by a target comes whole if at least half of it was taken, else not. Rows are range-sorted by
    position; ties by key. Documents without words are never taken.
    """
    key = options.get("key", "doc_id")
    takes = plan(docs, carry=True, **options).select("row", "size", F.explode("takes").alias("take"))
    takes = takes.where(2 * F.col("take.words") >= F.col("size"))
    n = takes.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ordered = takes.select("row", F.col("take.position").alias("p"), F.col(f"row.{key}").alias("k"), F.col("take.epoch").alias("e")).repartitionByRange(int(n), "p", "k", "e").sortWithinPartitions("p", "k", "e")
    return ordered.select("row.*")
