"""Hashed sampling and label shuffles: repeatable, without sorting a whole table.

A shuffle orders items by a hash and deals the labels out in blocks of their counts. Only
the hash values at the block borders are needed: a handful of order statistics per shuffle,
found from bucket counts. Labelling is then a comparison per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_bucket, hash_long
from ..session import materialize
from .ranks import running_totals, select_ranks, top_per_key


def repeat_rows(df: DataFrame, n: int, name: str) -> DataFrame:
    """Each row once per run id 0..n-1 (map side)."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def spread_rows(df: DataFrame, times: int, id_col: str, rows: int = 100_000) -> DataFrame:
    """Rows over as many tasks as the hashes of ``times`` runs of them need: a table of items is small and lies in one file, its runs are not."""
    tasks = -(-df.count() * times // rows)
    return df.repartition(tasks, id_col) if tasks > 1 else df


def sample_per_group(labelled: DataFrame, n_per_group: int, *, seed: int = 0, repeats: int | None = None, id_col: str = "cell_id") -> DataFrame:
    """At most ``n_per_group`` cells of each group, by hash order; ``repeats`` adds a ``repeat`` key."""
    if n_per_group < 1:
        raise ValueError("`downsample_per_group` must be positive.")
    if repeats is None:
        hashed = labelled.withColumn("_h", hash_long(seed, F.lit("0"), F.col(id_col)))
        return top_per_key(hashed, ["group"], [F.col("_h"), F.col(id_col)], n_per_group).drop("_h")
    many = repeat_rows(labelled, repeats, "repeat")
    hashed = many.withColumn("_h", hash_long(seed, F.col("repeat"), F.col(id_col)))
    return top_per_key(hashed, ["repeat", "group"], [F.col("_h"), F.col(id_col)], n_per_group).drop("_h")


def shuffled_labels(
    items: DataFrame,
    label: str,
    n: int,
    *,
    id_col: str,
    seed: int = 0,
    within: Sequence[str] = (),
    run: str = "perm_id",
    into: str | None = None,
) -> DataFrame:
    """Items times ``n`` runs with the labels shuffled inside each ``within`` stratum.

    Every run keeps the label counts of every stratum exactly. Adds ``run`` and the new label.
    """
    borders = label_borders(items, label, n, id_col=id_col, seed=seed, within=within, run=run)
    items = spread_rows(items, n, id_col)
    return deal_labels(items, borders, n, id_col=id_col, seed=seed, within=within, run=run, into=into or label)


def label_borders(
    items: DataFrame, label: str, n: int, *, id_col: str, seed: int = 0, within: Sequence[str] = (), run: str = "perm_id"
) -> DataFrame:
    """What a label shuffle needs to know: per stratum and run the labels in order, and the first item of every block but one.

    One row per stratum and run, written, so that the planner knows its size.
    """
    base = items if within else items.withColumn("_all", F.lit(0))
    strata = list(within) or ["_all"]
    counts = base.groupBy(*strata, label).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*strata).orderBy(label).rowsBetween(Window.unboundedPreceding, 0)
    blocks = counts.withColumn("_end", F.sum("_c").over(w)).drop("_c")
    last = Window.partitionBy(*strata).orderBy(F.desc(label))
    ends = blocks.withColumn("_r", F.row_number().over(last)).where("_r > 1").select(*strata, F.col("_end").alias("rank"))
    labels = blocks.groupBy(*strata).agg(F.transform(F.array_sort(F.collect_list(F.struct("_end", label))), lambda x: x[label]).alias("_labels"))
    thin = _run_hashes(spread_rows(base.select(*strata, id_col), n, id_col), n, id_col, seed, run)
    found = select_ranks(thin, [*strata, run], ["_h", id_col], hash_bucket(F.col("_h")), repeat_rows(ends, n, run))
    # the item at a border rank is the first of the next block
    cuts = found.groupBy(*strata, run).agg(F.array_sort(F.collect_list(F.struct("_h", id_col))).alias("_cut"))
    return materialize(repeat_rows(labels, n, run).join(cuts, [*strata, run], "left").drop("_all"))


def deal_labels(
    rows: DataFrame, borders: DataFrame, n: int, *, id_col: str, seed: int = 0, within: Sequence[str] = (), run: str = "perm_id", into: str = "group"
) -> DataFrame:
    """Rows times ``n`` runs with the label that each run deals to the row's item (see :func:`label_borders`).

    The rows may carry anything and are not shuffled while the borders are small enough to broadcast.
    """
    out = _run_hashes(rows, n, id_col, seed, run).join(borders, [*within, run])
    at = F.struct(F.col("_h"), F.col(id_col))
    passed = F.coalesce(F.size(F.filter("_cut", lambda c: c <= at)), F.lit(0))
    return out.withColumn(into, F.element_at("_labels", passed.cast("int") + 1)).drop("_h", "_cut", "_labels")


def _run_hashes(df: DataFrame, n: int, id_col: str, seed: int, run: str) -> DataFrame:
    return repeat_rows(df, n, run).withColumn("_h", hash_long(seed, F.col(run), F.col(id_col)))


def shuffled_values(items: DataFrame, value: str, n: int, *, id_cols: Sequence[str], seed: int = 0, run: str = "iteration") -> DataFrame:
    """Runs of a value column permuted over its rows, as ``(ids, run, value)``.

    Both sides get their rank inside a run (bucketed running counts) and meet on it.
    """
    rows = items.select(*id_cols, value)
    one = {"_pos": F.lit(1).cast("bigint")}
    ident = F.concat_ws("|", *id_cols)
    order = rows.withColumn("_h", hash_long(seed, F.lit("base"), ident))
    ranked = running_totals(order, [], [F.col("_h"), *[F.col(c) for c in id_cols]], hash_bucket(F.col("_h")), one)
    runs = repeat_rows(rows.select(*id_cols), n, run).withColumn("_h", hash_long(seed, F.col(run), ident))
    placed = running_totals(runs, [run], [F.col("_h"), *[F.col(c) for c in id_cols]], hash_bucket(F.col("_h")), one)
    return placed.select(*id_cols, run, "_pos").join(ranked.select("_pos", value), "_pos").drop("_pos")


def stratified_sample(labelled: DataFrame, max_cells: int | None, *, seed: int = 0, id_col: str = "cell_id") -> DataFrame:
    """Proportional quota per group (half-even rounding, at least 1), filled up to ``max_cells``.

    Groups take their quota in label order from what remains; open places go to the unused
    cells of smallest hash.
    """
    if max_cells is None:
        return labelled
    total = labelled.agg(F.count(F.lit(1)))
    sizes = labelled.groupBy("group").agg(F.count(F.lit(1)).alias("_n")).withColumn("_total", total.scalar())
    quota = F.greatest(F.lit(1), F.bround(F.lit(float(max_cells)) * F.col("_n") / F.col("_total")).cast("bigint"))
    sizes = sizes.withColumn("_want", F.least(quota, F.col("_n")))
    # quotas in label order: each group may use what is left but one place per later group
    ordered = sizes.groupBy().agg(F.array_sort(F.collect_list(F.struct("group", "_want", "_n"))).alias("_g"))
    start = F.struct(F.lit(max_cells).cast("bigint").alias("left"), F.lit(0).alias("i"), F.array().cast("array<struct<group:string,quota:bigint>>").alias("out"))

    def take(acc, x):
        later = F.size("_g") - acc["i"] - 1
        q = F.when(acc["left"] <= 0, F.lit(0)).otherwise(F.least(x["_want"], F.greatest(F.lit(1), acc["left"] - later))).cast("bigint")
        row = F.struct(x["group"].alias("group"), q.alias("quota"))
        return F.struct((acc["left"] - q).alias("left"), (acc["i"] + 1).alias("i"), F.concat(acc["out"], F.array(row)).alias("out"))

    quotas = ordered.select(F.inline(F.aggregate("_g", start, take, lambda acc: acc["out"])))
    hashed = labelled.withColumn("_h", hash_long(seed, F.lit("sample"), F.col(id_col)))
    hashed = hashed.join(quotas, "group")
    taken = top_per_key(hashed, ["group"], [F.col("_h"), F.col(id_col)], "quota")
    used = taken.select(id_col)
    rest = labelled.join(used, id_col, "left_anti").withColumn("_h", hash_long(seed, F.lit("sample"), F.col(id_col)))
    fill = rest.withColumn("_open", F.lit(max_cells) - taken.agg(F.count(F.lit(1))).scalar()).where("_open > 0")
    fill = top_per_key(fill.withColumn("_k", F.lit(0)), ["_k"], [F.col("_h"), F.col(id_col)], "_open")
    return taken.select(*labelled.columns).unionByName(fill.select(*labelled.columns))
