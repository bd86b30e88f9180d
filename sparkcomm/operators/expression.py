"""Group expression summaries over long non-zero tables; zeros are counted, never stored.

Tables: ``expression(cell_id, gene, value[, layer])`` with non-zero values and
``cells(cell_id, <labels>, x, y, ...)``. ``by`` names extra keys (sketch, permutation,
section, sample) that are carried through, so many runs share one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .lr_table import complex_subunits
from .ranks import broadcast_within, quantiles, values_at

AGGREGATES = ("mean", "clipped_mean", "gated_mean", "median", "tri_mean", "truncated_mean", "truncatedMean")


def select_expression(
    expression: DataFrame,
    *,
    layer: str | None = None,
    use_raw: bool = False,
    genes: DataFrame | None = None,
    gene_symbols_key: str | None = None,
) -> DataFrame:
    """Choose the matrix (main, a layer, or raw) and rename genes by a symbol column."""
    if layer is not None and use_raw:
        raise ValueError("Pass either `layer` or `use_raw=True`, not both.")
    wanted = "raw" if use_raw else layer
    if "layer" in expression.columns:
        main = F.col("layer").isNull() if wanted is None else F.col("layer") == wanted
        chosen = expression.where(main)
        if wanted is not None and chosen.isEmpty():
            raise KeyError(f"`{wanted}` is not a layer of the expression table.")
    elif wanted is not None:
        raise KeyError(f"The expression table has no `layer` column to hold `{wanted}`.")
    else:
        chosen = expression
    if gene_symbols_key is not None:
        if genes is None or gene_symbols_key not in genes.columns:
            raise KeyError(f"`gene_symbols_key={gene_symbols_key!r}` is not present in the genes table.")
        names = genes.select("gene", F.coalesce(F.col(gene_symbols_key).cast("string"), F.lit("")).alias("_symbol"))
        if not names.where(F.col("_symbol") == "").isEmpty():
            raise ValueError(f"`{gene_symbols_key}` contains empty gene names.")
        repeated = names.groupBy("_symbol").count().where("count > 1").select("_symbol").take(5)
        if repeated:
            raise ValueError(f"`{gene_symbols_key}` contains duplicated gene names, e.g. {', '.join(r[0] for r in repeated)}.")
        chosen = chosen.join(broadcast_within(names), "gene").drop("gene").withColumnRenamed("_symbol", "gene")
    return chosen.select("cell_id", "gene", F.col("value").cast("double").alias("value"))


def label_cells(cells: DataFrame, groupby: str, *, condition_key: str | None = None, condition: str | None = None) -> DataFrame:
    """Cells with a string ``group``; keeps only one condition when a value is given."""
    for column in (groupby, condition_key):
        if column is not None and column not in cells.columns:
            raise KeyError(f"`{column}` is not present in the cells table.")
    out = cells
    if condition_key is not None and condition is not None:
        out = out.where(F.col(condition_key).cast("string") == F.lit(str(condition)))
    return out.withColumn("group", F.coalesce(F.col(groupby).cast("string"), F.lit("nan")))


def group_sizes(labelled: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return labelled.groupBy(*by, "group").agg(F.count(F.lit(1)).alias("n_cells"))


def group_weights(sizes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of cells per group."""
    if by:
        total = sizes.groupBy(*by).agg(F.sum("n_cells").alias("_total"))
        out = sizes.join(total, list(by))
    else:
        out = sizes.withColumn("_total", sizes.agg(F.sum("n_cells")).scalar())
    return out.select(*by, "group", (F.col("n_cells") / F.col("_total")).alias("weight"))


def prune_genes(expression: DataFrame, gene_keys: DataFrame, lookup: DataFrame) -> DataFrame:
    """Only the genes asked for, with their ``gene_key``.

    ``lookup`` maps each key to the spelling that counts. A checked broadcast join, so the
    big table is not shuffled.
    """
    wanted = lookup.join(gene_keys.select("gene_key").distinct(), "gene_key", "left_semi")
    return expression.where(F.col("value") != 0).join(broadcast_within(wanted), "gene")


def attach_groups(expression: DataFrame, labelled: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Non-zeros with the group of their cell."""
    return expression.join(labelled.select("cell_id", "group", *by), "cell_id")


def gather_cells(expression: DataFrame, labelled: DataFrame, by: Sequence[str] = (), gene: str = "gene_key") -> DataFrame:
    """One row per cell: its non-zeros, and the places (``by`` keys and group) it takes.

    The only exchange of expression rows that any number of label runs needs: runs are dealt to these rows in front of the
    map-side aggregate. A row holds at most as many values as there are genes in use.
    """
    values = expression.groupBy("cell_id").agg(F.collect_list(F.struct(gene, "value")).alias("_values"))
    places = labelled.groupBy("cell_id").agg(F.collect_list(F.struct("group", *by)).alias("_places"))
    return values.join(places, "cell_id")


def cell_places(gathered: DataFrame) -> DataFrame:
    """Gathered cells, once per place."""
    return gathered.select("cell_id", "_values", F.inline("_places"))


def spread_values(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``(group, keys, gene, value)`` of gathered cells."""
    return rows.select("group", *keys, F.inline("_values"))


def scale_by_max(nz: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Divide by the largest value of the table (of each ``by`` key) when it is positive."""
    return scale_by(nz, nz.groupBy(*by).agg(F.max("value").alias("_max")), by)


def scale_by(nz: DataFrame, top: DataFrame | None, by: Sequence[str] = ()) -> DataFrame:
    """Divide by ``_max`` of ``top``; None leaves the values alone."""
    if top is None:
        return nz
    out = nz.join(top, list(by)) if by else nz.withColumn("_max", top.scalar())
    scaled = F.when(F.col("_max") > 0, F.col("value") / F.col("_max")).otherwise(F.col("value"))
    return out.withColumn("value", scaled).drop("_max")


def positive_quantile_caps(nz: DataFrame, clip_quantile: float, by: Sequence[str] = (), gene: str = "gene") -> DataFrame:
    """Per gene, over all cells: a quantile of the positive values."""
    caps = quantiles(nz.where("value > 0"), [*by, gene], "value", [clip_quantile])
    return caps.withColumnRenamed("q0", "cap")


def detection_weight(pct: Column) -> Column:
    """Step weight by detected fraction."""
    eps = 1e-12
    return F.when(pct > 0.75 + eps, 1.0).when(pct > 0.5 + eps, 0.75).when(pct > 0.25 + eps, 0.25).otherwise(0.0)


def group_expression(
    nz: DataFrame,
    sizes: DataFrame,
    *,
    aggregate: str = "tri_mean",
    trim: float = 0.1,
    clip_quantile: float = 0.99,
    by: Sequence[str] = (),
    caps: DataFrame | None = None,
    caps_by: Sequence[str] | None = None,
    gene: str = "gene",
) -> DataFrame:
    """``(by, group, gene, expr, pct)`` for every combination that has a non-zero.

    A combination that is absent has expr = pct = 0 (see :func:`fill_grid`).
    """
    if aggregate not in AGGREGATES:
        raise ValueError(f"`aggregate` must be one of: {', '.join(sorted(AGGREGATES))}.")
    cell = [*by, "group"]
    keys = [*cell, gene]
    if aggregate in ("clipped_mean", "gated_mean"):
        caps_by = by if caps_by is None else caps_by
        if caps is None:
            caps = positive_quantile_caps(nz, clip_quantile, caps_by, gene)
        nz = nz.join(caps, [*caps_by, gene], "left")
        measured = F.sum(F.least("value", F.coalesce("cap", F.lit(0.0))))
    else:
        measured = F.sum("value")
    totals = sizes.select(*cell, F.col("n_cells").alias("n"))
    if aggregate in ("truncated_mean", "truncatedMean"):
        # every pass below reads the values with their counts; the cells are joined and exchanged once
        nz = materialize(nz.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("_c")))
        times = F.col("_c")
        measured = F.sum(F.col("value") * times)
        seen, positive = F.sum(times), F.sum(F.when(F.col("value") > 0, times).otherwise(0))
    else:
        seen, positive = F.count(F.lit(1)), F.count_if(F.col("value") > 0)
    if aggregate in ("median", "tri_mean"):
        # two passes: bucket counts (which also give the detected share), then the wanted buckets
        probs = [0.5] if aggregate == "median" else [0.25, 0.5, 0.75]
        q = quantiles(nz, keys, "value", probs, totals=totals, counts=True)
        expr = F.col("q0") if aggregate == "median" else (F.col("q0") + 2 * F.col("q1") + F.col("q2")) / 4
        return q.select(*keys, expr.alias("expr"), (F.col("n_positive") / F.col("n")).alias("pct"))
    base = nz.groupBy(*keys).agg(measured.alias("_sum"), seen.alias("_nnz"), positive.alias("_pos"))
    base = base.join(sizes.select(*cell, "n_cells"), cell)
    mean = F.col("_sum") / F.col("n_cells")
    pct = (F.col("_pos") / F.col("n_cells")).alias("pct")
    if aggregate in ("mean", "clipped_mean"):
        return base.select(*keys, mean.alias("expr"), pct)
    if aggregate == "gated_mean":
        share = F.col("_pos") / F.col("n_cells")
        gated = F.when(share > 0, mean / share * detection_weight(share)).otherwise(0.0)
        return base.select(*keys, gated.alias("expr"), pct)

    # truncated mean: the values at both cuts, then one more pass of plain sums
    share = F.floor(F.col("n_cells") * F.lit(float(trim)))
    sized = base.withColumn("_cut", F.when((share > 0) & (F.col("n_cells") - 2 * share > 0), share))
    cut = lambda n: F.floor(n * F.lit(float(trim)))
    ends = values_at(nz, keys, "value", lambda n: [cut(n), n - cut(n) - 1], weight="_c", totals=totals)
    ends = ends.withColumnsRenamed({"q0": "_lo", "q1": "_hi"})
    zeros = base.select(*keys, F.lit(0.0).alias("value"), (F.col("n_cells") - F.col("_nnz")).alias("_n"))
    counted = nz.select(*keys, "value", F.col("_c").alias("_n")).unionByName(zeros)
    v, n = F.col("value"), F.col("_n")
    inner = (
        counted.join(ends, keys)
        .groupBy(*keys, "_lo", "_hi")
        .agg(
            F.sum(F.when((v > F.col("_lo")) & (v < F.col("_hi")), v * n)).alias("_mid"),
            F.sum(F.when(v <= F.col("_lo"), n)).alias("_le"),
            F.coalesce(F.sum(F.when(v < F.col("_hi"), n)), F.lit(0)).alias("_lt"),
        )
    )
    kept = F.col("n_cells") - 2 * F.col("_cut")
    total = (
        F.coalesce("_mid", F.lit(0.0))
        + F.col("_lo") * (F.col("_le") - F.col("_cut"))
        + F.col("_hi") * (F.col("n_cells") - F.col("_cut") - F.col("_lt"))
    )
    trimmed = F.when(F.col("_cut").isNull(), mean).when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(total / kept)
    return sized.join(inner, keys, "left").select(*keys, trimmed.alias("expr"), pct)


def fill_grid(summary: DataFrame, sizes: DataFrame, genes: DataFrame, by: Sequence[str] = (), gene: str = "gene") -> DataFrame:
    """All groups x genes with zeros where nothing was measured (the result is that grid)."""
    cell = [*by, "group"]
    grid = sizes.select(*cell).join(broadcast_within(genes.select(gene).distinct()))
    return grid.join(summary, [*cell, gene], "left").fillna(0.0, ["expr", "pct"])


def complex_expression(
    summary: DataFrame, subunits: DataFrame, *, aggregate: str = "min", by: Sequence[str] = (), gene: str = "gene_key"
) -> DataFrame:
    """Value of each complex per group, only where every subunit was seen.

    ``min`` is the weakest subunit; ``geometric_mean`` is 0 unless all are positive. pct is
    always the minimum. Complexes absent from the result are 0.
    """
    if aggregate not in ("min", "geometric_mean"):
        raise ValueError("`complex_aggregate` must be `min` or `geometric_mean`.")
    joined = summary.withColumnRenamed(gene, "gene_key").join(subunits, "gene_key")
    positive = F.when(F.col("expr") > 0, F.col("expr"))
    geometric = F.when(F.first("n_subunits") == 1, F.min("expr")).when(F.min("expr") > 0, F.exp(F.avg(F.log(positive)))).otherwise(0.0)
    out = joined.groupBy(*by, "group", "complex").agg(
        (F.min("expr") if aggregate == "min" else geometric).alias("expr"),
        F.min("pct").alias("pct"),
        F.count(F.lit(1)).alias("_have"),
        F.first("n_subunits").alias("_need"),
    )
    return out.where("_have = _need").drop("_have", "_need")


def cofactor_products(
    summary: DataFrame, lr: DataFrame, column: str, factor: Column, *, by: Sequence[str] = (), gene: str = "gene_key"
) -> DataFrame:
    """``(by, group, <column>, f)``: product of ``factor`` (in terms of ``expr``) over the cofactor genes.

    Genes that are not measured have value 0, for which every factor is 1; so are absent rows.
    """
    parts = complex_subunits(lr, [column])
    joined = summary.withColumnRenamed(gene, "gene_key").join(parts, "gene_key")
    return joined.groupBy(*by, "group", F.col("complex").alias(column)).agg(F.product(factor).alias("f"))


def centroid_pair_weights(labelled: DataFrame, distance_decay: float, by: Sequence[str] = (), x: str = "x", y: str = "y") -> DataFrame:
    """exp(-centroid distance / decay) for every ordered pair of groups (of each ``by`` key)."""
    centroids = labelled.groupBy(*by, "group").agg(F.avg(x).alias("cx"), F.avg(y).alias("cy"))
    s = centroids.select(*by, F.col("group").alias("source"), F.col("cx").alias("sx"), F.col("cy").alias("sy"))
    t = centroids.select(*by, F.col("group").alias("target"), F.col("cx").alias("tx"), F.col("cy").alias("ty"))
    pairs = s.join(t, list(by)) if by else s.join(t)
    distance = F.hypot(F.col("sx") - F.col("tx"), F.col("sy") - F.col("ty"))
    return pairs.select(*by, "source", "target", F.coalesce(F.exp(-distance / F.lit(float(distance_decay))), F.lit(0.0)).alias("pair_weight"))
