"""Expression tables of signalling genes: group summaries with z-scores, and per-cell values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import complex_genes, text
from ..model import CommResult
from . import expression as ex
from .lr_table import COFACTOR_COLUMNS
from .ranks import broadcast_within
from .resample import sample_per_group


def resolve_genes(candidates: DataFrame, genes: DataFrame, *, strict: bool = False) -> DataFrame:
    """Names as the matrix spells them: an exact match first, else one that ignores case."""
    wanted = candidates.select(F.col("gene").alias("asked")).where(F.trim("asked") != "").distinct()
    exact = wanted.join(genes.select("gene").distinct(), F.col("asked") == F.col("gene"), "left")
    upper = genes.groupBy(F.upper("gene").alias("_key")).agg(F.max("gene").alias("_alt"))
    found = exact.join(upper, F.upper("asked") == F.col("_key"), "left").withColumn("gene", F.coalesce("gene", "_alt"))
    if strict:
        missing = [r[0] for r in found.where("gene IS NULL").select("asked").take(5)]
        if missing:
            raise KeyError(f"Requested genes are not present in the expression table: {missing}")
    return found.where("gene IS NOT NULL").select("gene").distinct()


def select_signaling_genes(
    genes: DataFrame,
    *,
    explicit: Sequence[str] | None = None,
    result: CommResult | None = None,
    lr: DataFrame | None = None,
    signaling: Sequence[str] | None = None,
    enriched_only: bool = True,
    include_cofactors: bool = False,
) -> DataFrame:
    """Genes from an explicit list, or those of (significant) interactions or an LR table."""
    spark = genes.sparkSession
    if explicit is not None:
        return resolve_genes(spark.createDataFrame([(str(g),) for g in explicit], "gene string"), genes, strict=True)
    if not enriched_only and lr is not None:
        rows = lr
    elif result is None:
        raise ValueError("Provide `explicit` genes, or a `result` to derive signaling genes.")
    elif enriched_only:
        rows = result.significant()
        if rows.isEmpty() and result.interactions.where("pvalue IS NOT NULL").isEmpty():
            rows = result.interactions
    else:
        rows = result.interactions
    if signaling is not None:
        rows = rows.where(F.col("pathway").isin([signaling] if isinstance(signaling, str) else list(signaling)))
    columns = ["ligand", "receptor"] + ([c for c in COFACTOR_COLUMNS if c in rows.columns] if include_cofactors else [])
    parts = F.flatten(F.array(*[complex_genes(text(c)) for c in columns]))
    return resolve_genes(rows.select(F.explode(parts).alias("gene")).distinct(), genes)


def signaling_expression_frame(
    expression: DataFrame,
    cells: DataFrame,
    groupby: str,
    selected: DataFrame,
    *,
    groups: Sequence[str] | None = None,
    aggregate: str = "mean",
    trim: float = 0.1,
    standard_scale: bool = True,
    scale_min: float = -2.5,
    scale_max: float = 2.5,
) -> DataFrame:
    """Per group and gene: mean, detected share, cells, z-score over the groups (clipped)."""
    if standard_scale and scale_min >= scale_max:
        raise ValueError("`scale_min` must be less than `scale_max`.")
    labelled = ex.label_cells(cells, groupby)
    if groups is not None:
        labelled = labelled.where(F.col("group").isin(list(groups)))
    sizes = ex.group_sizes(labelled)
    wanted = expression.where(F.col("value") != 0).join(broadcast_within(selected), "gene", "left_semi")
    summary = ex.group_expression(ex.attach_groups(wanted, labelled), sizes, aggregate=aggregate, trim=trim)
    full = ex.fill_grid(summary, sizes, selected).join(sizes, "group")
    z = F.col("expr")
    if standard_scale:
        per_gene = Window.partitionBy("gene")  # one row per group
        sd = F.stddev_pop("expr").over(per_gene)
        z = F.when(sd > 0, (F.col("expr") - F.avg("expr").over(per_gene)) / sd).otherwise(0.0)
        z = F.least(F.greatest(z, F.lit(float(scale_min))), F.lit(float(scale_max)))
    return full.select(
        "group", "gene", F.col("expr").alias("mean_expression"), F.col("pct").alias("pct_expressed"), "n_cells", z.alias("scaled_expression")
    )


def signaling_expression_values(
    expression: DataFrame,
    cells: DataFrame,
    groupby: str,
    selected: DataFrame,
    *,
    groups: Sequence[str] | None = None,
    max_cells_per_group: int | None = None,
    seed: int = 0,
) -> DataFrame:
    """Per-cell values of the selected genes, zeros included: cells x genes rows by definition."""
    labelled = ex.label_cells(cells, groupby)
    if groups is not None:
        labelled = labelled.where(F.col("group").isin(list(groups)))
    if max_cells_per_group is not None:
        if max_cells_per_group <= 0:
            raise ValueError("`max_cells_per_group` must be positive.")
        labelled = sample_per_group(labelled, max_cells_per_group, seed=seed)
    grid = labelled.select("cell_id", "group").join(broadcast_within(selected))
    wanted = expression.join(broadcast_within(selected), "gene", "left_semi")
    joined = grid.join(wanted.select("cell_id", "gene", "value"), ["cell_id", "gene"], "left")
    return joined.select("cell_id", "group", "gene", F.coalesce("value", F.lit(0.0)).alias("expression"))
