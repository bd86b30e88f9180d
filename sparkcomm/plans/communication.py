"""The flagship job: cells, expression and an LR table to scored interactions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import CommResult, LRTable
from ..session import materialize
from ..operators import expression as ex
from ..operators import markers as mk
from ..operators.lr_table import complex_subunits, filter_lr_to_genes, gene_lookup, lr_expression_genes, normalize_lr_table
from ..operators.ranks import reaches
from ..operators.resample import deal_labels, label_borders, repeat_rows, sample_per_group
from ..operators.scoring import PAIR_KEYS, SCORE_METHODS, resolve_complex_aggregate, score_lr
from ..operators.sketches import summarize_sketches


def _check(
    *,
    min_pct: float,
    min_expr: float,
    n_permutations: int,
    pvalue_cutoff: float,
    aggregate: str,
    trim: float,
    clip_quantile: float,
    distance_decay: float | None,
    cofactor_kh: float,
    cofactor_hill: float,
    score_method: str,
    downsample: int | None,
    downsample_repeats: int,
) -> None:
    rules = [
        (0 <= min_pct <= 1, "`min_pct` must be between 0 and 1."),
        (min_expr >= 0, "`min_expr` must be non-negative."),
        (n_permutations >= 0, "`n_permutations` must be non-negative."),
        (0 <= pvalue_cutoff <= 1, "`pvalue_cutoff` must be between 0 and 1."),
        (aggregate in ex.AGGREGATES, f"`aggregate` must be one of: {', '.join(sorted(ex.AGGREGATES))}."),
        (0 <= trim < 0.5, "`trim` must be in [0, 0.5)."),
        (0 < clip_quantile <= 1, "`clip_quantile` must be in (0, 1]."),
        (distance_decay is None or distance_decay > 0, "`distance_decay` must be positive."),
        (cofactor_kh > 0, "`cofactor_kh` must be positive."),
        (cofactor_hill > 0, "`cofactor_hill` must be positive."),
        (score_method in SCORE_METHODS, f"`score_method` must be one of: {', '.join(sorted(SCORE_METHODS))}."),
        (downsample is None or downsample >= 1, "`downsample_per_group` must be positive."),
        (downsample_repeats >= 1, "`downsample_repeats` must be positive."),
    ]
    for ok, message in rules:
        if not ok:
            raise ValueError(message)


def compute_communication(
    expression: DataFrame,
    cells: DataFrame,
    lr_table: LRTable | DataFrame,
    groupby: str,
    *,
    genes: DataFrame | None = None,
    condition_key: str | None = None,
    condition: str | None = None,
    layer: str | None = None,
    use_raw: bool = False,
    gene_symbols_key: str | None = None,
    min_pct: float = 0.05,
    min_expr: float = 0.0,
    n_permutations: int = 0,
    random_state: int = 0,
    pvalue_cutoff: float = 0.05,
    aggregate: str = "tri_mean",
    trim: float = 0.1,
    clip_quantile: float = 0.99,
    population_size: bool = False,
    spatial: bool = False,
    distance_decay: float | None = None,
    cofactor_adjust: bool = False,
    cofactor_kh: float = 0.5,
    cofactor_hill: float = 1.0,
    score_method: str = "sqrt",
    complex_aggregate: str = "auto",
    downsample_per_group: int | None = None,
    downsample_repeats: int = 1,
    de_gate: bool = False,
    overexpressed_genes: DataFrame | Mapping[str, Sequence[str]] | None = None,
    de_method: str = "mean",
    de_min_pct: float = 0.1,
    de_min_logfc: float = 0.1,
    de_pvalue_cutoff: float | None = None,
    check: bool = True,
) -> CommResult:
    """Communication scores of every source group, target group and LR row.

    ``genes`` (``gene[, ord, symbols]``) saves a scan for the gene list. ``check=False`` skips
    the small jobs that look for empty inputs.
    """
    _check(
        min_pct=min_pct,
        min_expr=min_expr,
        n_permutations=n_permutations,
        pvalue_cutoff=pvalue_cutoff,
        aggregate=aggregate,
        trim=trim,
        clip_quantile=clip_quantile,
        distance_decay=distance_decay,
        cofactor_kh=cofactor_kh,
        cofactor_hill=cofactor_hill,
        score_method=score_method,
        downsample=downsample_per_group,
        downsample_repeats=downsample_repeats,
    )
    resolve_complex_aggregate(score_method, complex_aggregate)
    labelled = ex.label_cells(cells, groupby, condition_key=condition_key, condition=condition)
    groups = labelled.select("group").distinct()
    if check and len(groups.take(2)) < 2:
        raise ValueError("At least two cell groups are required for communication inference.")
    lr_name = lr_table.name if isinstance(lr_table, LRTable) else "custom"
    lr = lr_table.interactions if isinstance(lr_table, LRTable) else normalize_lr_table(lr_table, check=check)

    matrix = ex.select_expression(expression, layer=layer, use_raw=use_raw, genes=genes, gene_symbols_key=gene_symbols_key)
    if genes is not None and gene_symbols_key is not None:
        names = genes.select(F.col(gene_symbols_key).cast("string").alias("gene"), *(["ord"] if "ord" in genes.columns else []))
    else:
        names = genes if genes is not None else matrix.select("gene").distinct()
    lookup = gene_lookup(names, order="ord" if "ord" in names.columns else None)
    lr = materialize(lr)
    # rows with a gene that is not measured never score, so the filter is only a check
    if check and filter_lr_to_genes(lr, lookup).isEmpty():
        raise ValueError("No ligand-receptor pairs have all required genes in the expression table.")
    nz = ex.prune_genes(matrix, lr_expression_genes(lr, include_cofactors=cofactor_adjust), lookup)

    sets = None
    if overexpressed_genes is not None:
        sets = mk.overexpressed_sets(overexpressed_genes, expression.sparkSession)
    elif de_gate:
        core = complex_subunits(lr).select("gene_key").distinct()
        markers = mk.identify_overexpressed_genes(
            ex.attach_groups(nz.join(core, "gene_key", "left_semi"), labelled),
            ex.group_sizes(labelled),
            method=de_method,
            min_pct=de_min_pct,
            min_logfc=de_min_logfc,
            pvalue_cutoff=de_pvalue_cutoff,
            gene="gene_key",
        )
        sets = mk.overexpressed_sets(markers.withColumnRenamed("gene_key", "gene"))

    by: list[str] = []
    if downsample_per_group is not None:
        many = downsample_repeats > 1
        labelled = sample_per_group(labelled, downsample_per_group, seed=random_state, repeats=downsample_repeats if many else None)
        by = ["repeat"] if many else []
    sizes = ex.group_sizes(labelled, by)
    weights = ex.group_weights(sizes, by) if population_size else None
    near = spatial and distance_decay is not None

    # expression meets its cells once, however many passes and runs follow
    once = aggregate == "mean" and score_method != "cellchat"
    if n_permutations > 0:
        gathered = materialize(ex.gather_cells(nz, labelled, by))
        placed = ex.cell_places(gathered)
        plain = ex.spread_values(placed, by)
    else:
        plain = ex.attach_groups(nz, labelled, by).select("group", *by, "gene_key", "value")
        plain = plain if once else materialize(plain)
    # what does not change under a shuffle is taken from the cells in use, once
    top = plain.groupBy(*by).agg(F.max("value").alias("_max")) if score_method == "cellchat" else None
    caps = None
    if aggregate in ("clipped_mean", "gated_mean"):
        caps = ex.positive_quantile_caps(ex.scale_by(plain, top, by), clip_quantile, by, "gene_key")

    def scored(values: DataFrame, cells_now: DataFrame, keys: list[str], sizes_now: DataFrame) -> DataFrame:
        summary = ex.group_expression(
            ex.scale_by(values, top, by),
            sizes_now,
            aggregate=aggregate,
            trim=trim,
            caps=caps,
            caps_by=by,
            by=keys,
            gene="gene_key",
        )
        return score_lr(
            lr,
            materialize(summary) if cofactor_adjust else summary,
            by=keys,
            min_pct=min_pct,
            min_expr=min_expr,
            score_method=score_method,
            complex_aggregate=complex_aggregate,
            overexpressed=sets,
            weights=weights,
            weights_by=by,
            pair_weights=ex.centroid_pair_weights(cells_now, distance_decay, keys) if near else None,
            pair_by=keys,
            cofactor_adjust=cofactor_adjust,
            kh=cofactor_kh,
            hill=cofactor_hill,
        )

    rows = scored(plain, labelled, by, sizes)
    if n_permutations > 0:
        runs = {"id_col": "cell_id", "seed": random_state, "within": by}
        borders = label_borders(labelled, "group", n_permutations, **runs)
        keys = [*by, "perm_id"]
        dealt = ex.spread_values(deal_labels(placed.drop("group"), borders, n_permutations, **runs), keys)
        shuffled = deal_labels(labelled, borders, n_permutations, **runs)
        # group sizes do not change under a shuffle
        null = scored(dealt, shuffled, keys, repeat_rows(sizes, n_permutations, "perm_id"))
        rows = attach_permutation_pvalues(rows, null, n_permutations, by)
    else:
        rows = rows.withColumn("pvalue", F.lit(None).cast("double"))
    if by:
        rows = summarize_sketches(rows, downsample_repeats, include_pvalue=n_permutations > 0)
    rows = rows.withColumn("condition", F.lit(condition if condition is not None else ""))
    return CommResult(rows, groups, groupby=groupby, condition=condition, lr_name=lr_name, pvalue_cutoff=pvalue_cutoff)


def attach_permutation_pvalues(observed: DataFrame, null: DataFrame, n: int, by: Sequence[str] = ()) -> DataFrame:
    """(#runs scoring at least the observed + 1) / (n + 1); a run without the row counts as 0."""
    keys = [*by, *PAIR_KEYS]
    seen = observed.select(*keys, F.col("prob").alias("_obs"))
    hits = null.select(*keys, F.col("prob").alias("_null")).join(seen, keys).groupBy(*keys).agg(F.count_if(reaches(F.col("_null"), F.col("_obs"))).alias("_hits"))
    out = observed.join(hits, keys, "left")
    return out.withColumn("pvalue", (F.coalesce("_hits", F.lit(0)) + 1) / F.lit(float(n + 1))).drop("_hits")


def ordered(result: CommResult) -> DataFrame:
    """Rows in display order."""
    return result.interactions.orderBy("source", "target", "pathway", F.desc("prob"))
