"""Scoring of (source, target, ligand, receptor): gates below the join, Hill or square-root score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .expression import cofactor_products, complex_expression
from .lr_table import complex_subunits, metadata_columns
from .markers import complexes_in_sets

SCORE_METHODS = ("sqrt", "cellchat")
PAIR_KEYS = ["source", "target", "ligand", "receptor", "pathway"]


def resolve_complex_aggregate(score_method: str, complex_aggregate: str) -> str:
    if complex_aggregate not in ("auto", "min", "geometric_mean"):
        raise ValueError("`complex_aggregate` must be one of: auto, geometric_mean, min.")
    if complex_aggregate != "auto":
        return complex_aggregate
    return "geometric_mean" if score_method == "cellchat" else "min"


def sqrt_score(ligand: Column, receptor: Column) -> Column:
    return F.sqrt(ligand * receptor)


def hill_score(ligand: Column, receptor: Column, kh: float, hill: float) -> Column:
    """(LR)^h / (Kh^h + (LR)^h)."""
    signal = F.pow(ligand * receptor, F.lit(float(hill)))
    return signal / (F.lit(float(kh) ** float(hill)) + signal)


def agonist_factor(value: Column, kh: float, hill: float) -> Column:
    p = F.pow(value, F.lit(float(hill)))
    return 1 + p / (F.lit(float(kh) ** float(hill)) + p)


def antagonist_factor(value: Column, kh: float, hill: float) -> Column:
    k = F.lit(float(kh) ** float(hill))
    return k / (k + F.pow(value, F.lit(float(hill))))


def score_lr(
    lr: DataFrame,
    summary: DataFrame,
    *,
    by: Sequence[str] = (),
    min_pct: float = 0.05,
    min_expr: float = 0.0,
    score_method: str = "sqrt",
    complex_aggregate: str = "auto",
    overexpressed: DataFrame | None = None,
    weights: DataFrame | None = None,
    weights_by: Sequence[str] = (),
    pair_weights: DataFrame | None = None,
    pair_by: Sequence[str] = (),
    cofactor_adjust: bool = False,
    kh: float = 0.5,
    hill: float = 1.0,
) -> DataFrame:
    """Scored rows, finite and positive, without p-values.

    ``summary`` is ``(by, group, gene_key, expr, pct)``; ``overexpressed`` is
    ``(group, gene_key)``. The gates run on each side below the joins, which are equi joins of
    the LR rows with the complex values of either end.
    """
    if score_method not in SCORE_METHODS:
        raise ValueError(f"`score_method` must be one of: {', '.join(sorted(SCORE_METHODS))}.")
    how = resolve_complex_aggregate(score_method, complex_aggregate)
    hill_mode = score_method == "cellchat"
    subunits = complex_subunits(lr)
    values = complex_expression(summary, subunits, aggregate=how, by=by)
    if overexpressed is not None:
        values = values.join(complexes_in_sets(subunits, overexpressed), ["group", "complex"], "left_semi")

    factors: dict[str, DataFrame | None] = dict.fromkeys(("agonist_genes", "antagonist_genes", "co_A_receptor_genes", "co_I_receptor_genes"))
    if cofactor_adjust:
        v = F.col("expr")
        formulas = {
            "agonist_genes": agonist_factor(v, kh, hill),
            "antagonist_genes": antagonist_factor(v, kh, hill),
            "co_A_receptor_genes": 1 + v,
            "co_I_receptor_genes": 1 + v,
        }
        factors = {c: cofactor_products(summary, lr, c, f, by=by) if c in lr.columns else None for c, f in formulas.items()}

    extra = metadata_columns(lr)
    annotation = F.col("annotation") if "annotation" in lr.columns else F.lit("").alias("annotation")
    rows = lr.select("ligand", "receptor", "pathway", annotation, *extra)
    # used at both ends
    values = materialize(values.where(F.col("pct") >= min_pct))
    source = values.where(F.col("expr") > min_expr).select(
        *by, F.col("group").alias("source"), F.col("complex").alias("ligand"), F.col("expr").alias("ligand_expr"), F.col("pct").alias("ligand_pct")
    )
    target = values.select(*by, F.col("group").alias("target"), F.col("complex").alias("receptor"), F.col("expr").alias("receptor_expr"), F.col("pct").alias("receptor_pct"))
    adjusted = F.col("receptor_expr")
    multiplier = F.lit(1.0)
    if not (cofactor_adjust and hill_mode):
        target = target.where(F.col("receptor_expr") > min_expr)
    pairs = rows.join(source, "ligand").join(target, [*by, "receptor"])
    if cofactor_adjust:

        def factor(df: DataFrame, end: str, column: str) -> DataFrame:
            f = factors[column]
            name = f"_{end}_{column}"
            if f is None:
                return df.withColumn(name, F.lit(1.0))
            named = f.select(*by, F.col("group").alias(end), column, F.col("f").alias(name))
            return df.join(named, [*by, end, column], "left").fillna(1.0, [name])

        ends = {c: "source" for c in ("agonist_genes", "antagonist_genes")} | {c: "target" for c in ("co_A_receptor_genes", "co_I_receptor_genes")}
        for column, end in ends.items():
            pairs = factor(pairs, end, column)
        co = F.col("_target_co_A_receptor_genes") / F.col("_target_co_I_receptor_genes")
        multiplier = F.col("_source_agonist_genes") * F.col("_source_antagonist_genes")
        if hill_mode:
            # co-receptors change the receptor signal; agonists and antagonists act at both ends
            for column in ("agonist_genes", "antagonist_genes"):
                pairs = factor(pairs, "target", column)
            multiplier = multiplier * F.col("_target_agonist_genes") * F.col("_target_antagonist_genes")
            adjusted = adjusted * co
            pairs = pairs.where(adjusted > min_expr)
        else:
            multiplier = multiplier * co
    ligand = F.col("ligand_expr")
    prob = (hill_score(ligand, adjusted, kh, hill) if hill_mode else sqrt_score(ligand, adjusted)) * multiplier
    if weights is not None:
        for end in ("source", "target"):
            w = weights.select(*weights_by, F.col("group").alias(end), F.col("weight").alias(f"_w_{end}"))
            pairs = pairs.join(w, [*weights_by, end])
        both = F.col("_w_source") * F.col("_w_target")
        prob = prob * (both if hill_mode else F.sqrt(both))
    if pair_weights is not None:
        pairs = pairs.join(pair_weights, [*pair_by, "source", "target"])
        prob = prob * F.col("pair_weight")
    out = pairs.withColumn("prob", prob).where((F.col("prob") > 0) & (F.col("prob") < float("inf")) & ~F.isnan("prob"))
    return out.select(
        *by, "source", "target", "ligand", "receptor", "pathway", "annotation", "ligand_expr", "receptor_expr", "ligand_pct", "receptor_pct", "prob", *extra
    )
