"""Summary of scores over repeated sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scoring import PAIR_KEYS


def summarize_sketches(scored: DataFrame, repeats: int, *, include_pvalue: bool = False) -> DataFrame:
    """Mean over all sketches (absent = 0), spread, stability; expression over present sketches only."""
    n = F.lit(float(repeats))
    passed = {"repeat", "prob", "pvalue", "annotation", "ligand_expr", "receptor_expr", "ligand_pct", "receptor_pct", *PAIR_KEYS}
    extra = [c for c in scored.columns if c not in passed]
    out = scored.groupBy(*PAIR_KEYS).agg(
        F.min_by("annotation", "repeat").alias("annotation"),
        *[F.avg(c).alias(c) for c in ("ligand_expr", "receptor_expr", "ligand_pct", "receptor_pct")],
        (F.sum("prob") / n).alias("prob"),
        F.sum(F.col("prob") * F.col("prob")).alias("_sq"),
        F.count(F.lit(1)).alias("sketch_present"),
        *([F.sum("pvalue").alias("_p")] if include_pvalue else []),
        *[F.min_by(c, "repeat").alias(c) for c in extra],
    )
    spread = F.sqrt(F.greatest((F.col("_sq") - n * F.col("prob") * F.col("prob")) / F.lit(float(max(repeats - 1, 1))), F.lit(0.0)))
    pvalue = (F.coalesce("_p", F.lit(0.0)) + (n - F.col("sketch_present"))) / n if include_pvalue else F.lit(None).cast("double")
    out = out.withColumns(
        {
            "prob_std": spread if repeats > 1 else F.lit(0.0),
            "stability": F.col("sketch_present") / n,
            "sketch_repeats": F.lit(repeats).cast("bigint"),
            "pvalue": pvalue,
        }
    )
    return out.drop("_sq", "_p")
