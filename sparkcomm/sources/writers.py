"""Table sinks for results, comparisons and validation reports."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import interaction_name, text
from ..model import CommResult, DiffResult, SpatialReport
from ..operators.lr_table import metadata_columns
from ..operators.ranks import first_per_key


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def bridge_lr_table(interactions: DataFrame, lr: DataFrame | None = None) -> DataFrame:
    """LR rows with interaction names, one row per name."""
    if lr is None:
        keys = ["ligand", "receptor", "pathway"]
        extra = [c for c in ("annotation", "evidence") if c in interactions.columns]
        # the first value in row order, as the groups of the table have none of their own
        lr = interactions.groupBy(*keys).agg(*[F.min(c).alias(c) for c in extra]) if extra else interactions.select(*keys).distinct()
    for c in ("annotation", "evidence"):
        lr = lr.withColumn(c, text(c) if c in lr.columns else F.lit(""))
    if "interaction_name" not in lr.columns:
        lr = lr.withColumn("interaction_name", interaction_name())
    if "interaction_name_2" not in lr.columns:
        lr = lr.withColumn("interaction_name_2", F.concat_ws(" - ", "ligand", "receptor"))
    extra = [c for c in metadata_columns(lr) if c not in ("evidence", "interaction_name", "interaction_name_2")]
    lr = lr.select("interaction_name", "interaction_name_2", F.col("pathway").alias("pathway_name"), "ligand", "receptor", "annotation", "evidence", *extra)
    return first_per_key(lr, ["interaction_name"], [F.col(c) for c in lr.columns if c != "interaction_name"])


def bridge_interactions(interactions: DataFrame, lr: DataFrame, *, pvalue_default: float = 0.0) -> DataFrame:
    """Interactions with the names of their LR rows; a missing p-value gets the default."""
    names = lr.select(
        "ligand", "receptor", F.col("pathway_name").alias("pathway"), "interaction_name", "interaction_name_2", F.col("annotation").alias("_a"), F.col("evidence").alias("_e")
    )
    names = first_per_key(names, ["ligand", "receptor", "pathway"], ["interaction_name"])
    rows = interactions.drop("interaction_name", "interaction_name_2").join(names, ["ligand", "receptor", "pathway"], "left")
    own = lambda c: text(c) if c in interactions.columns else F.lit("")
    pvalue = F.col("pvalue").cast("double") if "pvalue" in interactions.columns else F.lit(None).cast("double")
    return rows.select(
        "source",
        "target",
        F.coalesce("interaction_name", interaction_name()).alias("interaction_name"),
        F.coalesce("interaction_name_2", F.concat_ws(" - ", "ligand", "receptor")).alias("interaction_name_2"),
        F.col("pathway").alias("pathway_name"),
        "ligand",
        "receptor",
        F.coalesce(F.col("prob").cast("double"), F.lit(0.0)).alias("prob"),
        F.coalesce(pvalue, F.lit(float(pvalue_default))).alias("pval"),
        F.when(F.col("interaction_name").isNotNull(), F.col("_a")).otherwise(own("annotation")).alias("annotation"),
        F.when(F.col("interaction_name").isNotNull(), F.col("_e")).otherwise(own("evidence")).alias("evidence"),
    )


def bridge_groups(groups: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Groups with at least one cell each."""
    if sizes is None:
        return groups.select("group", F.lit(1).cast("bigint").alias("n_cells"))
    joined = groups.select("group").join(sizes.select("group", F.col("n_cells").cast("bigint").alias("n_cells")), "group", "left")
    return joined.select("group", F.greatest(F.coalesce("n_cells", F.lit(1)), F.lit(1)).alias("n_cells"))


def export_bridge_tables(
    result: CommResult, folder: str, *, lr: DataFrame | None = None, group_sizes: DataFrame | None = None, pvalue_default: float = 0.0
) -> None:
    names = bridge_lr_table(result.interactions, lr)
    write_tsv(bridge_interactions(result.interactions, names, pvalue_default=pvalue_default), f"{folder}/interactions")
    write_tsv(names, f"{folder}/lr")
    write_tsv(bridge_groups(result.groups, group_sizes), f"{folder}/groups")
    about = [("groupby", result.groupby), ("condition", result.condition or ""), ("lr_name", result.lr_name), ("pvalue_cutoff", str(result.pvalue_cutoff))]
    write_tsv(result.interactions.sparkSession.createDataFrame(about, "key string, value string"), f"{folder}/metadata")


def safe_dir_name(label: str) -> str:
    cleaned = "".join(ch if ch.isalnum() or ch in "_-." else "_" for ch in label.strip())
    return cleaned.strip("._-")


def sample_folders(label_a: str, label_b: str) -> tuple[str, str]:
    a, b = safe_dir_name(label_a) or "sample_a", safe_dir_name(label_b) or "sample_b"
    return (f"{a}_a", f"{b}_b") if a == b else (a, b)


def export_bridge_merged(diff: DiffResult, folder: str, *, lr: DataFrame | None = None, sizes_a: DataFrame | None = None, sizes_b: DataFrame | None = None) -> None:
    dir_a, dir_b = sample_folders(diff.label_a, diff.label_b)
    export_bridge_tables(diff.a, f"{folder}/{dir_a}", lr=lr, group_sizes=sizes_a)
    export_bridge_tables(diff.b, f"{folder}/{dir_b}", lr=lr, group_sizes=sizes_b)
    spark = diff.interactions.sparkSession
    samples = [("a", diff.label_a, dir_a), ("b", diff.label_b, dir_b)]
    write_tsv(spark.createDataFrame(samples, "role string, label string, directory string"), f"{folder}/samples")
    write_tsv(diff.interactions, f"{folder}/diff_interactions")
    write_tsv(diff.pathway_changes, f"{folder}/diff_pathways")
    write_tsv(diff.source_target_changes, f"{folder}/diff_source_targets")
    write_tsv(diff.networks.select("source", "target", "network_delta"), f"{folder}/network_delta")
    write_tsv(diff.networks.select("source", "target", "count_delta"), f"{folder}/count_delta")


def with_context(df: DataFrame, context: Mapping[str, object]) -> DataFrame:
    """Constant columns in front of a table."""
    return df.select(*[F.lit(v).alias(k) for k, v in context.items()], *[c for c in df.columns if c not in context])


def report_tables(report: SpatialReport, context: Mapping[str, object], *, pair_summary: bool = True, null_distribution: bool = True) -> dict[str, DataFrame]:
    """Named tables of a report; the two large ones can be left empty."""
    tables = {
        "summary": report.summary,
        "celltype_pair_summary": report.celltype_pair_summary if pair_summary else report.celltype_pair_summary.limit(0),
        "null_distribution": report.null_distribution if null_distribution or report.null_distribution is None else report.null_distribution.limit(0),
        "top_k_enrichment": report.top_k_enrichment,
        "role_kernel_enrichment": report.role_kernel_enrichment,
        "distance_decay": report.distance_decay,
        "section_reproducibility": report.section_reproducibility,
    }
    return {name: with_context(df, context) for name, df in tables.items() if df is not None}


def write_report_tables(report: SpatialReport, folder: str, context: Mapping[str, object], *, fmt: str = "tsv", **switches: bool) -> list[str]:
    written = []
    for name, df in report_tables(report, context, **switches).items():
        path = f"{folder}/{re.sub('[^a-z_]', '', name)}"
        if fmt == "tsv":
            write_tsv(df, path)
        else:
            df.write.mode("overwrite").parquet(path)
        written.append(name)
    return written
