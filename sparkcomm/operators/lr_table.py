"""Ligand-receptor tables: column names, cleaning, filters, complexes, genes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import blank_to_null, complex_genes, first_present, text, tokens
from .ranks import first_per_key

# Column names other tools use for the same field, in order of preference.
LR_ALIASES = {
    "ligand": ("ligand", "ligand_symbol", "ligand_gene", "source_genesymbol", "source_gene", "source"),
    "receptor": ("receptor", "receptor_symbol", "receptor_gene", "target_genesymbol", "target_gene", "target"),
    "pathway": ("pathway", "pathway_name", "signaling_pathway", "signaling"),
    "annotation": ("annotation", "category", "source_database", "database", "resource", "resources", "sources"),
    "evidence": ("evidence", "reference", "references", "pmid", "pubmed"),
}
RESOURCE_COLUMNS = ("resources", "sources", "database", "databases", "omnipath_sources")
COFACTOR_COLUMNS = ("agonist_genes", "antagonist_genes", "co_A_receptor_genes", "co_I_receptor_genes")
CORE_COLUMNS = ("ligand", "receptor", "pathway", "annotation")


def canonicalize_lr_columns(df: DataFrame, column_map: Mapping[str, str] | None = None) -> DataFrame:
    """Add the canonical columns; explicit names win, then the first alias present."""
    for name, column in (column_map or {}).items():
        if column not in df.columns:
            raise ValueError(f"Column `{column}` was requested for `{name}` but is not present.")
        df = df.withColumn(name, F.col(column))
    for name, aliases in LR_ALIASES.items():
        if name not in df.columns:
            found = first_present(df.columns, aliases)
            if found is not None:
                df = df.withColumn(name, F.col(found))
    return df


def normalize_lr_table(
    df: DataFrame, *, column_map: Mapping[str, str] | None = None, order: str | None = None, check: bool = True
) -> DataFrame:
    """Trim, drop blank rows, fill defaults and keep the first row per (ligand, receptor, pathway).

    ``order`` names an input-order column; without it "first" is the smallest row. ``check``
    looks for at least one row (a job); inside a larger plan it can be left out.
    """
    df = canonicalize_lr_columns(df, column_map)
    missing = [c for c in ("ligand", "receptor") if c not in df.columns]
    if missing:
        raise ValueError(f"These columns of the LR table are absent: {missing}")
    out = df.withColumns({c: F.trim(F.col(c).cast("string")) for c in ("ligand", "receptor")})
    out = out.where((F.col("ligand") != "") & (F.col("receptor") != ""))
    defaults = {"pathway": "unknown", "annotation": "", "evidence": ""}
    out = out.withColumns(
        {c: F.coalesce(F.col(c).cast("string"), F.lit(d)) if c in df.columns else F.lit(d) for c, d in defaults.items()}
    )
    keys = ["ligand", "receptor", "pathway"]
    rest = [c for c in out.columns if c not in keys and c != order]
    out = first_per_key(out, keys, ([F.col(order)] if order else []) + [F.col(c) for c in rest])
    if check and out.isEmpty():
        raise ValueError("Not one row of the LR table names both a ligand and a receptor.")
    return out


def filter_lr_table(
    df: DataFrame,
    *,
    annotation: str | Sequence[str] | None = None,
    pathways: str | Sequence[str] | None = None,
    resources: str | Sequence[str] | None = None,
    check: bool = True,
) -> DataFrame:
    out = df
    if annotation is not None:
        out = out.where(F.col("annotation").isin(as_list(annotation)))
    if pathways is not None:
        out = out.where(F.col("pathway").isin(as_list(pathways)))
    if resources is not None:
        columns = [c for c in RESOURCE_COLUMNS if c in df.columns]
        if not columns:
            raise ValueError("Resources cannot be chosen: no column names them.")
        wanted = F.array(*[F.lit(v) for v in as_list(resources)])
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.arrays_overlap(tokens(c, "[;,]"), wanted)
        out = out.where(hit)
    if check and out.isEmpty():
        raise ValueError("The filter leaves no row of the LR table.")
    return out


def as_list(value: str | Sequence[str] | None) -> list[str]:
    if value is None:
        return []
    return [value] if isinstance(value, str) else [str(v) for v in value]


def _parts_table(table: DataFrame, key: str) -> DataFrame:
    parts = [blank_to_null(F.col(c).cast("string")) for c in table.columns if c != key]
    return table.select(F.trim(F.col(key).cast("string")).alias("_name"), F.concat_ws("_", *parts).alias("_parts"))


def expand_complex(df: DataFrame, column: str, complexes: DataFrame, *, key: str = "name", into: str | None = None) -> DataFrame:
    """Replace complex names by their subunits joined with ``_``; other names stay."""
    name = F.trim(text(column))
    joined = df.join(_parts_table(complexes, key), name == F.col("_name"), "left")
    return joined.withColumn(into or column, F.coalesce("_parts", name)).drop("_name", "_parts")


def expand_cofactor(df: DataFrame, column: str, cofactors: DataFrame, *, key: str = "name", into: str | None = None) -> DataFrame:
    """As :func:`expand_complex`, but an unknown or blank name becomes the empty string."""
    joined = df.join(_parts_table(cofactors, key), F.trim(text(column)) == F.col("_name"), "left")
    return joined.withColumn(into or column, F.coalesce("_parts", F.lit(""))).drop("_name", "_parts")


def gene_lookup(genes: DataFrame, *, order: str | None = None) -> DataFrame:
    """``gene_key`` (upper case) to the gene it stands for; the last spelling wins."""
    rank = F.col(order) if order else F.col("gene")
    return genes.groupBy(F.upper("gene").alias("gene_key")).agg(F.max_by("gene", rank).alias("gene"))


def complex_subunits(lr: DataFrame, columns: Sequence[str] = ("ligand", "receptor")) -> DataFrame:
    """Each distinct complex once: ``complex, gene_key, n_subunits`` (one row per subunit place)."""
    names = F.array(*[text(c) for c in columns if c in lr.columns])
    distinct = lr.select(F.explode(names).alias("complex")).distinct()
    parts = distinct.withColumn("_g", complex_genes("complex"))
    return parts.select("complex", F.size("_g").alias("n_subunits"), F.explode("_g").alias("_g")).select(
        "complex", F.upper("_g").alias("gene_key"), "n_subunits"
    )


def filter_lr_to_genes(lr: DataFrame, genes: DataFrame) -> DataFrame:
    """Rows whose every subunit on both sides is a known gene, ignoring case."""
    known = genes.select(F.upper("gene").alias("gene_key")).distinct().withColumn("_known", F.lit(1))
    complete = (
        complex_subunits(lr)
        .join(known, "gene_key", "left")
        .groupBy("complex")
        .agg(F.count("_known").alias("_have"), F.first("n_subunits").alias("_need"))
        .where(F.col("_have") == F.col("_need"))
        .select("complex")
    )
    return lr.join(complete, lr["ligand"] == complete["complex"], "left_semi").join(
        complete.withColumnRenamed("complex", "_c"), F.col("receptor") == F.col("_c"), "left_semi"
    )


def lr_expression_genes(lr: DataFrame, *, include_cofactors: bool = False) -> DataFrame:
    """Distinct ``gene_key`` values the scoring needs."""
    columns = ["ligand", "receptor"] + ([c for c in COFACTOR_COLUMNS if c in lr.columns] if include_cofactors else [])
    return complex_subunits(lr, columns).select("gene_key").distinct()


def metadata_columns(lr: DataFrame) -> list[str]:
    """Extra string columns that travel with the scored rows."""
    return [f.name for f in lr.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in CORE_COLUMNS]


def pair_key(ligand: str = "ligand", receptor: str = "receptor") -> Column:
    return F.struct(F.col(ligand).alias("ligand"), F.col(receptor).alias("receptor"))
