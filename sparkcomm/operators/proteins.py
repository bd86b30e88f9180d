"""Protein tables: translation, FASTA, isoforms, gene matching, heuristic roles, hash vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import HASH_BITS
from ..functions.text import text
from ..sources.readers import read_fasta
from .ranks import first_per_key

# The standard genetic code, amino acids for the codons in TCAG order.
_BASES = "TCAG"
_AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
_VALID_PROTEIN = "^[ACDEFGHIKLMNPQRSTVWYXBZUOJ*]+$"
PROTEIN_COLUMNS = (
    "gene_id", "transcript_id", "protein_id", "cds_sequence", "protein_sequence", "cds_length", "protein_length",
    "stop_codon_count", "valid_translation", "selected_isoform",
)


def clean_dna(sequence: Column) -> Column:
    return F.regexp_replace(F.translate(F.upper(sequence), "U", "T"), "[^ACGTN]", "")


def clean_protein(sequence: Column) -> Column:
    return F.regexp_replace(F.upper(sequence), "[^A-Z*]", "")


def translate_cds(cds: Column) -> Column:
    """Protein of a clean coding sequence; unknown codons become X, a ragged end is ignored.

    A base is a digit (its place in TCAG), so a codon is a place in the amino acid string.
    """
    def place(codon: Column, i: int) -> Column:
        return F.instr(F.lit(_BASES), F.substring(codon, i, 1)) - 1

    def amino(codon: Column) -> Column:
        index = place(codon, 1) * 16 + place(codon, 2) * 4 + place(codon, 3) + 1
        return F.when(codon.contains("N"), "X").otherwise(F.substring(F.lit(_AMINO), index, F.lit(1)))

    codons = F.regexp_extract_all(cds, F.lit("(.{3})"), F.lit(1))
    return F.array_join(F.transform(codons, amino), "")


def _protein_columns(protein: Column, cds: Column, valid: Column) -> dict[str, Column]:
    bare = F.rtrim(protein, F.lit("*"))
    return {
        "cds_sequence": cds,
        "protein_sequence": bare,
        "cds_length": F.length(cds).cast("bigint"),
        "protein_length": F.length(bare).cast("bigint"),
        "stop_codon_count": (F.length(protein) - F.length(F.replace(protein, F.lit("*"), F.lit("")))).cast("bigint"),
        "valid_translation": valid,
        "selected_isoform": F.lit(False),
    }


def with_translation(df: DataFrame, sequence: str) -> DataFrame:
    """Add protein columns from a coding sequence."""
    work = df.withColumn("_cds", clean_dna(text(sequence)))
    work = work.withColumn("_aa", translate_cds(F.col("_cds")))
    cds, aa = F.col("_cds"), F.col("_aa")
    stops = F.length(aa) - F.length(F.replace(aa, F.lit("*"), F.lit("")))
    valid = (F.length(cds) > 0) & (F.length(cds) % 3 == 0) & ~cds.contains("N") & (stops <= 1) & ((stops == 0) | aa.endswith("*"))
    return work.withColumns(_protein_columns(aa, cds, valid)).drop("_cds", "_aa")


def with_protein(df: DataFrame, sequence: str) -> DataFrame:
    """Add protein columns from a protein sequence."""
    work = df.withColumn("_aa", clean_protein(text(sequence)))
    return work.withColumns(_protein_columns(F.col("_aa"), F.lit(""), F.col("_aa").rlike(_VALID_PROTEIN))).drop("_aa")


def _extract(pattern: str | None, header: Column, default: Column) -> Column:
    if pattern is None:
        return default
    found = F.regexp_extract(header, pattern, 1)
    return F.when(header.rlike(pattern), found).otherwise(default)


def _replaced(column: Column, replacements: Sequence[tuple[str, str]] | None) -> Column:
    for pattern, new in replacements or ():
        column = F.regexp_replace(column, pattern, new)
    return column


def load_cds_translations(
    spark: SparkSession,
    path: str,
    *,
    gene_id_regex: str | None = r"gene=([^\s]+)",
    transcript_id_regex: str | None = r"transcript=([^\s]+)",
    gene_id_replacements: Sequence[tuple[str, str]] | None = None,
    genetic_code: int = 1,
    select: str = "longest",
) -> DataFrame:
    if genetic_code != 1:
        raise ValueError("Only the standard genetic code (`genetic_code=1`) is supported.")
    header = F.col("header")
    ids = read_fasta(spark, path).withColumn("transcript_id", _extract(transcript_id_regex, header, F.regexp_extract(header, r"^(\S*)", 1)))
    ids = ids.withColumns({"gene_id": _replaced(_extract(gene_id_regex, header, F.col("transcript_id")), gene_id_replacements), "protein_id": F.col("transcript_id")})
    return select_isoforms(with_translation(ids, "sequence").select(*PROTEIN_COLUMNS), select)


def load_protein_fasta(
    spark: SparkSession,
    path: str,
    *,
    gene_id_regex: str | None = r"gene=([^\s]+)",
    protein_id_regex: str | None = None,
    gene_id_replacements: Sequence[tuple[str, str]] | None = None,
    select: str = "longest",
) -> DataFrame:
    header = F.col("header")
    ids = read_fasta(spark, path).withColumn("protein_id", _extract(protein_id_regex, header, F.regexp_extract(header, r"^(\S*)", 1)))
    ids = ids.withColumns({"gene_id": _replaced(_extract(gene_id_regex, header, F.col("protein_id")), gene_id_replacements), "transcript_id": F.col("protein_id")})
    return select_isoforms(with_protein(ids, "sequence").select(*PROTEIN_COLUMNS), select)


def protein_table_from_genes(
    genes: DataFrame,
    *,
    gene_id_key: str = "gene",
    protein_sequence_key: str | None = None,
    cds_sequence_key: str | None = None,
    protein_id_key: str | None = None,
    transcript_id_key: str | None = None,
    genetic_code: int = 1,
    select: str = "longest",
) -> DataFrame:
    """Protein table from a sequence column of the genes table."""
    if (protein_sequence_key is None) == (cds_sequence_key is None):
        raise ValueError("Name either `protein_sequence_key` or `cds_sequence_key`, not both and not neither.")
    if genetic_code != 1:
        raise ValueError("Only the standard genetic code (`genetic_code=1`) is supported.")
    key = protein_sequence_key or cds_sequence_key
    for c in (key, gene_id_key, protein_id_key, transcript_id_key):
        if c is not None and c not in genes.columns:
            raise KeyError(f"`{c}` is not present in the genes table.")
    gene = F.col(gene_id_key).cast("string")
    protein = F.col(protein_id_key).cast("string") if protein_id_key else gene
    transcript = F.col(transcript_id_key).cast("string") if transcript_id_key else protein
    ids = genes.where(F.trim(text(key)) != "").select(gene.alias("gene_id"), protein.alias("protein_id"), transcript.alias("transcript_id"), text(key).alias("_sequence"))
    out = with_translation(ids, "_sequence") if cds_sequence_key else with_protein(ids, "_sequence")
    return select_isoforms(out.select(*PROTEIN_COLUMNS), select)


def select_isoforms(df: DataFrame, select: str = "longest") -> DataFrame:
    """All isoforms, or per gene the best by validity, protein length and CDS length."""
    if select not in ("longest", "all"):
        raise ValueError("`select` must be one of: longest, all.")
    if select == "longest":
        order = [~F.col("valid_translation"), -F.col("protein_length"), -F.col("cds_length"), F.col("transcript_id"), F.col("protein_sequence")]
        df = first_per_key(df, ["gene_id"], order)
    return df.withColumn("selected_isoform", F.lit(True))


def match_expression_genes(expression_genes: DataFrame, proteins: DataFrame) -> DataFrame:
    """``(gene_id, in_expression, in_proteins)`` over the genes of either side."""
    a = expression_genes.select(F.col("gene").alias("gene_id")).distinct().withColumn("_e", F.lit(True))
    b = proteins.select("gene_id").distinct().withColumn("_p", F.lit(True))
    both = a.join(b, "gene_id", "full_outer")
    return both.select("gene_id", F.coalesce("_e", F.lit(False)).alias("in_expression"), F.coalesce("_p", F.lit(False)).alias("in_proteins"))


def gene_match_summary(match: DataFrame) -> DataFrame:
    e, p = F.col("in_expression"), F.col("in_proteins")
    return match.agg(
        F.count_if(e).alias("n_expression_genes"),
        F.count_if(p).alias("n_protein_genes"),
        F.count_if(e & p).alias("n_matched_genes"),
        F.count_if(e & ~p).alias("n_expression_only_genes"),
        F.count_if(~e & p).alias("n_protein_only_genes"),
    )


def prediction_proteins(proteins: DataFrame, expression_genes: DataFrame | None = None, *, restrict_to_expression: bool = False) -> DataFrame:
    if not restrict_to_expression or expression_genes is None:
        return proteins
    return proteins.join(expression_genes.select(F.col("gene").alias("gene_id")), "gene_id", "left_semi")


def match_gate(match: DataFrame, minimum: float) -> DataFrame:
    """Matched share of the expression genes and whether it reaches the minimum."""
    s = gene_match_summary(match)
    share = F.when(F.col("n_expression_genes") > 0, F.col("n_matched_genes") / F.col("n_expression_genes")).otherwise(0.0)
    return s.withColumn("matched_fraction", share).withColumn("passed", F.col("matched_fraction") >= minimum)


def heuristic_roles(proteins: DataFrame, sequence: str = "protein_sequence") -> DataFrame:
    """Role scores from length, cysteine share and hydrophobic share."""
    seq = F.upper(text(sequence))
    n = F.length(seq)
    size = F.greatest(n, F.lit(1))
    cys = (n - F.length(F.regexp_replace(seq, "C", ""))) / size
    hyd = (n - F.length(F.regexp_replace(seq, "[AILMFWYV]", ""))) / size
    clip = lambda c: F.least(F.greatest(c, F.lit(0.05)), F.lit(0.95))
    ligand, receptor = clip(F.lit(0.75) - n / 1600.0 + cys * 2.0), clip(n / 1200.0 + hyd * 0.8)
    return proteins.select(
        F.col("gene_id").cast("string").alias("gene_id"),
        F.col("protein_id").cast("string").alias("protein_id"),
        ligand.alias("ligand_like_score"),
        receptor.alias("receptor_like_score"),
        clip(ligand + cys).alias("secreted_like_score"),
        clip(receptor + hyd * 0.4).alias("membrane_like_score"),
        F.least(F.lit(0.95), cys * 3.0).alias("ecm_like_score"),
        F.lit(0.0).alias("out_of_domain_score"),
    )


def hash_embedding(sequence: Column, dim: int) -> Column:
    """Deterministic unit vector of a sequence: normal draws from hashes (Box-Muller)."""
    digest = F.md5(text(sequence).cast("binary"))
    unit = lambda i, tag: F.conv(F.substring(F.md5(F.concat_ws("|", digest, F.lit(tag), i.cast("string")).cast("binary")), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << HASH_BITS))
    draw = lambda i: F.sqrt(-2.0 * F.log(F.lit(1.0) - unit(i, "r"))) * F.cos(F.lit(6.283185307179586) * unit(i, "a"))
    values = F.transform(F.sequence(F.lit(1), F.lit(int(dim))), draw)
    norm = F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm == 0, values).otherwise(F.transform(values, lambda x: x / norm))
