"""From protein tables to a predicted LR table, and on to communication, in one call."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import append_warnings
from ..model import CommResult, LRTable
from ..operators import candidates as ca
from ..operators import proteins as pr
from ..operators.saved_models import PairModel, RoleModels, load_pair_model, load_role_models
from ..operators.training import predict_protein_roles
from .communication import compute_communication


def _check_stack(model: Any, role_models: Any, bypass: bool, embedding_backend: str, density_prior: Any) -> None:
    """Refuse stand-ins for trained parts unless they are asked for."""
    problems = []
    if embedding_backend == "hash":
        problems.append("hash vectors stand in for protein embeddings")
    if not bypass and role_models == "heuristic":
        problems.append("role classifiers are not trained")
    if model == "heuristic":
        problems.append("the pair ranker is not trained")
    if not isinstance(density_prior, DataFrame):
        problems.append("the density prior is no clade-aware table")
    elif not {"clade", "species_hint"} & set(density_prior.columns):
        problems.append("the density table has neither `clade` nor `species_hint`")
    if problems:
        raise ValueError("; ".join(problems) + ". Pass `allow_fixture_models=True` only for tests or dry runs.")


def predict_lr_dbfree(
    expression: DataFrame,
    cells: DataFrame,
    proteins: DataFrame,
    embeddings: DataFrame,
    *,
    genes: DataFrame | None = None,
    species_name: str = "target_species",
    species_hint: str = "unknown",
    model: Any = "heuristic",
    pca: Any = None,
    calibrator: Any = None,
    references: DataFrame | None = None,
    role_models: Any = "heuristic",
    density_prior: DataFrame | float | str = "auto",
    embedding_backend: str = "table",
    allow_fixture_models: bool = False,
    ligand_candidates: DataFrame | None = None,
    receptor_candidates: DataFrame | None = None,
    min_score: float = 0.5,
    max_pairs: int | None = None,
    max_pairs_per_ligand: int | None = None,
    max_pairs_per_receptor: int | None = None,
    allow_low_score_density_fill: bool = False,
    allow_empty: bool = False,
    **candidate_options: Any,
) -> LRTable:
    """Roles, candidates, scores and selection. Embeddings are an input table.

    ``model`` and ``role_models`` may be saved folders (or a loaded PairModel and RoleModels). A saved ranker brings its PCA, calibrator and
    references, and its density prior where ``density_prior`` is "auto". No candidates and no pairs are errors unless ``allow_empty``.
    """
    spark = expression.sparkSession
    if isinstance(model, str) and model != "heuristic":
        model = load_pair_model(spark, model)
    if isinstance(model, PairModel):
        pca, calibrator, references = model.pca, model.calibrator, model.references
        if isinstance(density_prior, str) and density_prior == "auto" and model.density_prior is not None:
            density_prior = model.density_prior
        model = model.model
    if isinstance(role_models, str) and role_models != "heuristic":
        role_models = load_role_models(spark, role_models)
    if isinstance(role_models, RoleModels):
        role_models = role_models.models
    bypass = role_models is None
    if bypass and (ligand_candidates is None or receptor_candidates is None):
        raise ValueError("Bypassing the role model requires both `ligand_candidates` and `receptor_candidates`.")
    if not allow_fixture_models:
        _check_stack(model, role_models, bypass, embedding_backend, density_prior)
    names = genes if genes is not None else expression.select("gene").distinct()
    match = pr.match_expression_genes(names, proteins)
    counts = pr.gene_match_summary(match)
    if bypass:
        roles = ca.explicit_candidate_roles(proteins, ligand_candidates, receptor_candidates)
    else:
        roles = predict_protein_roles(proteins, embeddings, models=role_models)
    candidates = ca.generate_lr_candidates(
        expression, cells, proteins, roles, embeddings=embeddings, genes=genes, ligand_candidates=ligand_candidates, receptor_candidates=receptor_candidates, allow_empty=allow_empty, **candidate_options
    )
    scored = ca.score_lr_candidates(candidates, embeddings, model=model, pca=pca, calibrator=calibrator, references=references)
    table = ca.build_predicted_lr_table(
        scored,
        roles=roles,
        density_prior=density_prior,
        species_hint=species_hint,
        min_score=min_score,
        max_pairs=max_pairs,
        max_pairs_per_ligand=max_pairs_per_ligand,
        max_pairs_per_receptor=max_pairs_per_receptor,
        allow_low_score_density_fill=allow_low_score_density_fill,
        model_name="heuristic_fixture" if model == "heuristic" else "pair_ranker",
        name=f"dbfree_predicted_{species_name}",
        allow_empty=allow_empty,
    )
    seen = counts.first()
    notes = []
    if role_models == "heuristic":
        notes.append("heuristic_role_model")
    if bypass:
        notes.append("explicit_candidate_role_bypass")
    if embedding_backend == "hash":
        notes.append("hash_embedding_backend")
    if seen["n_expression_only_genes"]:
        notes.append("unmatched_expression_genes")
    if seen["n_protein_only_genes"]:
        notes.append("unmatched_protein_genes")
    rows = table.interactions.withColumn("warning", append_warnings("warning", notes))
    summary = table.metadata["prediction_summary"].withColumn("warning", append_warnings("warning", notes))
    summary = summary.withColumns({k: F.lit(v) for k, v in seen.asDict().items()})
    metadata = {**table.metadata, "prediction_summary": summary, "proteins": proteins, "gene_match": match, "gene_match_summary": counts, "embeddings": embeddings}
    return LRTable(rows, table.name, metadata)


def compute_dbfree_communication(
    expression: DataFrame, cells: DataFrame, groupby: str, proteins: DataFrame, embeddings: DataFrame, *, prediction: dict[str, Any] | None = None, **scoring: Any
) -> tuple[CommResult, LRTable]:
    """Predict an LR table and score it (Hill score unless told otherwise)."""
    table = predict_lr_dbfree(expression, cells, proteins, embeddings, **(prediction or {}))
    result = compute_communication(expression, cells, table, groupby, **{"score_method": "cellchat", **scoring})
    return result.with_(metadata={"lr_table": table, "prediction_summary": table.metadata["prediction_summary"], "gene_match_summary": table.metadata["gene_match_summary"]}), table
