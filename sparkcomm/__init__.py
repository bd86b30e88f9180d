"""Communication analytics between labelled groups, as Spark jobs over long tables."""

from .model import CommResult, DiffResult, LRTable, PatternResult, SpatialReport, TrainingTable
from .operators.candidates import (
    build_predicted_lr_table,
    estimate_lr_density_prior,
    evaluate_predicted_lr_density_prior,
    generate_lr_candidates,
    make_lr_pair_features,
    score_lr_candidates,
)
from .operators.diff import compare_communication, signaling_changes
from .operators.expression_tables import select_signaling_genes, signaling_expression_frame, signaling_expression_values
from .operators.lr_table import filter_lr_table, normalize_lr_table
from .operators.markers import identify_overexpressed_genes, identify_overexpressed_interactions
from .operators.patterns import (
    communication_pattern_matrix,
    compute_communication_patterns,
    compute_pathway_clusters,
    compute_pathway_embedding,
    compute_pathway_similarity,
    pairwise_pathway_embedding,
    rank_pathway_similarity,
    select_communication_pattern_number,
)
from .operators.proteins import load_cds_translations, load_protein_fasta, match_expression_genes, protein_table_from_genes
from .operators.ranking import quality_gates
from .operators.resources import build_lr_training_table, load_training_lr_resources, training_lr_to_lr_table
from .operators.saved_models import PairModel, RoleModels, load_pair_model, load_role_models, pair_model, train_protein_role_models
from .operators.summaries import compute_pathway_communication
from .operators.training import predict_protein_roles, train_lr_link_predictor, train_role_classifiers
from .plans.communication import compute_communication
from .plans.compare import compare_samples
from .plans.dbfree import compute_dbfree_communication, predict_lr_dbfree
from .plans.validation import validate_spatial_lr_table
from .sources.readers import from_rank_aggregate_results, load_lr_table, lr_from_db_tables, lr_from_intercell, read_expression_mtx
from .sources.writers import export_bridge_merged, export_bridge_tables

__all__ = [
    "CommResult", "DiffResult", "LRTable", "PairModel", "PatternResult", "RoleModels", "SpatialReport", "TrainingTable",
    "build_lr_training_table", "build_predicted_lr_table", "communication_pattern_matrix", "compare_communication", "compare_samples",
    "compute_communication", "compute_communication_patterns", "compute_dbfree_communication", "compute_pathway_clusters",
    "compute_pathway_communication", "compute_pathway_embedding", "compute_pathway_similarity", "estimate_lr_density_prior",
    "evaluate_predicted_lr_density_prior", "export_bridge_merged", "export_bridge_tables", "filter_lr_table", "from_rank_aggregate_results",
    "generate_lr_candidates", "identify_overexpressed_genes", "identify_overexpressed_interactions", "load_cds_translations", "load_lr_table",
    "load_pair_model", "load_protein_fasta", "load_role_models", "pair_model", "train_protein_role_models", "load_training_lr_resources", "lr_from_db_tables", "lr_from_intercell", "make_lr_pair_features", "match_expression_genes",
    "normalize_lr_table", "pairwise_pathway_embedding", "predict_lr_dbfree", "predict_protein_roles", "protein_table_from_genes", "quality_gates",
    "rank_pathway_similarity", "read_expression_mtx", "score_lr_candidates", "select_communication_pattern_number", "select_signaling_genes",
    "signaling_changes", "signaling_expression_frame", "signaling_expression_values", "train_lr_link_predictor", "train_role_classifiers",
    "training_lr_to_lr_table", "validate_spatial_lr_table",
]
