"""Result containers: named DataFrames plus option scalars."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LRTable:
    """A ligand-receptor table and the tables that belong to it."""

    interactions: DataFrame
    name: str = "custom"
    metadata: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class CommResult:
    """Scored interactions with the groups they were scored over."""

    interactions: DataFrame
    groups: DataFrame
    groupby: str = "group"
    condition: str | None = None
    lr_name: str = "custom"
    pvalue_cutoff: float = 0.05
    metadata: dict[str, Any] = field(default_factory=dict)

    def significant(self, pvalue_cutoff: float | None = None) -> DataFrame:
        """Rows at or below the cutoff; rows without a p-value drop, no column keeps all."""
        if "pvalue" not in self.interactions.columns:
            return self.interactions
        cutoff = self.pvalue_cutoff if pvalue_cutoff is None else pvalue_cutoff
        return self.interactions.where(F.col("pvalue") <= cutoff)

    def rows(self, significant_only: bool = False) -> DataFrame:
        return self.significant() if significant_only else self.interactions

    def network(
        self,
        *,
        value: str = "prob",
        pathway: str | Iterable[str] | None = None,
        significant_only: bool = False,
        pvalue_cutoff: float | None = None,
    ) -> DataFrame:
        """``(source, target, value)`` over all pairs of groups, 0 where nothing was scored."""
        from .operators.summaries import network

        return network(self, value=value, pathway=pathway, significant_only=significant_only, pvalue_cutoff=pvalue_cutoff)

    def pathway_summary(self, *, significant_only: bool = False) -> DataFrame:
        from .operators.summaries import summarize

        return summarize(self.rows(significant_only), ["pathway"]).orderBy(F.desc("prob"), F.desc("count"))

    def lr_summary(self, *, significant_only: bool = False) -> DataFrame:
        from .operators.summaries import summarize

        keys = ["ligand", "receptor", "pathway"]
        return summarize(self.rows(significant_only), keys).orderBy(F.desc("prob"), F.desc("count"))

    def with_(self, **changes: Any) -> CommResult:
        return replace(self, **changes)


@dataclass(frozen=True)
class DiffResult:
    """Two results and their difference; ``a`` is the new condition."""

    a: CommResult
    b: CommResult
    label_a: str
    label_b: str
    interactions: DataFrame
    networks: DataFrame
    pathway_changes: DataFrame
    source_target_changes: DataFrame

    @property
    def groups(self) -> DataFrame:
        return self.a.groups

    def differential_network(self, *, measure: str = "weight") -> DataFrame:
        if measure in ("weight", "prob"):
            return self.networks.select("source", "target", "network_a", "network_b", "network_delta")
        if measure == "count":
            return self.networks.select("source", "target", "count_a", "count_b", "count_delta")
        raise ValueError("`measure` must be one of: 'weight', 'prob', or 'count'.")


@dataclass(frozen=True)
class PatternResult:
    """Factors of the group x pathway matrix in long form."""

    mode: str
    n_patterns: int
    matrix: DataFrame
    group_pattern: DataFrame
    pathway_pattern: DataFrame
    reconstruction_error: DataFrame


@dataclass(frozen=True)
class TrainingTable:
    interactions: DataFrame
    proteins: DataFrame | None
    positive_evidence: tuple[str, ...]
    stage_counts: DataFrame


@dataclass(frozen=True)
class SpatialReport:
    summary: DataFrame
    celltype_pair_summary: DataFrame
    null_distribution: DataFrame
    distance_decay: DataFrame | None
    section_reproducibility: DataFrame | None
    top_k_enrichment: DataFrame
    role_kernel_enrichment: DataFrame | None
    curated_overlap_enrichment: DataFrame | None
    metadata: dict[str, Any] = field(default_factory=dict)
