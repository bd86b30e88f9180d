"""Two samples scored and compared."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from ..model import DiffResult, LRTable
from ..operators.diff import align_results, compare_communication
from .communication import compute_communication


def compare_samples(
    a: tuple[DataFrame, DataFrame],
    b: tuple[DataFrame, DataFrame],
    lr_table: LRTable | DataFrame,
    groupby: str,
    *,
    label_a: str = "sample_a",
    label_b: str = "sample_b",
    align_groups: str = "union",
    pseudocount: float = 1e-9,
    significant_only: bool = False,
    check: bool = True,
    **options: Any,
) -> DiffResult:
    """``a`` and ``b`` are ``(expression, cells)``; further options go to the scoring of both."""
    if align_groups not in ("union", "intersection", "strict"):
        raise ValueError("`align_groups` must be one of: 'union', 'intersection', or 'strict'.")
    results = []
    for (expression, cells), label in ((a, label_a), (b, label_b)):
        extra = {} if {"condition", "condition_key"} & set(options) else {"condition": label}
        results.append(compute_communication(expression, cells, lr_table, groupby, check=check, **{**extra, **options}))
    left, right = align_results(*results, mode=align_groups, check=check)
    return compare_communication(
        left, right, label_a=label_a, label_b=label_b, pseudocount=pseudocount, significant_only=significant_only, check=check and align_groups == "strict"
    )
