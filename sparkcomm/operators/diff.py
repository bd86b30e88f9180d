"""Comparison of two results; ``a`` is the new condition, ``b`` the reference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import interaction_label
from ..model import CommResult, DiffResult
from .ranks import running_totals, top_per_key, value_bucket
from .scoring import PAIR_KEYS
from .summaries import keep_top, network, summarize, with_labels

VALUES = ("prob", "pvalue", "ligand_expr", "receptor_expr", "prob_std", "stability", "sketch_present", "sketch_repeats")
FILLED = ("prob_a", "prob_b", "ligand_expr_a", "ligand_expr_b", "receptor_expr_a", "receptor_expr_b")


def direction(delta: Column, label_a: str, label_b: str) -> Column:
    return F.when(delta > 0, label_a).when(delta < 0, label_b).otherwise("unchanged")


def merge_interactions(left: DataFrame, right: DataFrame, *, label_a: str, label_b: str, pseudocount: float = 1e-9) -> DataFrame:
    """Full outer join on the five keys with differences of the scores."""

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select(*PAIR_KEYS, *[F.col(c).alias(f"{c}_{tag}") for c in VALUES if c in df.columns])

    out = side(left, "a").join(side(right, "b"), PAIR_KEYS, "full_outer")
    for c in ("pvalue_a", "pvalue_b"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("double"))
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) if c in out.columns else F.lit(0.0) for c in FILLED})
    a, b = F.col("prob_a"), F.col("prob_b")
    return out.withColumns(
        {
            "delta_prob": a - b,
            "abs_delta_prob": F.abs(a - b),
            "log2fc": F.log2((a + pseudocount) / (b + pseudocount)),
            "percent_change": (a - b) / (F.abs(b) + pseudocount),
            "is_new": (a > 0) & (b <= 0),
            "is_lost": (a <= 0) & (b > 0),
            "direction": direction(a - b, label_a, label_b),
        }
    )


def summarize_changes(merged: DataFrame, keys: Sequence[str], *, label_a: str, label_b: str, pseudocount: float = 1e-9) -> DataFrame:
    out = merged.groupBy(*keys).agg(
        F.sum("prob_a").alias("prob_a"),
        F.sum("prob_b").alias("prob_b"),
        F.count_if(F.col("prob_a") > 0).alias("count_a"),
        F.count_if(F.col("prob_b") > 0).alias("count_b"),
        F.count_if("is_new").alias("new_count"),
        F.count_if("is_lost").alias("lost_count"),
    )
    a, b = F.col("prob_a"), F.col("prob_b")
    return out.withColumns(
        {
            "delta_prob": a - b,
            "abs_delta_prob": F.abs(a - b),
            "log2fc": F.log2((a + pseudocount) / (b + pseudocount)),
            "delta_count": F.col("count_a") - F.col("count_b"),
            "direction": direction(a - b, label_a, label_b),
        }
    )


def compare_communication(
    a: CommResult,
    b: CommResult,
    *,
    label_a: str | None = None,
    label_b: str | None = None,
    pseudocount: float = 1e-9,
    significant_only: bool = False,
    check: bool = True,
) -> DiffResult:
    if check:
        missing = a.groups.select("group").exceptAll(b.groups.select("group"))
        extra = b.groups.select("group").exceptAll(a.groups.select("group"))
        if not missing.unionByName(extra).isEmpty():
            raise ValueError("Results must have identical cell groups for comparison.")
    label_a = label_a or a.condition or "condition_a"
    label_b = label_b or b.condition or "condition_b"
    labels = {"label_a": label_a, "label_b": label_b, "pseudocount": pseudocount}
    merged = merge_interactions(a.rows(significant_only), b.rows(significant_only), **labels)

    def net(result: CommResult, value: str, name: str) -> DataFrame:
        return network(result, value=value, significant_only=significant_only).withColumnRenamed("value", name)

    grid = net(a, "prob", "network_a")
    for result, value, name in ((b, "prob", "network_b"), (a, "count", "count_a"), (b, "count", "count_b")):
        grid = grid.join(net(result, value, name), ["source", "target"])
    grid = grid.withColumns({"network_delta": F.col("network_a") - F.col("network_b"), "count_delta": F.col("count_a") - F.col("count_b")})
    return DiffResult(
        a, b, label_a, label_b, merged, grid, summarize_changes(merged, ["pathway"], **labels), summarize_changes(merged, ["source", "target"], **labels)
    )


def align_results(a: CommResult, b: CommResult, mode: str = "union", *, check: bool = True) -> tuple[CommResult, CommResult]:
    """Give both results one list of groups: all, the shared ones, or insist they match."""
    if mode == "strict":
        return a, b
    ga, gb = a.groups.select("group"), b.groups.select("group")
    if mode == "union":
        groups = ga.union(gb).distinct()
        return a.with_(groups=groups), b.with_(groups=groups)
    if mode == "intersection":
        groups = ga.intersect(gb)
        if check and len(groups.take(2)) < 2:
            raise ValueError("At least two groups must be common to both results to align them by intersection.")

        def cut(result: CommResult) -> CommResult:
            rows = result.interactions
            for end in ("source", "target"):
                rows = rows.join(groups.select(F.col("group").alias(end)), end, "left_semi")
            return result.with_(groups=groups, interactions=rows)

        return cut(a), cut(b)
    raise ValueError("`align_groups` must be one of: 'union', 'intersection', or 'strict'.")


def signaling_changes(
    diff: DiffResult, group: str, *, pathways: Sequence[str] | None = None, exclude_pathways: Sequence[str] | None = None
) -> DataFrame:
    """Outgoing and incoming change per pathway for one group."""
    df = diff.interactions
    if pathways is not None:
        df = df.where(F.col("pathway").isin(list(pathways)))
    if exclude_pathways is not None:
        df = df.where(~F.col("pathway").isin(list(exclude_pathways)))

    def total(end: str, tag: str) -> Column:
        return F.sum(F.when(F.col(end) == group, F.col(f"prob_{tag}")).otherwise(0.0))

    out = df.groupBy("pathway").agg(
        *[total(end, tag).alias(f"{role}_{tag}") for role, end in (("outgoing", "source"), ("incoming", "target")) for tag in "ab"]
    )
    out = out.withColumns({f"delta_{r}": F.col(f"{r}_a") - F.col(f"{r}_b") for r in ("outgoing", "incoming")})
    total_delta = F.col("delta_outgoing") + F.col("delta_incoming")
    return out.withColumns(
        {
            "delta_total": total_delta,
            "abs_delta_total": F.abs("delta_outgoing") + F.abs("delta_incoming"),
            "direction": direction(total_delta, diff.label_a, diff.label_b),
        }
    )


def rank_signaling_compare(diff: DiffResult, *, level: str = "pathway", top_n: int | None = 30) -> DataFrame:
    """Total strength per pathway or LR label in both conditions, largest totals first."""
    if level == "pathway":
        key = "pathway"
        sides = [summarize(r.interactions, ["pathway"]) for r in (diff.a, diff.b)]
    elif level in ("lr", "interaction"):
        key = "interaction"
        sides = []
        for r in (diff.a, diff.b):
            # labels of the LR summary, which carries no given names
            lr = summarize(r.interactions, ["ligand", "receptor", "pathway"])
            sides.append(lr.withColumn("interaction", interaction_label(lr.columns)).groupBy("interaction").agg(F.sum("prob").alias("prob")))
    else:
        raise ValueError("`level` must be 'pathway' or 'lr'.")
    a, b = (s.select(key, F.col("prob").alias(f"prob_{t}")) for s, t in zip(sides, "ab"))
    out = a.join(b, key, "full_outer").fillna(0.0).withColumn("total", F.col("prob_a") + F.col("prob_b"))
    return out if top_n is None else out.orderBy(F.round("total", 9).desc(), key).limit(top_n)


def diff_rank(changes: DataFrame, *, measure: str = "weight", top_n: int = 20, key: Sequence[str] = ("pathway",)) -> DataFrame:
    """Largest non-zero changes by size, to be shown in order of the change."""
    column = {"weight": "delta_prob", "prob": "delta_prob", "count": "delta_count"}.get(measure)
    if column is None:
        raise ValueError("`measure` must be one of: 'weight', 'prob', or 'count'.")
    top = changes.where(F.col(column) != 0).orderBy(F.round(F.abs(column), 9).desc(), *key).limit(top_n)
    return top.orderBy(column, *key)


def compare_interactions(diff: DiffResult, *, value: str = "weight") -> DataFrame:
    """Total weight or number of interactions per condition."""
    if value not in ("weight", "prob", "count"):
        raise ValueError("`value` must be 'count' or 'weight'.")
    kind = "count" if value == "count" else "network"
    sums = diff.networks.agg(F.sum(f"{kind}_a").alias("a"), F.sum(f"{kind}_b").alias("b"))
    pair = F.array(
        F.struct(F.lit(diff.label_a).alias("condition"), F.col("a").alias("value")),
        F.struct(F.lit(diff.label_b).alias("condition"), F.col("b").alias("value")),
    )
    return sums.select(F.inline(pair))


def diff_top_pairs(diff: DiffResult, top_pairs: int) -> DataFrame:
    return keep_top(with_labels(diff.interactions), "pair", top_pairs, "abs_delta_prob")


def scaled_information_flow(df: DataFrame, keys: Sequence[str], value: str, into: str, order: Sequence[str]) -> DataFrame:
    """-1/ln(p) per row of a key; values of 1 and more, which it cannot scale, are spread
    evenly over 1.1 to 1.5 times the largest scaled value, in their own order."""
    p = F.col(value)
    good = (p > 0) & (p < 1)
    flow = F.when(good, -1.0 / F.log(p)).otherwise(0.0)
    work = df.withColumn("_flow", flow).withColumn("_bad", p >= 1)
    stats = work.groupBy(*keys).agg(F.max("_flow").alias("_top"), F.count_if("_bad").alias("_m"))
    ranked = running_totals(work, keys, [p, *[F.col(c) for c in order]], value_bucket(p), {"_before": F.col("_bad").cast("int").cast("bigint")})
    out = ranked.join(stats, list(keys))
    top = F.when(F.col("_top") > 0, F.col("_top")).otherwise(1.0)
    step = F.when(F.col("_m") > 1, F.lit(0.4) * F.col("_before") / (F.col("_m") - 1)).otherwise(0.0)
    return out.withColumn(into, F.when(F.col("_bad"), top * (F.lit(1.1) + step)).otherwise(F.col("_flow"))).drop("_flow", "_bad", "_top", "_m", "_before")


def information_flow(diff: DiffResult, *, top_n: int | None = None) -> DataFrame:
    """Scaled flow per pathway in both conditions and the share of each."""
    merged = rank_signaling_compare(diff, level="pathway", top_n=None).drop("total")
    long = merged.select(
        "pathway",
        F.inline(F.array(F.struct(F.lit("a").alias("tag"), F.col("prob_a").alias("p")), F.struct(F.lit("b").alias("tag"), F.col("prob_b").alias("p")))),
    )
    scaled = scaled_information_flow(long, ["tag"], "p", "flow", ["pathway"])
    wide = scaled.groupBy("pathway").agg(
        *[F.max(F.when(F.col("tag") == t, F.col("p"))).alias(f"prob_{t}") for t in "ab"],
        *[F.max(F.when(F.col("tag") == t, F.col("flow"))).alias(f"flow_{t}") for t in "ab"],
    )
    whole = F.nullif(F.col("prob_a") + F.col("prob_b"), F.lit(0.0))
    out = wide.withColumns(
        {
            "total": F.col("flow_a") + F.col("flow_b"),
            "share_a": F.coalesce(F.col("prob_a") / whole, F.lit(0.0)),
            "share_b": F.coalesce(F.col("prob_b") / whole, F.lit(0.0)),
        }
    )
    return out if top_n is None else top_per_key(out.withColumn("_k", F.lit(0)), ["_k"], [F.desc("total"), F.col("pathway")], top_n).drop("_k")
