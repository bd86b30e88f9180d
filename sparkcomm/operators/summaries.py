"""Networks, rankings and role tables over scored interactions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import interaction_label
from ..model import CommResult, DiffResult
from .lr_table import as_list
from .ranks import top_per_key

MODES = ("outgoing", "incoming", "all")


def summarize(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum("prob").alias("prob"), F.count(F.lit(1)).alias("count"), F.avg("prob").alias("mean_prob"))


def compute_pathway_communication(result: CommResult, *, significant_only: bool = False) -> DataFrame:
    return summarize(result.rows(significant_only), ["source", "target", "pathway"])


def group_grid(groups: DataFrame) -> DataFrame:
    """All ordered pairs of groups: the shape of a network, so G x G rows by definition."""
    g = groups.select("group")
    return g.select(F.col("group").alias("source")).join(g.select(F.col("group").alias("target")))


def network(
    result: CommResult,
    *,
    value: str = "prob",
    pathway: str | Iterable[str] | None = None,
    significant_only: bool = False,
    pvalue_cutoff: float | None = None,
) -> DataFrame:
    df = result.significant(pvalue_cutoff) if significant_only else result.interactions
    if pathway is not None:
        df = df.where(F.col("pathway").isin(as_list(pathway) if isinstance(pathway, str) else list(pathway)))
    if value != "count" and value not in df.columns:
        raise ValueError(f"`{value}` is not available in interactions.")
    measure = F.count(F.lit(1)) if value == "count" else F.sum(value)
    cells = df.groupBy("source", "target").agg(measure.cast("double").alias("value"))
    return group_grid(result.groups).join(cells, ["source", "target"], "left").fillna(0.0, ["value"])


def network_matrix(net: DataFrame, groups: Sequence[str] | None = None) -> DataFrame:
    """Wide form: one row per source, one column per target."""
    pivot = net.groupBy("source").pivot("target", list(groups)) if groups else net.groupBy("source").pivot("target")
    return pivot.agg(F.first("value")).orderBy("source")


def matrix_edges(net: DataFrame, top_n: int | None = None) -> DataFrame:
    edges = net.where(F.col("value") > 0).select("source", "target", F.col("value").alias("weight"))
    return edges if top_n is None else edges.orderBy(F.round("weight", 9).desc(), "source", "target").limit(top_n)


def filter_interactions(
    df: DataFrame,
    *,
    sources: Sequence[str] | None = None,
    targets: Sequence[str] | None = None,
    pathways: Sequence[str] | None = None,
    max_pvalue: float | None = None,
) -> DataFrame:
    for column, keep in (("source", sources), ("target", targets), ("pathway", pathways)):
        if keep is not None:
            df = df.where(F.col(column).isin(list(keep)))
    if max_pvalue is not None:
        if not 0 <= max_pvalue <= 1:
            raise ValueError("`max_pvalue` must be between 0 and 1.")
        columns = [c for c in ("pvalue", "pvalue_a", "pvalue_b") if c in df.columns]
        if columns:
            lowest = F.least(*columns) if len(columns) > 1 else F.col(columns[0])
            df = df.where(lowest <= max_pvalue)
    return df


def with_labels(df: DataFrame) -> DataFrame:
    return df.withColumns({"interaction": interaction_label(df.columns), "pair": F.concat_ws(" -> ", "source", "target")})


def keep_top(df: DataFrame, key: str, top_n: int, value: str | Column = "prob") -> DataFrame:
    """Rows whose key is among the ``top_n`` by summed value (ties by name)."""
    # sums that differ in the last bits only are ties, settled by name
    best = df.groupBy(key).agg(F.round(F.sum(value), 9).alias("_total")).orderBy(F.desc("_total"), key).limit(top_n).select(key)
    return df.join(best, key, "left_semi")


def top_interactions(df: DataFrame, *, top_n: int | None = None, top_pairs: int | None = None) -> DataFrame:
    out = with_labels(df)
    if top_n is not None:
        out = keep_top(out, "interaction", top_n)
    if top_pairs is not None:
        out = keep_top(out, "pair", top_pairs)
    return out


def annotation_summary(result: CommResult, *, significant_only: bool = False) -> DataFrame:
    label = F.coalesce(F.nullif(F.col("annotation"), F.lit("")), F.lit("unknown"))
    rows = result.rows(significant_only).groupBy(label.alias("annotation"))
    return rows.agg(F.sum("prob").alias("prob"), F.count(F.lit(1)).alias("count"))


def lr_contribution(result: CommResult, *, pathways: Sequence[str] | None = None, top_n: int = 10, significant_only: bool = False) -> DataFrame:
    """Top interactions per pathway with their share of the kept total."""
    df = with_labels(filter_interactions(result.rows(significant_only), pathways=pathways))
    totals = df.groupBy("pathway", "interaction").agg(F.sum("prob").alias("prob"))
    kept = top_per_key(totals, ["pathway"], [F.round("prob", 9).desc(), F.col("interaction")], top_n)
    whole = F.sum("prob").over(Window.partitionBy("pathway"))
    return kept.withColumn("contribution", F.col("prob") / F.when(whole == 0, 1.0).otherwise(whole))


def by_role(df: DataFrame, mode: str) -> DataFrame:
    """Rows with a ``group``: the sender, the receiver, or both."""
    if mode not in MODES:
        raise ValueError("`mode` must be 'outgoing', 'incoming', or 'all'.")
    sent = df.withColumn("group", F.col("source"))
    got = df.withColumn("group", F.col("target"))
    return sent if mode == "outgoing" else got if mode == "incoming" else sent.unionByName(got)


def pathway_flow(
    result: CommResult,
    *,
    mode: str = "outgoing",
    groups: Sequence[str] | None = None,
    pathways: Sequence[str] | None = None,
    top_n: int | None = None,
    min_prob: float = 0.0,
    inclusive: bool = False,
    significant_only: bool = False,
) -> DataFrame:
    """Group to pathway strength above ``min_prob`` (``inclusive``: at least)."""
    df = by_role(filter_interactions(result.rows(significant_only), pathways=pathways), mode)
    if groups is not None:
        df = df.where(F.col("group").isin(list(groups)))
    flows = df.groupBy("group", "pathway").agg(F.sum("prob").alias("prob"))
    flows = flows.where(F.col("prob") >= min_prob if inclusive else F.col("prob") > min_prob)
    return flows if top_n is None else keep_top(flows, "pathway", top_n)


def gene_chord_table(
    result: CommResult,
    *,
    level: str = "lr",
    sources: Sequence[str] | None = None,
    targets: Sequence[str] | None = None,
    pathways: Sequence[str] | None = None,
    interactions: Sequence[str] | None = None,
    top_n: int | None = None,
    significant_only: bool = False,
) -> DataFrame:
    if level not in ("lr", "interaction", "pathway"):
        raise ValueError("`level` must be one of: 'lr', 'interaction', or 'pathway'.")
    df = filter_interactions(result.rows(significant_only), sources=sources, targets=targets, pathways=pathways)
    df = df.withColumn("feature", F.col("pathway") if level == "pathway" else interaction_label(df.columns))
    if interactions is not None:
        df = df.where(F.col("feature").isin(list(interactions)))
    if top_n is not None:
        df = keep_top(df, "feature", top_n)
    return df.groupBy("source", "target", "feature").agg(F.sum("prob").alias("prob"), F.count(F.lit(1)).alias("count"))


def individual_interaction(
    result: CommResult,
    *,
    pathway: str | Sequence[str] | None = None,
    interaction: str | Sequence[str] | None = None,
    ligand: str | Sequence[str] | None = None,
    receptor: str | Sequence[str] | None = None,
    significant_only: bool = False,
) -> DataFrame:
    """Rows of the strongest LR row that matches the filters."""
    df = result.rows(significant_only).withColumn("interaction", interaction_label(result.interactions.columns))
    for column, keep in (("pathway", pathway), ("interaction", interaction), ("ligand", ligand), ("receptor", receptor)):
        if keep is not None:
            df = df.where(F.col(column).isin(as_list(keep)))
    keys = ["ligand", "receptor", "pathway"]
    totals = df.groupBy(*keys, "interaction").agg(F.round(F.sum("prob"), 9).alias("_total"))
    best = totals.orderBy(F.desc("_total"), *keys).limit(1).select(*keys)
    return df.join(best, keys, "left_semi")


def signaling_role_matrix(
    result: CommResult, *, mode: str = "outgoing", pathways: Sequence[str] | None = None, row_scale: bool = False
) -> DataFrame:
    """Pathway x group strength over all groups (long); ``row_scale`` divides by the pathway's largest."""
    df = by_role(filter_interactions(result.interactions, pathways=pathways), mode)
    sums = df.groupBy("pathway", "group").agg(F.sum("prob").alias("strength"))
    names = sums.select("pathway").distinct()
    if pathways is not None:
        names = df.sparkSession.createDataFrame([(str(p),) for p in pathways], "pathway string")
    grid = names.join(result.groups.select("group"))
    out = grid.join(sums, ["pathway", "group"], "left").fillna(0.0, ["strength"])
    if row_scale:
        top = F.max("strength").over(Window.partitionBy("pathway"))
        out = out.withColumn("strength", F.when(top > 0, F.col("strength") / top).otherwise(F.col("strength")))
    return out


def signaling_role_scatter_table(result: CommResult, *, pathways: Sequence[str] | None = None, significant_only: bool = False) -> DataFrame:
    """Per group: outgoing and incoming strength and the number of links in both directions."""
    df = filter_interactions(result.rows(significant_only), pathways=pathways)
    edges = df.groupBy("source", "target").agg(F.sum("prob").alias("prob"))
    ends = edges.select(
        F.inline(
            F.array(
                F.struct(F.col("source").alias("group"), F.col("prob").alias("outgoing"), F.lit(0.0).alias("incoming")),
                F.struct(F.col("target").alias("group"), F.lit(0.0).alias("outgoing"), F.col("prob").alias("incoming")),
            )
        )
    )
    sums = ends.groupBy("group").agg(F.sum("outgoing").alias("outgoing"), F.sum("incoming").alias("incoming"), F.count(F.lit(1)).alias("link_count"))
    return result.groups.select("group").join(sums, "group", "left").fillna(0, ["outgoing", "incoming", "link_count"])


def role_compare_table(diff: DiffResult, *, mode: str = "outgoing", pathways: Sequence[str] | None = None, row_scale: bool = False) -> DataFrame:
    """Role strengths of both conditions over their common list of pathways, in order of total."""
    both = diff.a.interactions.select("pathway", "prob").unionByName(diff.b.interactions.select("pathway", "prob"))
    totals = filter_interactions(both, pathways=pathways).groupBy("pathway").agg(F.sum("prob").alias("pathway_total"))
    grid = totals.join(diff.groups.select("group"))
    parts = []
    for result, label in ((diff.a, diff.label_a), (diff.b, diff.label_b)):
        m = signaling_role_matrix(result, mode=mode, row_scale=row_scale)
        parts.append(grid.join(m, ["pathway", "group"], "left").fillna(0.0, ["strength"]).withColumn("condition", F.lit(label)))
    return parts[0].unionByName(parts[1])


def pathway_pair_matrix(
    result: CommResult,
    *,
    source: str | None = None,
    target: str | None = None,
    pathways: Sequence[str] | None = None,
    top_pairs: int | None = None,
    significant_only: bool = False,
) -> DataFrame:
    df = filter_interactions(
        result.rows(significant_only), sources=as_list(source) or None, targets=as_list(target) or None, pathways=pathways
    ).withColumn("pair", F.concat_ws(" -> ", "source", "target"))
    if top_pairs is not None:
        df = keep_top(df, "pair", top_pairs)
    return df.groupBy("pathway", "pair").agg(F.sum("prob").alias("prob"))


def pvalue_size(pvalue: str | Column = "pvalue") -> Column:
    """-log10 p; 0 when p is missing or 0."""
    p = F.col(pvalue) if isinstance(pvalue, str) else pvalue
    return F.coalesce(F.when(p > 0, -F.log10(p)), F.lit(0.0))


def spatial_edge_table(labelled: DataFrame, net: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Network edges with the centroids of both ends."""
    centre = labelled.groupBy("group").agg(F.avg(x).alias("cx"), F.avg(y).alias("cy"))
    s = centre.select(F.col("group").alias("source"), F.col("cx").alias("source_x"), F.col("cy").alias("source_y"))
    t = centre.select(F.col("group").alias("target"), F.col("cx").alias("target_x"), F.col("cy").alias("target_y"))
    return matrix_edges(net).join(s, "source").join(t, "target")
