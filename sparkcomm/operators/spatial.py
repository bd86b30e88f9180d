"""Spatial kernels, scores and summaries over cell coordinates.

Cells at one place are one location with counts per group, so copies of a place never
multiply pairs. Locations meet on a grid; crowded grid cells are split over salts. Kernel sums and distance
bins come from blocks of places (:mod:`.pair_blocks`).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_long
from ..session import materialize
from .expression import attach_groups, group_sizes
from .pair_blocks import distance_bins, sums_of_kernels
from .ranks import broadcast_within, first_per_key, quantiles, running_totals, top_per_key, value_bucket

KERNELS = ("contact", "exp")
SCORES = ("spatial_ccc_score", "model_weighted_spatial_ccc_score")
SCORE_COLUMNS = (
    "model_score", "confidence", "density_rank", "ligand_secreted_like_score", "ligand_membrane_like_score",
    "receptor_secreted_like_score", "receptor_membrane_like_score",
)


def exact_gene_lr(lr: DataFrame, genes: DataFrame) -> DataFrame:
    """LR rows whose two names are genes exactly as written (no complexes, no case folding)."""
    known = genes.select("gene").distinct()
    for end in ("ligand", "receptor"):
        lr = lr.join(known.withColumnRenamed("gene", end), end, "left_semi")
    return lr


# --- distances ---------------------------------------------------------------------------

def _distance() -> Column:
    dx, dy = F.col("xa") - F.col("xb"), F.col("ya") - F.col("yb")
    return F.sqrt(dx * dx + dy * dy)


def location_pairs(places: DataFrame, reach: float, by: Sequence[str] = (), *, carry: Sequence[str] = (), crowd: int = 2000) -> DataFrame:
    """Ordered pairs ``(by, xa, ya, xb, yb, d)`` of distinct places at most ``reach`` apart, each
    place with itself included. ``carry`` columns come along with the ending ``a`` or ``b``."""
    spots = places.select(*by, "x", "y", *carry).distinct()
    own = lambda end: [F.col(c).alias(f"{c}{end}") for c in carry]
    if reach <= 0 and carry:
        left = spots.select(*by, "x", "y", *own("a"))
        both = left.join(spots.select(*by, "x", "y", *own("b")), [*by, "x", "y"])
        ends = [F.col("x").alias("xa"), F.col("y").alias("ya"), F.col("x").alias("xb"), F.col("y").alias("yb")]
        return both.select(*by, *ends, F.lit(0.0).alias("d"), *[f"{c}{e}" for e in "ab" for c in carry])
    if reach <= 0:
        same = spots.select(*by, F.col("x").alias("xa"), F.col("y").alias("ya"), F.col("x").alias("xb"), F.col("y").alias("yb"))
        return same.withColumn("d", F.lit(0.0))
    size = F.lit(float(reach))
    gridded = spots.withColumns({"gx": F.floor(F.col("x") / size), "gy": F.floor(F.col("y") / size)})
    cell = [*by, "gx", "gy"]
    # crowded grid cells: their left rows are dealt over salts, right rows go to every salt
    load = gridded.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / F.lit(float(crowd))).cast("int").alias("_salts")).where("_salts > 1")
    left = gridded.join(load, cell, "left").withColumn("_salt", F.pmod(F.xxhash64("x", "y"), F.coalesce("_salts", F.lit(1))).cast("int"))
    left = left.select(*cell, "_salt", F.col("x").alias("xa"), F.col("y").alias("ya"), *own("a"))
    near = F.array(*[F.struct((F.col("gx") + i).alias("gx"), (F.col("gy") + j).alias("gy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    right = gridded.select(*by, F.col("x").alias("xb"), F.col("y").alias("yb"), *own("b"), F.inline(near))
    right = right.join(load, cell, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    pairs = left.join(right, [*cell, "_salt"]).withColumn("d", _distance())
    return pairs.where(F.col("d") <= float(reach)).select(*by, "xa", "ya", "xb", "yb", "d", *[f"{c}{e}" for e in "ab" for c in carry])


def kernel_reach(kernel: str, radius: float, sigma: float, tail: float = 1e-12) -> float:
    """How far a kernel acts. ``exp`` is cut where it falls below ``tail``, so a mean weight is
    off by less than ``tail``."""
    if kernel == "contact":
        return radius
    if kernel == "exp":
        return sigma * math.log(1.0 / tail)
    raise ValueError("Distance kernels must be `contact` or `exp`.")


def spatial_weights(
    labelled: DataFrame,
    *,
    radius: float,
    sigma: float,
    kernels: Sequence[str] = KERNELS,
    run: str | None = None,
    by: Sequence[str] = (),
    tail: float = 1e-12,
) -> DataFrame:
    """``(run, by, source, target, kernel, spatial_weight)``: mean kernel value over all cell
    pairs of two groups (a cell with itself included), for every pair of groups present."""
    keys = [*([run] if run else []), *by]
    sizes = group_sizes(labelled, keys)
    s = sizes.select(*keys, F.col("group").alias("source"), F.col("n_cells").alias("_ns"))
    t = sizes.select(*keys, F.col("group").alias("target"), F.col("n_cells").alias("_nt"))
    grid = s.join(t, keys) if keys else s.join(t)
    reaches = {kernel: kernel_reach(kernel, radius, sigma, tail) for kernel in kernels}
    sums = sums_of_kernels(labelled, reaches, sigma, by=by, run=run)
    grid = grid.withColumn("kernel", F.explode(F.array(*[F.lit(k) for k in kernels])))
    w = grid.join(sums, [*keys, "source", "target", "kernel"], "left")
    weight = F.coalesce("_sum", F.lit(0.0)) / (F.col("_ns") * F.col("_nt"))
    return w.select(*keys, "source", "target", "kernel", weight.alias("spatial_weight"))


# --- radius ------------------------------------------------------------------------------

def nearest_distances(cells: DataFrame, *, crowd: int = 256) -> DataFrame:
    """``(x, y, n, d)``: distance of every place to its nearest other cell, with its cell count.

    Grid search, finest first: the grid is halved until no grid cell is crowded, then doubled for
    the places still without a neighbour inside the ring that was searched.
    """
    places = materialize(cells.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")))
    shared = places.where("n > 1").withColumn("d", F.lit(0.0))
    stats = places.agg(F.count(F.lit(1)), F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    if stats[0] < 2:
        return shared
    width = max(stats[1], stats[2])
    h = width / math.sqrt(stats[0])

    def gridded(df: DataFrame, step: float) -> DataFrame:
        return df.withColumns({"gx": F.floor(F.col("x") / F.lit(step)), "gy": F.floor(F.col("y") / F.lit(step))})

    while h > width * 1e-9:
        top = gridded(places, h).groupBy("gx", "gy").count().agg(F.max("count")).first()[0]
        if top <= crowd:
            break
        h /= 2
    open_places = places.where("n = 1")
    found = [shared]
    while True:
        near = F.array(*[F.struct((F.col("gx") + i).alias("gx"), (F.col("gy") + j).alias("gy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        left = gridded(open_places, h).select(F.col("x").alias("xa"), F.col("y").alias("ya"), F.inline(near))
        right = gridded(places, h).select("gx", "gy", F.col("x").alias("xb"), F.col("y").alias("yb"))
        best = left.join(right, ["gx", "gy"]).where("NOT (xa = xb AND ya = yb)").withColumn("d", _distance())
        best = best.groupBy(F.col("xa").alias("x"), F.col("ya").alias("y")).agg(F.min("d").alias("d")).where(F.col("d") <= h)
        best = materialize(best)
        found.append(best.withColumn("n", F.lit(1).cast("bigint")))
        open_places = materialize(open_places.join(best, ["x", "y"], "left_anti"))
        if open_places.isEmpty():
            break
        h *= 2
    out = found[0].select("x", "y", "n", "d")
    for f in found[1:]:
        out = out.unionByName(f.select("x", "y", "n", "d"))
    return out


def resolve_radius(cells: DataFrame, radius: str | float = "auto") -> DataFrame:
    """One row ``radius``: given, from the median cell area, or the median nearest distance."""
    if radius != "auto":
        return cells.sparkSession.createDataFrame([(float(radius),)], "radius double")
    for c in ("cell_area", "area"):
        if c in cells.columns:
            area = cells.select(F.col(c).try_cast("double").alias("a")).where("a IS NOT NULL AND NOT isnan(a)")
            if not area.isEmpty():
                return quantiles(area, [], "a", [0.5]).select((F.sqrt(F.col("q0") / math.pi) * 2).alias("radius"))
    near = nearest_distances(cells)
    if near.isEmpty():
        return cells.sparkSession.createDataFrame([(0.0,)], "radius double")
    return quantiles(near, [], "d", [0.5], weight="n").select(F.col("q0").alias("radius"))


# --- scores ------------------------------------------------------------------------------

def group_means(nz: DataFrame, labelled: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by, group, gene, expr)`` means over all cells of a group, zeros counted."""
    sizes = group_sizes(labelled, by)
    sums = attach_groups(nz, labelled, by).groupBy(*by, "group", "gene").agg(F.sum("value").alias("_s"))
    return sums.join(sizes, [*by, "group"]).select(*by, "group", "gene", (F.col("_s") / F.col("n_cells")).alias("expr"))


def gene_means(nz: DataFrame, cells: DataFrame, genes: DataFrame) -> DataFrame:
    """``(gene, expression)`` over all cells, for every gene."""
    total = cells.agg(F.count(F.lit(1)))
    sums = nz.groupBy("gene").agg(F.sum("value").alias("_s"))
    return genes.select("gene").distinct().join(sums, "gene", "left").select("gene", (F.coalesce("_s", F.lit(0.0)) / total.scalar()).alias("expression"))


def score_lr_spatial(lr: DataFrame, means: DataFrame, weights: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Every LR row x source x target x kernel: expression product, weighted, times model score.

    Groups without the gene count as 0, so the table is LR rows x group pairs by definition.
    """
    score = F.coalesce(F.col("model_score").cast("double"), F.lit(1.0)) if "model_score" in lr.columns else F.lit(1.0)
    passed = [c for c in lr.columns if c.startswith(("original_", "matched_")) or "_match_" in c]
    rows = lr.select("ligand", "receptor", score.alias("model_score"), *passed)
    base = weights.join(broadcast_within(rows))
    s = means.select(*by, F.col("group").alias("source"), F.col("gene").alias("ligand"), F.col("expr").alias("_l"))
    t = means.select(*by, F.col("group").alias("target"), F.col("gene").alias("receptor"), F.col("expr").alias("_r"))
    out = base.join(s, [*by, "source", "ligand"], "left").join(t, [*by, "target", "receptor"], "left")
    product = F.coalesce("_l", F.lit(0.0)) * F.coalesce("_r", F.lit(0.0))
    out = out.withColumn("expression_score", product).withColumn("spatial_ccc_score", F.col("expression_score") * F.col("spatial_weight"))
    out = out.withColumn("model_weighted_spatial_ccc_score", F.col("spatial_ccc_score") * F.col("model_score"))
    return out.drop("_l", "_r")


def mean_scores(lr: DataFrame, means: DataFrame, weights: DataFrame, *, by: Sequence[str] = (), means_by: Sequence[str] | None = None, weights_by: Sequence[str] | None = None) -> DataFrame:
    """Mean score per (by, LR row, kernel) without the LR x source x target table.

    ``by`` keys of ``lr``, of the means and of the weights may differ (a run that only changes one
    of them); each side joins on the keys it has.
    """
    means_by = list(by if means_by is None else means_by)
    weights_by = list(by if weights_by is None else weights_by)
    lr_by = [c for c in by if c in lr.columns]
    n_groups = weights.groupBy(*weights_by, "kernel").agg(F.count(F.lit(1)).alias("_g2"))
    t = means.select(*means_by, F.col("group").alias("target"), F.col("gene").alias("receptor"), F.col("expr").alias("_r"))
    shared = [c for c in means_by if c in weights_by]
    felt = weights.join(t, [*shared, "target"]).groupBy(*dict.fromkeys([*weights_by, *means_by]), "kernel", "source", "receptor")
    felt = felt.agg(F.sum(F.col("_r") * F.col("spatial_weight")).alias("_in"))
    felt_by = list(dict.fromkeys([*weights_by, *means_by]))
    s = means.select(*means_by, F.col("group").alias("source"), F.col("gene").alias("ligand"), F.col("expr").alias("_l"))
    rows = lr.select(*lr_by, "ligand", "receptor")
    got = rows.join(felt, [*[c for c in lr_by if c in felt_by], "receptor"])
    got_by = list(dict.fromkeys([*lr_by, *felt_by]))
    got = got.join(s, [*[c for c in means_by if c in got_by], "source", "ligand"]).groupBy(*got_by, "ligand", "receptor", "kernel")
    got = got.agg(F.sum(F.col("_l") * F.col("_in")).alias("_sum"))
    # a pair nobody expresses has mean 0
    full = rows.join(n_groups, [c for c in lr_by if c in weights_by]) if any(c in weights_by for c in lr_by) else rows.join(n_groups)
    full_by = list(dict.fromkeys([*lr_by, *weights_by]))
    missing = [c for c in got_by if c not in full_by]
    if missing:
        full = full.join(means.select(*missing).distinct())
        full_by += missing
    out = full.join(got, [*full_by, "ligand", "receptor", "kernel"], "left")
    return out.select(*full_by, "ligand", "receptor", "kernel", (F.coalesce("_sum", F.lit(0.0)) / F.col("_g2")).alias("spatial_ccc_score"))


def lr_summary(observed: DataFrame, lr: DataFrame) -> DataFrame:
    keys = ["ligand", "receptor"]
    out = observed.groupBy(*keys, "kernel").agg(
        F.avg("spatial_ccc_score").alias("spatial_ccc_score"),
        F.max("spatial_ccc_score").alias("max_spatial_ccc_score"),
        F.avg("model_weighted_spatial_ccc_score").alias("model_weighted_spatial_ccc_score"),
    )
    extra = [c for c in SCORE_COLUMNS if c in lr.columns]
    if not extra:
        return out
    return out.join(first_per_key(lr.select(*keys, *extra), keys, [F.col(c) for c in extra]), keys, "left")


def annotate_curated_overlap(summary: DataFrame, curated: DataFrame) -> DataFrame:
    keys = ["ligand", "receptor"]
    known = curated.select(*keys).distinct().withColumn("curated_overlap", F.lit(True))
    return summary.join(known, keys, "left").fillna(False, ["curated_overlap"])


# --- summaries ---------------------------------------------------------------------------

def long_scores(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per score type."""
    both = F.array(*[F.struct(F.lit(c).alias("score_type"), F.col(c).alias("score_value")) for c in SCORES if c in df.columns])
    return df.select(*keys, F.inline(both))


def role_kernel_enrichment(summary: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """Secreted-like pairs in the exp kernel and membrane-like in contact, against the others."""
    specs = []
    if "ligand_secreted_like_score" in summary.columns:
        specs.append(("secreted_like", "exp", "ligand_secreted_like_score", F.col("ligand_secreted_like_score")))
    membrane = [c for c in ("ligand_membrane_like_score", "receptor_membrane_like_score") if c in summary.columns]
    if membrane:
        specs.append(("membrane_contact_like", "contact", "membrane_contact_like_score", F.greatest(*membrane) if len(membrane) > 1 else F.col(membrane[0])))
    out = None
    for name, kernel, column, score in specs:
        rows = summary.where(F.col("kernel") == kernel).withColumn("_role", F.coalesce(score.cast("double"), F.lit(0.0)) >= threshold)
        long = long_scores(rows, ["_role"])
        stats = long.groupBy("score_type").agg(
            F.count_if("_role").alias("n_role_pairs"),
            F.count_if(~F.col("_role")).alias("_others"),
            F.count(F.lit(1)).alias("_all"),
            F.avg(F.when(F.col("_role"), F.col("score_value"))).alias("role_mean"),
            F.avg(F.when(~F.col("_role"), F.col("score_value"))).alias("_bg"),
            F.avg("score_value").alias("_bg_all"),
        )
        background = F.when(F.col("_others") > 0, F.col("_bg")).otherwise(F.col("_bg_all"))
        part = stats.select(
            F.lit(name).alias("role_class"),
            F.lit(kernel).alias("kernel"),
            "score_type",
            F.lit(column).alias("role_score_col"),
            F.lit(float(threshold)).alias("role_score_threshold"),
            "n_role_pairs",
            F.when(F.col("_others") > 0, F.col("_others")).otherwise(F.col("_all")).alias("n_background_pairs"),
            "role_mean",
            background.alias("background_mean"),
            (F.col("role_mean") / F.nullif(background, F.lit(0.0))).alias("role_kernel_enrichment"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def curated_overlap_enrichment(summary: DataFrame) -> DataFrame:
    long = long_scores(summary, ["kernel", "curated_overlap"])
    o = F.col("curated_overlap")
    stats = long.groupBy("kernel", "score_type").agg(
        F.count_if(o).alias("n_curated_overlap_pairs"),
        F.count_if(~o).alias("n_background_pairs"),
        F.avg(F.when(o, F.col("score_value"))).alias("curated_overlap_mean"),
        F.avg(F.when(~o, F.col("score_value"))).alias("background_mean"),
        F.avg(o.cast("double")).alias("curated_overlap_fraction"),
    )
    return stats.withColumn("curated_overlap_enrichment", F.col("curated_overlap_mean") / F.nullif(F.col("background_mean"), F.lit(0.0)))


def sample_cells(labelled: DataFrame, max_cells: int | None, *, seed: int = 0) -> DataFrame:
    """At most ``max_cells`` cells by hash order; all of them without a limit."""
    if max_cells is None:
        return labelled
    keyed = labelled.withColumns({"_k": F.lit(0), "_h": hash_long(seed, F.lit("decay"), F.col("cell_id"))})
    return top_per_key(keyed, ["_k"], [F.col("_h"), F.col("cell_id")], max_cells).drop("_k", "_h")


def decay_weights(labelled: DataFrame, *, max_cells: int | None = None, seed: int = 0) -> DataFrame:
    """``(bin, lo, hi, source, target, kernel, spatial_weight)``: the share of the cell pairs of two groups in each of five quantile bins of
    the distances of all cells, or of a sample of ``max_cells``.

    Bins are closed at both ends. All pairs of places are looked at, a square by definition, block against block.
    """
    few = materialize(sample_cells(labelled, max_cells, seed=seed).select("cell_id", "group", "x", "y"))
    _, sums = distance_bins(few, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])
    sizes = group_sizes(few)
    s = sizes.select(F.col("group").alias("source"), F.col("n_cells").alias("_ns"))
    t = sizes.select(F.col("group").alias("target"), F.col("n_cells").alias("_nt"))
    weight = F.col("n") / (F.col("_ns") * F.col("_nt"))
    return materialize(sums.join(s, "source").join(t, "target").select("bin", "lo", "hi", "source", "target", F.lit("bin").alias("kernel"), weight.alias("spatial_weight")))


def distance_decay(
    labelled: DataFrame, lr: DataFrame, means: DataFrame, *, max_cells: int | None = None, seed: int = 0, weights: DataFrame | None = None
) -> DataFrame:
    """Mean LR score in five quantile bins of the pair distances; ``weights`` of another LR table over the same cells can be passed on (:func:`decay_weights`)."""
    weights = decay_weights(labelled, max_cells=max_cells, seed=seed) if weights is None else weights
    bins = weights.select("bin", "lo", "hi").distinct()
    scored = mean_scores(lr, means, weights.drop("lo", "hi"), by=["bin"], means_by=[], weights_by=["bin"])
    model = F.coalesce(F.col("model_score").cast("double"), F.lit(1.0)) if "model_score" in lr.columns else F.lit(1.0)
    own = lr.select("ligand", "receptor", model.alias("_m")).groupBy("ligand", "receptor").agg(F.first("_m").alias("_m"))
    out = scored.join(F.broadcast(bins), "bin").join(own, ["ligand", "receptor"])
    return out.select(
        "ligand",
        "receptor",
        F.col("lo").alias("distance_min"),
        F.col("hi").alias("distance_max"),
        ((F.col("lo") + F.col("hi")) / 2).alias("mean_distance"),
        F.col("spatial_ccc_score").alias("mean_spatial_ccc_score"),
        (F.col("spatial_ccc_score") * F.col("_m")).alias("model_weighted_mean_spatial_ccc_score"),
    )


def decay_chart_table(decay: DataFrame, *, top_n: int = 10, score_col: str = "mean_spatial_ccc_score") -> DataFrame:
    rows = decay.withColumn("pair", F.concat_ws("->", "ligand", "receptor"))
    best = rows.groupBy("pair").agg(F.avg(score_col).alias("_m")).orderBy(F.desc("_m"), "pair").limit(max(int(top_n), 1)).select("pair")
    return rows.join(best, "pair", "left_semi")


def section_reproducibility(
    labelled: DataFrame,
    nz: DataFrame,
    lr: DataFrame,
    *,
    radius: float,
    sigma: float,
    kernels: Sequence[str] = KERNELS,
    section: str = "section",
    section_top_k: int = 100,
) -> DataFrame:
    """Scores inside every section with at least two cells, and how they agree across sections."""
    big = labelled.groupBy(section).agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2").select(section)
    cells = labelled.join(big, section, "left_semi")
    by = [section]
    means = materialize(group_means(nz, cells, by))
    weights = materialize(spatial_weights(cells, radius=radius, sigma=sigma, kernels=kernels, by=by))
    per = mean_scores(lr, means, weights, by=by)
    own = lr.groupBy("ligand", "receptor").agg(F.first(F.coalesce(F.col("model_score").cast("double"), F.lit(1.0)) if "model_score" in lr.columns else F.lit(1.0)).alias("_m"))
    per = materialize(per.join(own, ["ligand", "receptor"]).withColumn("model_weighted_spatial_ccc_score", F.col("spatial_ccc_score") * F.col("_m")))
    value = F.col("model_weighted_spatial_ccc_score")
    ties = per.groupBy(section, "kernel", "model_weighted_spatial_ccc_score").agg(F.count(F.lit(1)).alias("_c"))
    ranked = running_totals(ties, [section, "kernel"], [value.desc()], value_bucket(value), {"_before": F.col("_c")}, descending=True)
    per = per.join(ranked.select(section, "kernel", "model_weighted_spatial_ccc_score", (F.col("_before") + 1).alias("section_rank")), [section, "kernel", "model_weighted_spatial_ccc_score"])
    keys = ["ligand", "receptor", "kernel"]
    mid = quantiles(per.withColumn("_rank", F.col("section_rank").cast("double")), keys, "_rank", [0.5]).withColumnRenamed("q0", "median_section_rank")
    m, sd = "section_spatial_ccc_score_mean", "section_spatial_ccc_score_sd"
    out = per.groupBy(*keys).agg(
        F.count_distinct(section).alias("n_sections"),
        F.avg("spatial_ccc_score").alias(m),
        F.stddev_samp("spatial_ccc_score").alias(sd),
        F.avg("model_weighted_spatial_ccc_score").alias("section_model_weighted_spatial_ccc_score_mean"),
        F.stddev_samp("model_weighted_spatial_ccc_score").alias("section_model_weighted_spatial_ccc_score_sd"),
        F.avg((F.col("spatial_ccc_score") > 0).cast("double")).alias("positive_section_fraction"),
        F.avg((F.col("section_rank") <= max(int(section_top_k), 1)).cast("double")).alias("top_k_section_fraction"),
    )
    return out.withColumn("section_spatial_ccc_score_cv", F.col(sd) / F.nullif(F.abs(m), F.lit(0.0))).join(mid, keys)
