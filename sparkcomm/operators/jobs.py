"""Steps around validation: preparation, strategy scores, comparisons, gates, parity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import hash_long, hash_unit
from ..functions.text import tokens
from ..session import materialize
from .nulls import gene_match_table, matched_pool, matched_random_lr, with_reporting_names
from .ranks import first_per_key, quantiles, running_totals, top_per_key, value_bucket
from .resample import shuffled_values
from .spatial import decay_weights, distance_decay, gene_means

# Coordinate columns looked for, raw count layers, strategies and their order.
COORDINATES = (("x", "y"), ("X", "Y"), ("spatial_x", "spatial_y"), ("array_row", "array_col"))
COUNT_LAYERS = ("counts", "raw_counts", "UMI", "umis")
BASELINE_STRATEGIES = ("role_only", "embedding_cosine", "expression_only")


# --- preparation --------------------------------------------------------------------------

def normalize_log1p(expression: DataFrame, target: float = 1e4) -> DataFrame:
    """Scale every cell to the same total, then log1p."""
    totals = expression.groupBy("cell_id").agg(F.sum("value").alias("_t"))
    out = expression.join(totals, "cell_id")
    scaled = F.when(F.col("_t") > 0, F.col("value") / F.col("_t") * target).otherwise(F.col("value"))
    return out.select("cell_id", "gene", F.log1p(scaled).alias("value"))


def count_evidence(expression: DataFrame) -> DataFrame:
    """One row: smallest and largest value, whether all are whole, and the verdict."""
    whole = F.min(F.abs(F.col("value") - F.round("value")) <= 1e-8)
    out = expression.agg(F.min("value").alias("lowest"), F.max("value").alias("highest"), whole.alias("all_whole"))
    verdict = F.coalesce((F.col("lowest") >= 0) & ((F.col("highest") > 20) | F.col("all_whole")), F.lit(False))
    return out.withColumn("looks_like_counts", verdict)


def normalize_if_counts(expression: DataFrame) -> DataFrame:
    return normalize_log1p(expression) if count_evidence(expression).first()["looks_like_counts"] else expression


def group_column_candidates(cells: DataFrame) -> DataFrame:
    """``(position, column, levels)`` of the text columns that could label groups (no ids)."""
    names = [
        (i, f.name) for i, f in enumerate(cells.schema.fields)
        if isinstance(f.dataType, T.StringType) and not f.name.lower().endswith("id") and f.name.lower() not in ("cellid", "cell_id", "barcode")
    ]
    counts = cells.agg(*[F.count_distinct(F.coalesce(n, F.lit("nan"))).alias(n) for _, n in names], F.count(F.lit(1)).alias("_n"))
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("column"), F.col(n).alias("levels")) for i, n in names])
    long = counts.select("_n", F.inline(rows))
    limit = F.greatest(F.lit(100), F.floor(F.greatest(F.col("_n"), F.lit(1)) * 0.5))
    return long.where((F.col("levels") >= 2) & (F.col("levels") <= limit)).drop("_n")


def choose_group_column(cells: DataFrame, priority: Sequence[str] = ()) -> str | None:
    """First of the priority list that exists (any case), else the first fitting text column."""
    lower = {c.lower(): c for c in cells.columns}
    for name in priority:
        if name in cells.columns:
            return name
        if name.lower() in lower:
            return lower[name.lower()]
    row = group_column_candidates(cells).orderBy("position").first()
    return row["column"] if row else None


def choose_coordinates(columns: Sequence[str]) -> tuple[str, str]:
    for x, y in COORDINATES:
        if x in columns and y in columns:
            return x, y
    raise KeyError("No coordinate columns found.")


def section_qc(expression: DataFrame, labelled: DataFrame, section: str = "section", *, genes: DataFrame | None = None) -> DataFrame:
    """Cells, groups and expressed genes per section."""
    cells = labelled.groupBy(section).agg(F.count(F.lit(1)).alias("n_cells_or_bins"))
    groups = labelled.select(section, "group").distinct().groupBy(section).agg(F.count(F.lit(1)).alias("n_groups"))
    seen = expression.join(labelled.select("cell_id", section), "cell_id").select(section, "gene").distinct().groupBy(section).agg(F.count(F.lit(1)).alias("n_expression_genes"))
    out = cells.join(groups, section).join(seen, section, "left").fillna(0, ["n_expression_genes"])
    return out if genes is None else out.withColumn("n_genes", genes.select("gene").distinct().agg(F.count(F.lit(1))).scalar())


def union_sections(sections: Mapping[str, tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """All sections as one expression and one cells table; columns missing in one are NULL."""
    expression = cells = None
    for name, (e, c) in sections.items():
        e = e.withColumn("cell_id", F.concat_ws(":", F.lit(name), "cell_id"))
        c = c.withColumn("cell_id", F.concat_ws(":", F.lit(name), "cell_id")).withColumn("section_id", F.lit(name))
        expression = e if expression is None else expression.unionByName(e, allowMissingColumns=True)
        cells = c if cells is None else cells.unionByName(c, allowMissingColumns=True)
    return expression, cells


def union_gene_lookup(tables: Sequence[DataFrame]) -> DataFrame:
    """``(gene, gene_id)``: the id of the first section that knows the gene."""
    rows = None
    for i, t in enumerate(tables):
        part = t.select("gene", (F.col("gene_id") if "gene_id" in t.columns else F.col("gene")).cast("string").alias("gene_id"), F.lit(i).alias("_o"))
        rows = part if rows is None else rows.unionByName(part)
    return first_per_key(rows, ["gene"], [F.col("_o"), F.col("gene_id")]).drop("_o")


# --- strategies ---------------------------------------------------------------------------

def limit_lr_for_validation(lr: DataFrame, max_pairs: int) -> DataFrame:
    """Best ``max_pairs`` rows by density rank, then score; 0 keeps all."""
    if max_pairs <= 0:
        return lr
    order = [F.col("ligand"), F.col("receptor")]
    if "model_score" in lr.columns:
        order.insert(0, F.col("model_score").desc())
    if "density_rank" in lr.columns:
        order.insert(0, F.col("density_rank").try_cast("double").asc_nulls_last())
    return top_per_key(lr.withColumn("_k", F.lit(0)), ["_k"], order, max_pairs).drop("_k")


def _number(lr: DataFrame, column: str, default: float) -> Column:
    return F.coalesce(F.col(column).try_cast("double"), F.lit(default)) if column in lr.columns else F.lit(default)


def baseline_lr(lr: DataFrame, baseline: str, *, gene_expression: DataFrame | None = None) -> DataFrame:
    """The LR table with ``model_score`` replaced by a baseline's ranking."""
    if baseline == "role_only":
        score = _number(lr, "ligand_role_score", 0.5) * _number(lr, "receptor_role_score", 0.5)
    elif baseline == "embedding_cosine":
        if "embedding_cosine" in lr.columns:
            score = _number(lr, "embedding_cosine", 0.0)
        elif "nearest_reference_distance" in lr.columns:
            score = F.coalesce(1.0 / (1.0 + F.col("nearest_reference_distance").try_cast("double")), F.lit(0.0))
        else:
            score = F.lit(0.0)
    elif baseline == "expression_only":
        for side in ("ligand", "receptor"):
            lr = lr.join(gene_expression.select(F.col("gene").alias(side), F.col("expression").alias(f"_{side}")), side, "left")
        score = F.coalesce("_ligand", F.lit(0.0)) * F.coalesce("_receptor", F.lit(0.0))
    else:
        raise ValueError(f"Unknown baseline: {baseline}")
    out = lr.withColumn("model_score", score).drop("_ligand", "_receptor")
    return out.withColumns({"confidence": F.col("model_score"), "validation_strategy": F.lit(baseline), "validation_score_method": F.lit(baseline)})


def expression_potential(lr: DataFrame, means: DataFrame, groups: DataFrame, stat: str = "mean") -> DataFrame:
    """``(ligand, receptor, potential)``: mean, max or 90 % quantile of L x R over all group pairs.

    Mean and max follow from the per-gene sums and maxima (values are not negative); the quantile
    looks at the pairs.
    """
    if stat not in ("mean", "max", "q90"):
        raise ValueError(f"`{stat}` is no way to sum up an expression potential.")
    pairs = lr.select("ligand", "receptor").distinct()
    n = groups.agg(F.count(F.lit(1)))
    if stat in ("mean", "max"):
        per = means.groupBy("gene").agg(F.sum("expr").alias("_s"), F.max("expr").alias("_m"))
        for side in ("ligand", "receptor"):
            pairs = pairs.join(per.select(F.col("gene").alias(side), F.col("_s").alias(f"_s_{side}"), F.col("_m").alias(f"_m_{side}")), side, "left")
        zero = F.lit(0.0)
        total = F.coalesce("_s_ligand", zero) * F.coalesce("_s_receptor", zero) / (n.scalar() * n.scalar())
        return pairs.select("ligand", "receptor", (total if stat == "mean" else F.coalesce("_m_ligand", zero) * F.coalesce("_m_receptor", zero)).alias("potential"))
    l = means.select(F.col("gene").alias("ligand"), F.col("expr").alias("_l"))
    r = means.select(F.col("gene").alias("receptor"), F.col("expr").alias("_r"))
    values = pairs.join(l, "ligand").join(r, "receptor").select("ligand", "receptor", (F.col("_l") * F.col("_r")).alias("value")).where("value <> 0")
    totals = pairs.withColumn("n", n.scalar() * n.scalar())
    q = quantiles(values, ["ligand", "receptor"], "value", [0.9], totals=totals)
    return pairs.join(q, ["ligand", "receptor"], "left").select("ligand", "receptor", F.coalesce("q0", F.lit(0.0)).alias("potential"))


def expression_potential_score(lr: DataFrame, means: DataFrame, groups: DataFrame, *, stat: str = "mean", power: float = 0.5) -> DataFrame:
    """Model score times the average-rank percentile of the potential, to a power."""
    base = lr.withColumn("base_model_score", _number(lr, "model_score", 0.0))
    pot = materialize(base.join(expression_potential(lr, means, groups, stat), ["ligand", "receptor"]).withColumn("_v", F.round("potential", 12)))
    ties = pot.groupBy("_v").agg(F.count(F.lit(1)).alias("_c"))
    ranked = running_totals(ties, [], [F.col("_v")], value_bucket(F.col("_v")), {"_before": F.col("_c")})
    total = pot.agg(F.count(F.lit(1)))
    share = (F.col("_before") + (F.col("_c") + 1) / 2) / total.scalar()
    out = pot.join(ranked.select("_v", share.alias("expression_potential_rank")), "_v")
    score = F.col("base_model_score") * F.pow("expression_potential_rank", F.lit(float(power)))
    out = out.withColumns({"expression_potential_score": F.col("potential"), "model_score": score, "validation_score_method": F.lit("model_x_expression_potential")})
    return out.withColumn("confidence", F.col("model_score")).drop("_v", "potential")


def distance_decay_with_controls(
    labelled: DataFrame, lr: DataFrame, nz: DataFrame, genes: DataFrame, means_all: DataFrame, *, max_cells: int | None = None, seed: int = 0, controls: Sequence[str] = ("matched_random_lr", "score_permutation")
) -> DataFrame:
    """Decay of the table itself, of a matched random draw of it, and with shuffled model scores."""
    weights = decay_weights(labelled, max_cells=max_cells, seed=seed)
    out = distance_decay(labelled, lr, means_all, weights=weights).withColumn("validation_strategy", F.lit("dbfree"))
    for control in controls:
        if control == "matched_random_lr":
            pool = materialize(matched_pool(lr, gene_match_table(lr, gene_means(nz, labelled, genes))))
            drawn = matched_random_lr(lr, pool, 1, seed=seed + 1701).select("ligand", "receptor", "model_score").distinct()
        elif control == "score_permutation":
            drawn = shuffled_values(lr.select("ligand", "receptor", "model_score"), "model_score", 1, id_cols=["ligand", "receptor"], seed=seed + 1701).drop("iteration")
        else:
            raise ValueError(f"Unknown control: {control}")
        part = distance_decay(labelled, materialize(drawn), means_all, weights=weights)
        out = out.unionByName(part.withColumn("validation_strategy", F.lit(control)))
    return out


# --- comparisons --------------------------------------------------------------------------

def _keys(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [*names, *(["null_model"] if "null_model" in df.columns else [])]


def baseline_comparison(topk: DataFrame, *, main: str = "dbfree") -> DataFrame:
    """Mean statistics per strategy and the z difference to the main one."""
    df = with_reporting_names(topk)
    keys = _keys(df, ["dataset", "species", "section_id", "kernel", "score_type", "k"])
    per = df.groupBy(*keys, "validation_strategy").agg(
        F.avg("observed_mean").alias("observed_mean"), F.avg("null_mean").alias("null_mean"), F.avg("null_sd").alias("null_sd"),
        F.avg("top_k_enrichment_z").alias("enrichment_z"), F.avg("top_k_empirical_pvalue").alias("empirical_p"), F.max("n_permutations").alias("n_permutations"),
    )
    ref = per.where(F.col("validation_strategy") == main).select(*keys, F.col("enrichment_z").alias(f"{main}_enrichment_z"))
    out = per.join(ref, keys, "left")
    delta = F.col("enrichment_z") - F.col(f"{main}_enrichment_z")
    return out.withColumns({f"delta_z_vs_{main}": delta, f"{main}_delta_z_vs_strategy": -delta, "top_k": F.col("k")})


def baseline_section_delta(topk: DataFrame, *, main: str = "dbfree") -> DataFrame:
    """Main strategy minus the best baseline per key; rows without a z drop."""
    df = with_reporting_names(topk)
    keys = _keys(df, ["dataset", "species", "section_id", "kernel", "score_type", "k"])
    per = df.groupBy(*keys, "validation_strategy").agg(
        F.avg(F.nanvl(F.col("enrichment_z").cast("double"), F.lit(None).cast("double"))).alias("z"), F.avg("empirical_p").alias("p"), F.avg("observed_score").alias("o"), F.max("n_permutations").alias("n_permutations")
    ).where("z IS NOT NULL")
    own = per.where(F.col("validation_strategy") == main).select(
        *keys, F.col("z").alias(f"{main}_enrichment_z"), F.col("p").alias(f"{main}_empirical_p"), F.col("o").alias(f"{main}_observed_score"), "n_permutations"
    )
    rivals = per.where(F.col("validation_strategy").isin(list(BASELINE_STRATEGIES)))
    best = first_per_key(rivals, keys, [-F.col("z"), F.col("validation_strategy")]).select(
        *keys, F.col("validation_strategy").alias("best_non_model_strategy"), F.col("z").alias("best_non_model_enrichment_z"), F.col("p").alias("best_non_model_empirical_p"), F.col("o").alias("best_non_model_observed_score")
    )
    out = own.join(best, keys)
    return out.withColumns({"delta_z": F.col(f"{main}_enrichment_z") - F.col("best_non_model_enrichment_z"), "top_k": F.col("k")})


def section_delta_summary(delta: DataFrame, *, iterations: int = 10_000, seed: int = 0) -> DataFrame:
    """Median and mean delta over sections with a bootstrap interval of the median."""
    keys = _keys(delta, ["dataset", "species", "kernel", "score_type", "k"])
    rows = materialize(delta.where("delta_z IS NOT NULL").select(*keys, "section_id", F.col("delta_z").cast("double").alias("delta_z")))
    stats = rows.groupBy(*keys).agg(
        F.count_distinct("section_id").alias("n_sections"), F.avg("delta_z").alias("mean_delta_z"), F.avg((F.col("delta_z") > 0).cast("double")).alias("fraction_positive_delta_z"), F.count(F.lit(1)).alias("_n")
    )
    mid = quantiles(rows, keys, "delta_z", [0.5]).withColumnRenamed("q0", "median_delta_z")
    order = [F.col("delta_z"), F.col("section_id")]
    placed = running_totals(rows, keys, order, value_bucket(F.col("delta_z")), {"_pos": F.lit(1).cast("bigint")}).select(*keys, "_pos", "delta_z")
    draws = stats.select(*keys, "_n", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("_i")).withColumn("_d", F.explode(F.sequence(F.lit(0), F.col("_n").cast("int") - 1)))
    u = hash_unit(seed, F.concat_ws("\u0001", *[F.col(k).cast("string") for k in keys]), F.col("_i"), F.col("_d"))
    drawn = draws.withColumn("_pos", F.floor(u * F.col("_n"))).join(placed, [*keys, "_pos"])
    medians = quantiles(drawn, [*keys, "_i"], "delta_z", [0.5])
    band = quantiles(medians, keys, "q0", [0.025, 0.975]).withColumnsRenamed({"q0": "bootstrap_ci_low", "q1": "bootstrap_ci_high"})
    out = stats.drop("_n").join(mid, keys).join(band, keys)
    return out.withColumns({"top_k": F.col("k"), "random_seed": F.lit(seed), "bootstrap_iterations": F.lit(iterations)})


# --- gates --------------------------------------------------------------------------------

def gate(dataset: str, category: str, name: str, evidence: DataFrame, passed: Column, text_: Column) -> DataFrame:
    """One gate row from a one-row evidence table."""
    return evidence.select(F.lit(dataset).alias("dataset"), F.lit(category).alias("category"), F.lit(name).alias("gate"), F.coalesce(passed, F.lit(False)).alias("passed"), text_.alias("evidence"))


def gene_match_gate(dataset: str, match_summary: DataFrame, minimum: float = 0.0) -> DataFrame:
    share = F.when(F.col("n_expression_genes") > 0, F.col("n_matched_genes") / F.col("n_expression_genes")).otherwise(0.0)
    return gate(dataset, "sequence", "gene_match_fraction", match_summary, share >= minimum, F.format_string("matched_fraction=%.3f; threshold=%.3f", share, F.lit(float(minimum))))


def lr_gene_coverage_gate(dataset: str, predicted: DataFrame, match: DataFrame, minimum: float = 0.7) -> DataFrame:
    genes = predicted.select(F.explode(F.array("ligand", "receptor")).alias("gene_id")).distinct()
    known = match.where("in_expression").select("gene_id", F.lit(1).alias("_k")).distinct()
    e = genes.join(known, "gene_id", "left").agg(F.count("_k").alias("covered"), F.count(F.lit(1)).alias("total"))
    share = F.when(F.col("total") > 0, F.col("covered") / F.col("total")).otherwise(0.0)
    note = F.format_string("covered=%d; total=%d; fraction=%.3f; threshold=%.3f", "covered", "total", share, F.lit(float(minimum)))
    return gate(dataset, "sequence", "predicted_lr_gene_coverage", e, share >= minimum, note)


def _missing(have: DataFrame, column: str, wanted: Sequence[str]) -> Column:
    """Sorted wanted values that do not occur, as one ``,`` string (inside an aggregate)."""
    want = F.array(*[F.lit(str(w)) for w in sorted(map(str, wanted))])
    return F.array_join(F.array_except(want, F.collect_set(F.col(column).cast("string"))), ",")


def required_sections_gate(dataset: str, qc: DataFrame, required: Sequence[str], section: str = "section_id") -> DataFrame:
    e = qc.agg(_missing(qc, section, required).alias("missing"))
    return gate(dataset, "data", "required_final_sections_prepared", e, F.col("missing") == "", F.concat(F.lit(f"required={','.join(required)}; missing="), F.col("missing")))


def design_gate(
    dataset: str, topk: DataFrame, *, kernels: Sequence[str], nulls: Sequence[str], strategies: Sequence[str], ks: Sequence[int], final_permutations: int | None = None
) -> DataFrame:
    """Every kernel, null, strategy and k present, with enough permutations."""
    e = topk.agg(
        _missing(topk, "kernel", kernels).alias("k"), _missing(topk, "null_model", nulls).alias("n"), _missing(topk, "validation_strategy", strategies).alias("s"),
        _missing(topk, "k", [str(x) for x in ks]).alias("t"), F.max("n_permutations").alias("p"),
    )
    enough = F.lit(True) if final_permutations is None else F.col("p") >= final_permutations
    ok = (F.col("k") == "") & (F.col("n") == "") & (F.col("s") == "") & (F.col("t") == "") & enough
    note = F.format_string("missing_kernels=%s; missing_nulls=%s; missing_strategies=%s; missing_topk=%s; max_permutations=%s", "k", "n", "s", "t", F.col("p").cast("string"))
    return gate(dataset, "spatial", "topk_design_complete", e, ok, note)


def primary_topk(topk: DataFrame) -> DataFrame:
    """Exp kernel, weighted score; the matched null when there is one."""
    rows = topk.where("kernel = 'exp' AND score_type = 'model_weighted_spatial_ccc_score'")
    if "null_model" not in topk.columns:
        return rows
    any_matched = rows.agg(F.max(F.col("null_model") == "matched_random_lr"))
    rows = rows.withColumn("_any", F.coalesce(any_matched.scalar(), F.lit(False)))
    return rows.where("NOT _any OR null_model = 'matched_random_lr'").drop("_any")


def passing_sections(topk: DataFrame, *, main: str = "dbfree", rival: str = "role_only", ks: Sequence[int] = (500, 1000)) -> DataFrame:
    """Sections where the main strategy is enriched (z >= 2, p <= 0.05) and beats the rival, by its
    best z or by more enriched rows."""
    rows = primary_topk(topk).where(F.col("k").isin(list(ks)))
    good = (F.col("top_k_enrichment_z") >= 2.0) & (F.col("top_k_empirical_pvalue") <= 0.05)
    is_main, is_rival = F.col("validation_strategy") == main, F.col("validation_strategy") == rival
    per = rows.groupBy("section_id").agg(
        F.count_if(is_main & good).alias("m"), F.count_if(is_rival & good).alias("r"), F.max(F.when(is_main, F.col("top_k_enrichment_z"))).alias("mz"), F.max(F.when(is_rival, F.col("top_k_enrichment_z"))).alias("rz"),
        F.count_if(is_rival).alias("n_rival"),
    )
    return per.where("m > 0 AND n_rival > 0 AND (mz > rz OR m > r)").select("section_id")


def section_gate(dataset: str, topk: DataFrame, minimum: int = 2, **options) -> DataFrame:
    e = passing_sections(topk, **options).agg(F.count(F.lit(1)).alias("n"))
    return gate(dataset, "spatial", "main_gate", e, F.col("n") >= minimum, F.format_string("passing_sections=%d", "n"))


def feasibility_gate(dataset: str, topk: DataFrame, *, main: str = "dbfree", ks: Sequence[int] = (500, 1000)) -> DataFrame:
    rows = primary_topk(topk).where((F.col("validation_strategy") == main) & F.col("k").isin(list(ks)) & (F.col("top_k_enrichment_z") > 0) & (F.col("observed_mean") > F.col("null_mean")))
    e = rows.agg(F.count_distinct("section_id").alias("n"))
    return gate(dataset, "spatial", "feasibility_gate", e, F.col("n") >= 1, F.format_string("passing_sections=%d", "n"))


def warning_gate(dataset: str, summary: DataFrame, forbidden: Sequence[str]) -> DataFrame:
    """Passes if no row warns of anything ``forbidden``; only forbidden warnings are gathered."""
    named = F.array(*[F.lit(f) for f in sorted(set(forbidden))])
    e = summary.select(F.explode(F.array_intersect(named, tokens("warning", ";"))).alias("w"))
    e = e.agg(F.array_join(F.array_sort(F.collect_set("w")), ",").alias("bad"))
    return gate(dataset, "model", "no_fixture_warnings", e, F.col("bad") == "", F.concat(F.lit("forbidden="), F.col("bad")))


def decay_controls_gate(dataset: str, decay: DataFrame, required: Sequence[str] = ("dbfree", "matched_random_lr", "score_permutation")) -> DataFrame:
    e = decay.agg(_missing(decay, "validation_strategy", required).alias("missing"))
    return gate(dataset, "spatial", "distance_decay_controls_present", e, F.col("missing") == "", F.concat(F.lit("missing="), F.col("missing")))


def all_gates(gates: Sequence[DataFrame]) -> DataFrame:
    out = gates[0]
    for g in gates[1:]:
        out = out.unionByName(g)
    return out


# --- sampling and parity ------------------------------------------------------------------

def shared_groups(cells: DataFrame, groupby: str, condition_key: str, a: str, b: str, top_n: int = 0) -> DataFrame:
    """Groups with cells in both conditions, largest totals first."""
    c = F.col(condition_key).cast("string")
    per = cells.groupBy(F.col(groupby).cast("string").alias("group")).agg(F.count_if(c == a).alias("n_a"), F.count_if(c == b).alias("n_b")).where("n_a > 0 AND n_b > 0")
    per = per.withColumn("total", F.col("n_a") + F.col("n_b"))
    return per if top_n <= 0 else per.orderBy(F.desc("total"), "group").limit(top_n)


def capped_sample(cells: DataFrame, keys: Sequence[str], max_per_key: int, *, seed: int = 0, id_col: str = "cell_id") -> DataFrame:
    """At most so many cells per key combination, by hash order."""
    hashed = cells.withColumn("_h", hash_long(seed, F.lit("capped"), F.col(id_col)))
    return top_per_key(hashed, keys, [F.col("_h"), F.col(id_col)], max_per_key).drop("_h")


def parity_metrics(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str = "prob", *, name: str = "values", top_n: int = 20) -> DataFrame:
    """Agreement of two tables on their keys, a missing row counting as 0: correlations,
    differences, overlap of the largest values."""
    x = a.select(*keys, F.col(value).cast("double").alias("x"))
    y = b.select(*keys, F.col(value).cast("double").alias("y"))
    both = x.join(y, list(keys), "full_outer").fillna(0.0, ["x", "y"])
    # sums that differ in the last bits only are ties
    both = materialize(both.withColumns({"_rx": F.round("x", 9), "_ry": F.round("y", 9)}))
    ranked = both
    for c in ("_rx", "_ry"):
        ties = both.groupBy(c).agg(F.count(F.lit(1)).alias("_c"))
        r = running_totals(ties, [], [F.col(c)], value_bucket(F.col(c)), {"_b": F.col("_c")})
        ranked = ranked.join(r.select(c, (F.col("_b") + (F.col("_c") + 1) / 2).alias(f"rank{c}")), c)
    gap = F.abs(F.col("x") - F.col("y"))
    stats = ranked.agg(
        F.count(F.lit(1)).alias("n_values"), F.corr("x", "y").alias("_p"), F.corr("rank_rx", "rank_ry").alias("_s"), F.max(gap).alias("max_abs_diff"),
        F.stddev_pop("x").alias("_sx"), F.stddev_pop("y").alias("_sy"), F.max(gap - 1e-8 - 1e-5 * F.abs("y")).alias("_close"),
    )
    mid = quantiles(both.withColumn("_gap", gap), [], "_gap", [0.5])
    ident = [F.col(k) for k in keys]
    keyed = both.withColumn("_k", F.lit(0))
    tops = [top_per_key(keyed, ["_k"], [F.desc(c), *ident], top_n).select(*keys) for c in ("x", "y")]
    overlap = tops[0].join(tops[1], list(keys), "left_semi").agg(F.count(F.lit(1)))
    flat = (F.col("n_values") < 2) | (F.col("_sx") == 0) | (F.col("_sy") == 0)
    same = F.when(F.col("_close") <= 0, 1.0)
    size = F.least(F.lit(top_n), F.col("n_values"))
    out = stats.withColumn("median_abs_diff", mid.select("q0").scalar()).withColumn("_o", overlap.scalar())
    return out.select(
        F.lit(name).alias("analysis"), "n_values", F.when(flat, same).otherwise(F.col("_p")).alias("pearson"), F.when(flat, same).otherwise(F.col("_s")).alias("spearman"),
        "max_abs_diff", "median_abs_diff", F.when(size > 0, F.col("_o") / size).otherwise(1.0).alias(f"top{top_n}_overlap"),
    )


