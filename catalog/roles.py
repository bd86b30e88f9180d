"""How the driver tables play the domain roles, in Spark and as SQL CTEs.

Customers are cells, brands are genes, quantities bought are expression values, market
segments are groups, regions are sections.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcomm.functions.hashing import hash_unit
from sparkcomm.session import honest_sizes, materialize


_SEEN: dict = {}


def once(spark: SparkSession, sf: str, name: str, build, *, write: bool = True) -> DataFrame:
    """Derive a table once per application and data folder; queries share it as a user would."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _SEEN:
        _SEEN[key] = materialize(build()) if write else build()
    return _SEEN[key]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    honest_sizes(spark)
    return once(spark, sf_dir, f"table {name}", lambda: spark.read.parquet(f"{sf_dir}/{name}.parquet"), write=False)


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.select(
        F.col("c_custkey").cast("string").alias("cell_id"),
        F.col("c_mktsegment").alias("segment"),
        F.col("r_name").alias("section"),
        F.col("c_acctbal").alias("x"),
        ((F.col("c_custkey") * 37) % 10000).cast("double").alias("y"),
    )


CELLS = """cells AS (
  SELECT CAST(c_custkey AS VARCHAR) AS cell_id, c_mktsegment AS grp, r_name AS section,
         c_acctbal AS x, CAST((c_custkey * 37) % 10000 AS DOUBLE) AS y
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").select("o_orderkey", "o_custkey")
    l = read(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag")
    p = read(spark, sf, "part").select("p_partkey", "p_brand")
    # hashed by the sides with one row a key, so that no task sorts its lines; orders last, for sums by order where the lines then are
    return l.join(p.hint("shuffle_hash"), F.col("l_partkey") == F.col("p_partkey")).join(o.hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey"))


def _summed(rows: DataFrame, cell: str) -> DataFrame:
    """Quantities by cell and brand; keys are numbers until they are summed."""
    return rows.groupBy(cell, "p_brand").agg(F.sum("l_quantity").alias("value")).select(F.col(cell).cast("string").alias("cell_id"), F.col("p_brand").alias("gene"), "value")


def _expression(spark: SparkSession, sf: str, flag: str | None = None) -> DataFrame:
    rows = _lines(spark, sf)
    if flag is not None:
        rows = rows.where(F.col("l_returnflag") == flag)
    return _summed(rows, "o_custkey")


def expr_sql(flag: str | None = None, name: str = "expr") -> str:
    where = f"WHERE l_returnflag = '{flag}'" if flag else ""
    return f"""{name} AS (
  SELECT CAST(o_custkey AS VARCHAR) AS cell_id, p_brand AS gene, SUM(l_quantity) AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey {where}
  GROUP BY 1, 2)"""


def _order_cells(spark: SparkSession, sf: str) -> DataFrame:
    """A sparser matrix: orders as cells, grouped by priority."""
    return read(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("cell_id"), F.col("o_orderpriority").alias("segment"), F.col("o_orderstatus").alias("section")
    )


ORDER_CELLS = "cells AS (SELECT CAST(o_orderkey AS VARCHAR) AS cell_id, o_orderpriority AS grp, o_orderstatus AS section FROM orders)"


def _order_expression(spark: SparkSession, sf: str) -> DataFrame:
    return _summed(_lines(spark, sf), "o_orderkey")


ORDER_EXPR = """expr AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS cell_id, p_brand AS gene, SUM(l_quantity) AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  GROUP BY 1, 2)"""


def _genes(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").select(F.col("p_brand").alias("gene")).distinct()


def _lr_table(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered brand pairs; receptors of the high numbers are two-part complexes."""
    g = genes(spark, sf).select("gene", F.substring("gene", 7, 9).cast("int").alias("i"))
    a, b = g.select(F.col("gene").alias("ga"), F.col("i")), g.select(F.col("gene").alias("gb"), F.col("i").alias("j"))
    pairs = a.join(b, F.col("i") < F.col("j"))
    brand = lambda n: F.concat(F.lit("Brand#"), n.cast("string"))
    i, j = F.col("i"), F.col("j")
    return pairs.select(
        F.col("ga").alias("ligand"),
        F.when(j >= 17, F.concat_ws("_", F.col("gb"), brand(j - 10))).otherwise(F.col("gb")).alias("receptor"),
        F.concat(F.lit("P"), ((i + j) % 6).cast("string")).alias("pathway"),
        F.concat(F.lit("A"), (i % 3).cast("string")).alias("annotation"),
        F.lit("").alias("evidence"),
        F.when(j <= 8, brand(i % 25 + 1)).otherwise("").alias("agonist_genes"),
        F.when(i >= 15, brand(j % 25 + 1)).otherwise("").alias("antagonist_genes"),
        F.when(i <= 4, F.concat_ws("_", brand(j % 25 + 1), brand(i + 12))).otherwise("").alias("co_A_receptor_genes"),
        F.when((i > 4) & (i < 9), brand(i + 9)).otherwise("").alias("co_I_receptor_genes"),
        F.when(j == 9, F.concat(F.lit("N"), i.cast("string"), F.lit(" / N"), j.cast("string"))).otherwise("").alias("interaction_name_2"),
    )


LR = """genes AS (SELECT DISTINCT p_brand AS gene, CAST(substr(p_brand, 7) AS INTEGER) AS i FROM part),
lr AS (
  SELECT a.gene AS ligand,
    CASE WHEN b.i >= 17 THEN b.gene || '_' || 'Brand#' || CAST(b.i - 10 AS VARCHAR) ELSE b.gene END AS receptor,
    'P' || CAST((a.i + b.i) % 6 AS VARCHAR) AS pathway, 'A' || CAST(a.i % 3 AS VARCHAR) AS annotation, '' AS evidence,
    CASE WHEN b.i <= 8 THEN 'Brand#' || CAST(a.i % 25 + 1 AS VARCHAR) ELSE '' END AS agonist_genes,
    CASE WHEN a.i >= 15 THEN 'Brand#' || CAST(b.i % 25 + 1 AS VARCHAR) ELSE '' END AS antagonist_genes,
    CASE WHEN a.i <= 4 THEN 'Brand#' || CAST(b.i % 25 + 1 AS VARCHAR) || '_Brand#' || CAST(a.i + 12 AS VARCHAR) ELSE '' END AS co_A_receptor_genes,
    CASE WHEN a.i > 4 AND a.i < 9 THEN 'Brand#' || CAST(a.i + 9 AS VARCHAR) ELSE '' END AS co_I_receptor_genes,
    CASE WHEN b.i = 9 THEN 'N' || CAST(a.i AS VARCHAR) || ' / N' || CAST(b.i AS VARCHAR) ELSE '' END AS interaction_name_2
  FROM genes a JOIN genes b ON a.i < b.i)"""


def _curated_lr(spark: SparkSession, sf: str) -> DataFrame:
    """Known pairs: those whose ligand and receptor numbers add up to at most 20."""
    number = lambda c: F.substring(c, 7, 9).cast("int")
    lr = lr_table(spark, sf).where(~F.col("receptor").contains("_"))
    return lr.where(number("ligand") + number("receptor") <= 20).select("ligand", "receptor", "pathway", "annotation", "evidence")


CURATED = """curated AS (
  SELECT ligand, receptor FROM lr WHERE position('_' IN receptor) = 0
    AND CAST(substr(ligand, 7) AS INTEGER) + CAST(substr(receptor, 7) AS INTEGER) <= 20)"""


def _scored_lr(spark: SparkSession, sf: str) -> DataFrame:
    """Single-gene LR rows with model and role scores from hashes of the names."""
    lr = lr_table(spark, sf).where(~F.col("receptor").contains("_")).select("ligand", "receptor", "pathway", "annotation", "evidence")
    pair = F.concat_ws(">", "ligand", "receptor")
    return lr.withColumns(
        {
            "model_score": F.round(hash_unit(F.lit("m"), pair), 4),
            "ligand_role_score": F.round(hash_unit(F.lit("lr"), F.col("ligand")), 4),
            "receptor_role_score": F.round(hash_unit(F.lit("rr"), F.col("receptor")), 4),
            "ligand_secreted_like_score": F.round(hash_unit(F.lit("ls"), F.col("ligand")), 4),
            "ligand_membrane_like_score": F.round(hash_unit(F.lit("lm"), F.col("ligand")), 4),
            "receptor_membrane_like_score": F.round(hash_unit(F.lit("rm"), F.col("receptor")), 4),
        }
    )


def hash_long_sql(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13) AS BIGINT)"


def hash_unit_sql(*parts: str) -> str:
    return f"({hash_long_sql(*parts)} / 4503599627370496.0)"


_PAIR = "ligand || '>' || receptor"
SCORED_LR = f"""slr AS (
  SELECT ligand, receptor, pathway, annotation,
    round({hash_unit_sql("'m'", _PAIR)}, 4) AS model_score,
    round({hash_unit_sql("'lr'", 'ligand')}, 4) AS ligand_role_score,
    round({hash_unit_sql("'rr'", 'receptor')}, 4) AS receptor_role_score,
    round({hash_unit_sql("'ls'", 'ligand')}, 4) AS ligand_secreted_like_score,
    round({hash_unit_sql("'lm'", 'ligand')}, 4) AS ligand_membrane_like_score,
    round({hash_unit_sql("'rm'", 'receptor')}, 4) AS receptor_membrane_like_score
  FROM lr WHERE position('_' IN receptor) = 0)"""


def cells(spark: SparkSession, sf: str) -> DataFrame:
    return once(spark, sf, "cells", lambda: _cells(spark, sf))


def expression(spark: SparkSession, sf: str, flag: str | None = None) -> DataFrame:
    return once(spark, sf, f"expression {flag}", lambda: _expression(spark, sf, flag))


def order_cells(spark: SparkSession, sf: str) -> DataFrame:
    return once(spark, sf, "order cells", lambda: _order_cells(spark, sf))


def order_expression(spark: SparkSession, sf: str) -> DataFrame:
    return once(spark, sf, "order expression", lambda: _order_expression(spark, sf))


def genes(spark: SparkSession, sf: str) -> DataFrame:
    return once(spark, sf, "genes", lambda: _genes(spark, sf))


def lr_table(spark: SparkSession, sf: str) -> DataFrame:
    return once(spark, sf, "lr", lambda: _lr_table(spark, sf))


def curated_lr(spark: SparkSession, sf: str) -> DataFrame:
    return once(spark, sf, "curated", lambda: _curated_lr(spark, sf))


def scored_lr(spark: SparkSession, sf: str) -> DataFrame:
    return once(spark, sf, "scored lr", lambda: _scored_lr(spark, sf))


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles at a fixed number of places (no negative zero), counts as bigint."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if kind in ("double", "float"):
            out.append((F.round(F.col(f"`{f.name}`").cast("double"), places) + F.lit(0.0)).alias(f.name))
        elif kind in ("int", "smallint", "tinyint"):
            out.append(F.col(f"`{f.name}`").cast("bigint").alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def with_sql(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
