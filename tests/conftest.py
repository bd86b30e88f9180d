import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def matrix(spark):
    """Long non-zeros and cells of a small dense matrix."""

    def build(values, genes, groups, **extra):
        rows = [(f"c{i}", g, float(v)) for i, row in enumerate(values) for g, v in zip(genes, row) if v != 0]
        expression = spark.createDataFrame(rows, "cell_id string, gene string, value double")
        cells = [(f"c{i}", g, *[v[i] if isinstance(v[i], str) else float(v[i]) for v in extra.values()]) for i, g in enumerate(groups)]
        kinds = ["string" if isinstance(col[0], str) else "double" for col in extra.values()]
        schema = ", ".join(["cell_id string", "cell_type string", *[f"{k} {t}" for k, t in zip(extra, kinds)]])
        return expression, spark.createDataFrame(cells, schema)

    return build
