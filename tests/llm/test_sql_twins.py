import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import compare, duck  # noqa: E402

from sparkcomm.llm import queries  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    said = compare(spark, duck(SF), SF, queries.QUERIES[name], queries.SQL[name])
    assert said.startswith("ok"), said
