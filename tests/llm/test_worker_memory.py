"""What keeps the Python workers of the pipeline small: short chunks, and no workers for a few rows of the driver's."""

import pyarrow as pa
import pytest

from helixframe.llm import jaccard_join, quality_rules
from helixframe.llm import shared


@pytest.mark.parametrize("module", [quality_rules, jaccard_join])
def test_chunks_are_short(module):
    parts = list(module.chunks(pa.array(["ab" * 5000] * 100)))
    assert max(len(c.data) for c in parts) <= 1 << 18 and sum(c.n for c in parts) == 100


def test_local_rows_need_no_python_workers(spark):
    rows = [("de", 1.5), (None, 2.0)]
    df = shared.local_rows(spark, rows, "_lang string, _middle double")
    assert [tuple(r) for r in df.collect()] == rows
    assert shared.local_rows(spark, [], "_lang string, _middle double").count() == 0
    assert "PythonRDD" not in df._jdf.queryExecution().toRdd().toDebugString()
