from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture
def table(spark):
    """A documents table from ``{doc_id: text}`` or rows ``(doc_id, text)``, with clashing extra columns."""
    def build(rows, source=lambda i: f"s{(i or 0) % 3}", copies: int = 3):
        rows = list(rows.items()) if isinstance(rows, dict) else list(rows)
        data = [(i, t, "en", source(i), len(t or ""), "x", 1, "y", -1) for i, t in rows]
        return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, "
                                     "size string, key int, toxicity string, taken int").repartition(copies)
    return build
