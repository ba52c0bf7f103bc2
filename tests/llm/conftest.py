"""Every test of this folder runs with the package shipped to the workers."""

from __future__ import annotations

import pytest

from utilscope.llm.shipping import ship


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


TEXTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """A maker of document frames from (doc_id, text) pairs, with columns that clash with inner names."""
    def make(pairs):
        rows = [(i, t, "en", "src", len(t or "")) for i, t in pairs]
        df = spark.createDataFrame(rows, TEXTS)
        return df.selectExpr("*", "1L as node", "'x' as id", "2 as n", "'y' as key", "3 as shard", "'z' as label")

    return make
