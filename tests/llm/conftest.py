from __future__ import annotations

import pytest

TEXTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Documents from texts, or from (id, text) or (id, text, lang, source); columns of other operators' names are added."""

    def make(*rows):
        filled = []
        for number, row in enumerate(rows):
            row = row if isinstance(row, tuple) else (number, row)
            doc_id, text, lang, source = (*row, *(None, "en", "s")[len(row) - 1 :])
            filled.append((doc_id, text, lang, source, len(text or "")))
        frame = spark.createDataFrame(filled, TEXTS)
        return frame.selectExpr(
            "*", "'x' as host", "1L as row_id", "2 as set_id", "'y' as label", "3 as copy", "true as kept", "0 as slot", "1 as n"
        )

    return make
