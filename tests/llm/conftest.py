from __future__ import annotations

import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint, lang_pred string, score double"


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text, lang, source); two further columns clash with results' names."""

    def make(rows):
        full = [(*r, *(None,) * (4 - len(r))) for r in rows]
        return spark.createDataFrame(
            [(*r, len(r[1]) if r[1] is not None else None, "x", 0.5) for r in full], DOCUMENTS
        )

    return make
