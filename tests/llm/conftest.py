from __future__ import annotations

import pytest

from rollatlas.llm.shared import ship


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="session")
def docs_of(spark):
    """(doc_id, text) rows, with columns whose names clash with results."""

    def make(rows, more="score string, start string, key string, rank int, bucket int"):
        names = [x.split()[0] for x in more.split(", ")]
        schema = "doc_id long, text string, lang string, source string, n_chars long, " + more
        return spark.createDataFrame([(i, t, None, None, None, *([None] * len(names))) for i, t in rows], schema)

    return make
