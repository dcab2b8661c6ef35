import os

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def lspark(spark):
    """The test session, with this repository on its Python workers' path."""
    spark.sparkContext.environment["PYTHONPATH"] = ROOT
    return spark


@pytest.fixture(scope="session")
def docs_of(lspark):
    """Documents from (doc_id, text) or (doc_id, text, source), with columns
    whose names clash with the operators' own."""
    def made(rows):
        rows = [(*r, "s")[:3] for r in rows]
        return lspark.createDataFrame([(*r, -1, "x", 0.5, True) for r in rows],
                                      "doc_id long, text string, source string, size long, label string, score double, kept boolean")
    return made
