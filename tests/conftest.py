import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from cueflow.session import build_session

    session = build_session(
        "cueflow-tests",
        **{
            "spark.master": "local[8]",
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-"),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def segments(spark):
    """Builds segments from (doc_id, idx, start_ms, end_ms, text), positions in list order."""

    def build(rows):
        counts, out = {}, []
        for doc, idx, start, end, text in rows:
            pos = counts.get(doc, 0)
            counts[doc] = pos + 1
            out.append((doc, pos, idx, start, end, text))
        return spark.createDataFrame(
            out, "doc_id string, pos long, idx long, start_ms long, end_ms long, text string"
        )

    return build
