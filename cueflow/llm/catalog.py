"""All registered queries of this subpackage and of the pipeline."""

import corpus_pipeline
from cueflow.llm import queries  # noqa: F401
from cueflow.llm.registry import ORACLES, QUERIES

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL

__all__ = ["ORACLES", "QUERIES"]
