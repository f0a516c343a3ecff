"""Queries of the training-data operators, by name."""

from __future__ import annotations

import corpus_pipeline
from tempestry.llm import op_queries, oracles

QUERIES = {**op_queries.QUERIES, "pipeline": corpus_pipeline.run}
ORACLES = dict(oracles.ORACLES)
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
