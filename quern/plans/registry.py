"""The queries of the engine and their SQL."""

from __future__ import annotations

from quern.plans import corpus, evaluation, fusion, inputs, matching, records, selection, texts
from quern.plans.texts import flagship

QUERIES = {name: f for part in (texts, matching, records, fusion, selection, inputs, corpus, evaluation) for name, (f, _) in part.QUERIES.items()}
ORACLES = {name: sql for part in (texts, matching, records, fusion, selection, inputs, corpus, evaluation) for name, (_, sql) in part.QUERIES.items() if sql}

__all__ = ["ORACLES", "QUERIES", "flagship"]
