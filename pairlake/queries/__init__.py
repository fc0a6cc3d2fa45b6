"""Named queries and their SQL: one registry for each area."""

from __future__ import annotations

from . import building, detection, evaluation, files, governing, lexical, pairing, probing, retrieval, scoring, validation

AREAS = (detection, retrieval, pairing, lexical, validation, governing, evaluation, scoring, building, files, probing)

QUERIES = {k: v for a in AREAS for k, v in a.QUERIES.items()}
ORACLES = {k: v for a in AREAS for k, v in a.ORACLES.items()}
