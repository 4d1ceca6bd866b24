"""All registered queries and the SQL that each must agree with."""

from __future__ import annotations

from . import build, files, measure, sequences, split_text, surfaces

_PLANS = (build, measure, split_text, surfaces, sequences, files)

QUERIES: dict = {name: q for m in _PLANS for name, q in m.QUERIES.items()}
SQL: dict[str, str] = {name: s for m in _PLANS for name, s in m.SQL.items()}
