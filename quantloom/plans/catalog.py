"""Registered queries and their SQL, from the modules of this folder."""

from __future__ import annotations

from . import evaluations, extended, markets, ranking, research, stored, validation


def queries() -> dict:
    return {**research.Q, **markets.Q, **ranking.Q, **extended.Q, **stored.Q, **validation.Q, **evaluations.Q}


def oracle_sql() -> dict[str, str]:
    return {**research.SQL, **markets.SQL, **ranking.SQL, **extended.SQL, **stored.SQL, **validation.SQL, **evaluations.SQL}
