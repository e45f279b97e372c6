"""The catalogue of the engine's own queries."""

from chronoplane.plans import continuity, cycles, evidence, health, holdings, market, policies, records, reports, research, series
from chronoplane.plans.registry import CATALOGUE

__all__ = ["continuity", "cycles", "evidence", "health", "holdings", "market", "policies", "records", "reports", "research", "series"]


def queries() -> dict:
    return {name: f for name, (f, _) in CATALOGUE.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in CATALOGUE.items() if sql}
