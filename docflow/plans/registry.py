"""All queries by name, with the same in DuckDB SQL where SQL can express them."""

from __future__ import annotations

from docflow.plans.queries import ORACLES, QUERIES

FLAGSHIP = "coverage_report"
__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
