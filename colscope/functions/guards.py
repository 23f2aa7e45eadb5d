"""Turn a violations DataFrame into a failure."""

from __future__ import annotations

from pyspark.sql import DataFrame


class ContractViolation(ValueError):
    """A check that must return no rows returned some."""


def require_empty(violations: DataFrame, message: str) -> None:
    """Fail when the violations hold a row. Stops at the first one found."""
    if not violations.isEmpty():
        raise ContractViolation(message)
