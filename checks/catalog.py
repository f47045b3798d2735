"""All checked queries by name."""

from checks import clean, models, profiles, signals  # noqa: F401  (they register their queries)
from checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
