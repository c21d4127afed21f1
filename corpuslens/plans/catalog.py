"""All queries of the library outside the corpus operators."""

from corpuslens.plans import extracting, ingesting, referencing, relational, scalars, searching, services, sourcing, streams  # noqa: F401  (each registers its own)
from corpuslens.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
