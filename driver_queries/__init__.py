"""Queries over the driver tables, each with its SQL twin where SQL can say it."""

from driver_queries.base import REGISTRY, SQL

from driver_queries import answers, coverage, documents, questions, retrieval  # noqa: F401  (they register their queries)

__all__ = ["REGISTRY", "SQL"]
