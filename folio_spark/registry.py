"""Named queries of the engine's own operators, and their SQL."""

from __future__ import annotations

from folio_spark.plans import reports  # noqa: F401  (it registers its queries)
from folio_spark.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
