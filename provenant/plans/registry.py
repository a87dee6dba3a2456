"""All parity queries by name, with the DuckDB SQL that gives the same rows."""

from provenant.plans import evaluation  # noqa: F401  (its queries add themselves)
from provenant.plans.queries import ORACLE_SQL, QUERIES

FLAGSHIP = QUERIES["audit_rank_gated"]

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
