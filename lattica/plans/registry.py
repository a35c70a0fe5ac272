"""All queries of the library, with their SQL."""

from lattica.plans import audits as _audits  # noqa: F401  registers its queries
from lattica.plans import notation as _notation  # noqa: F401
from lattica.plans import scoring as _scoring  # noqa: F401
from lattica.plans.queries import ORACLE_SQL, QUERIES, flagship

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
