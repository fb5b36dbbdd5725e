"""All queries of the library over the driver's tables."""

from quern.queries import forum, ingest, search, text  # noqa: F401
from quern.queries.registry import all_queries, all_sql  # noqa: F401
