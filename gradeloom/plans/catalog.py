"""Registry of the queries and their SQL."""

from . import array_queries, experiment_queries, metadata_queries, metric_queries, table_queries, text_queries, window_queries  # noqa: F401
from .base import ORACLE_SQL, QUERIES  # noqa: F401
