"""Every query of the library by name, with the SQL that must give the same rows."""

from . import job_queries, source_queries, text_queries, vector_queries, view_queries  # noqa: F401  each registers its queries
from .registry import ORACLES, QUERIES  # noqa: F401
