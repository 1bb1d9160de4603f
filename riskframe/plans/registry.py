"""All registered queries: importing the catalog modules fills QUERIES and SQL."""

from . import catalog, catalog_boost, catalog_depth, catalog_io, catalog_metrics, catalog_model, catalog_prep, catalog_scoring, catalog_streams  # noqa: F401
from .catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
