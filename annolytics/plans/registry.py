"""All named queries; importing the family modules fills the catalogue."""

from . import catalog_examples, catalog_measures, catalog_tables, catalog_text  # noqa: F401
from .catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
