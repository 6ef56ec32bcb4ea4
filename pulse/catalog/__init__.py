"""Every operator and job on the test tables, each with its check SQL."""

from pulse.catalog import activity, learning, market, rows, tables, text
from pulse.catalog.base import REGISTRY, Query, Tables

__all__ = ["REGISTRY", "Query", "Tables", "activity", "learning", "market", "rows", "tables", "text"]
