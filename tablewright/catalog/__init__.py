"""Every operator as a query over the test tables, with the SQL that must give the same rows."""

from tablewright.catalog import charts, cleaning, profile, quality, sources
from tablewright.catalog.base import REGISTRY, Entry

__all__ = ["REGISTRY", "Entry", "charts", "cleaning", "profile", "quality", "sources"]
