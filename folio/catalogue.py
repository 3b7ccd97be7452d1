"""All queries by name, bound to the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from folio.plans import batches, blocks, editing, gating, geometry, layouts, pages, records, tables, verifying
from folio.plans.registry import ORACLE, QUERIES

__all__ = ["MODULES", "ORACLE", "QUERIES"]

#: Imported for the queries that they register.
MODULES = (batches, blocks, editing, gating, geometry, layouts, pages, records, tables, verifying)
