"""Every registered query of the engine with the SQL that must give the same rows."""

from __future__ import annotations

from . import catalogue_metrics, catalogue_storage, catalogue_trips

QUERIES: dict = catalogue_metrics.QUERIES | catalogue_trips.QUERIES | catalogue_storage.QUERIES
ORACLES: dict[str, str] = catalogue_metrics.ORACLES | catalogue_trips.ORACLES | catalogue_storage.ORACLES
