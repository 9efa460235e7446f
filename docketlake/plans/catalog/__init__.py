"""Registered queries: each operator applied to the star-schema test tables.

Every query comes with the SQL that states its expected result, where SQL can.
"""

from __future__ import annotations

from docketlake.plans.catalog.base import ORACLES, QUERIES
from docketlake.plans.catalog import alerts, cleaning, extraction, framing, history, landing, streams  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
