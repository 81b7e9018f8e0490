"""All registered queries and their SQL, gathered from the plans modules."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

PLANS = ("scalars", "areas", "hours", "columns", "objects", "radar", "stencils", "files", "requests", "catalogues", "checks")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _name in PLANS:
    _plan = import_module(f"cumula.plans.{_name}")
    QUERIES |= _plan.QUERIES
    ORACLES |= _plan.ORACLES
