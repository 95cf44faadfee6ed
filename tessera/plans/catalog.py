"""The catalogue of the engine's own queries."""

from __future__ import annotations

from . import compliance, matching, operations, upkeep
from .registry import ORACLES, QUERIES

MODULES = (operations, compliance, matching, upkeep)


def flagship(spark, sf_dir):
    return matching.screen_batch(spark, sf_dir)


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
