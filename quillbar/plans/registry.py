"""All registered queries of the library, without those of the optional training-data folder."""

from __future__ import annotations

from quillbar.plans import bar_plans, domain_plans, kernel_plans, record_plans, set_plans  # noqa: F401  they register their queries
from quillbar.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark, sf_dir: str):
    return QUERIES["gap_islands"](spark, sf_dir)
