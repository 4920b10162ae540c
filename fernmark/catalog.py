"""All queries of the engine by name, with equivalent SQL where there is one."""

from __future__ import annotations

from fernmark.plans import catalogue_plans, eval_plans, field_plans, model_plans, prior_plans, search_plans, segment_plans, selection_plans, source_plans, text_plans, work_plans  # noqa: F401  they register
from fernmark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
