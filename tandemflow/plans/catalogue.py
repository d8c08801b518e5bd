"""All registered queries."""

from __future__ import annotations

from . import abundance, features, matches, more, pipelines, rules, services, sets, summaries
from .registry import ORACLES, QUERIES

MODULES = (matches, sets, features, abundance, more, pipelines, rules, summaries, services)
__all__ = ["MODULES", "ORACLES", "QUERIES"]
