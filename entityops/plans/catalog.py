"""Imports every query module and exposes the filled registry."""

from entityops.plans import q_adjudicate, q_corpus, q_match, q_project, q_rules, q_sources, q_usage  # noqa: F401
from entityops.plans.registry import ORACLES, QUERIES  # noqa: F401
