"""Registered plans over the driver's tables."""

from sparkloom.plans import consensus_plans, corpus_plans, integrity_plans, matching_plans, set_plans, stats_plans, vector_plans  # noqa: F401
