"""Every query of the package: importing the modules that hold them fills the registry."""

from __future__ import annotations

from parlance.plans import alignment_queries, allocation_queries, audit_queries, cue_queries, evidence_queries, fidelity_queries, file_queries, interval_queries, live_queries, log_queries, note_queries, text_queries, validator_queries  # noqa: F401
from parlance.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
