"""Queries by name with their oracle SQL."""

from __future__ import annotations

from loomspark.plans import adapters, analytics, edits, lifecycle, lookup, streams, syncs, transcripts, upkeep

QUERIES: dict = analytics.QUERIES | lookup.QUERIES | lifecycle.QUERIES | upkeep.QUERIES | adapters.QUERIES | transcripts.QUERIES | edits.QUERIES | streams.QUERIES | syncs.QUERIES
ORACLES: dict = analytics.ORACLES | lookup.ORACLES | lifecycle.ORACLES | upkeep.ORACLES | adapters.ORACLES | transcripts.ORACLES | edits.ORACLES | streams.ORACLES | syncs.ORACLES
