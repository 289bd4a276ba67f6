"""Closed vocabularies and frozen thresholds of a measurement."""

from __future__ import annotations

# Fixed values of the data model: names, orders and thresholds that results depend on.
VERSIONS = ["A", "A_prime", "B", "C"]
VALID = "valid"
OUTCOMES = ["valid", "unparseable", "refused", "blocked_upstream", "truncated", "empty", "off_format"]
PAIRS = {"ab": ("A", "B"), "aa": ("A", "A_prime"), "ac": ("A", "C")}
REWORDING_TYPES = ["wording", "order", "default", "anchoring"]
DROP_BOUND_MAX_PCT = 2
DROP_ASYMMETRY_MAX_PCT = 1
DEGENERATE_ENTROPY_MAX = 0.20
DEGENERATE_STABILITY_MIN_PCT = 90
BRIDGE_WINDOW_DAYS = 7
COST_PER_CALL_EUR = "0.0066"
ROTATION_EPOCH = "2026-01-01"
EVENTS_THAT_ADD = ["baseline", "appeared"]
EVENTS_THAT_REMOVE = ["gone"]
