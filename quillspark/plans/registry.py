"""All named queries, and the SQL of those that SQL can express."""

from __future__ import annotations

from quillspark.plans import direct, federated, linking, lookups, matching, outputs, records, shown, verification

_PARTS = (matching, records, verification, outputs, lookups, federated, linking, direct, shown)
QUERIES: dict = {}
ORACLES: dict = {}
for _part in _PARTS:
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
