"""Names of the core queries and their SQL."""

from __future__ import annotations

from gleaner.operators import activity_sessions
from gleaner.plans import curation, exchange, records, similarity

QUERIES = {"p1_found": activity_sessions.p1_found, "p1_sessions": activity_sessions.p1_sessions} | curation.QUERIES | similarity.QUERIES | exchange.QUERIES | records.QUERIES
ORACLES = {"p1_found": activity_sessions.P1_FOUND_SQL, "p1_sessions": activity_sessions.P1_SESSIONS_SQL} | curation.ORACLES | similarity.ORACLES | exchange.ORACLES | records.ORACLES
