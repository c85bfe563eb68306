"""The registered queries; each module adds its own to ``queries.QUERIES`` and ``queries.SQL``."""

from palimpsest.plans import growing, queries, reports

__all__ = ["growing", "queries", "reports"]
