"""Registered queries and their SQL."""

from lectern.plans import extended, lifecycle, records  # noqa: F401  (they register their queries)
