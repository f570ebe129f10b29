"""Every operator run over the test tables, each next to the SQL that checks it."""

from tidemark.queries import landing, marts, ops, parity, quality, syncing  # noqa: F401
from tidemark.queries.catalogue import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
