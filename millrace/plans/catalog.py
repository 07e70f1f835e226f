"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from millrace.plans import composite, decoded, files, judged, relational, runs, scans, sequence, streams, textual
from millrace.plans.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "composite", "decoded", "files", "judged", "relational", "runs", "scans", "sequence", "streams", "textual"]
