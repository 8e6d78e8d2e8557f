"""Queries of the library proper, by name."""

from __future__ import annotations

from . import cases, columns, landed, records
from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "cases", "columns", "landed", "records"]
