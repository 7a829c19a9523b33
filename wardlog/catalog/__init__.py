"""Registered queries with the SQL they agree with."""

from wardlog.catalog import behaviour, detecting, exposing, findings, parsing, reporting  # noqa: F401
from wardlog.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
