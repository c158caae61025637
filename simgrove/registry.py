"""Registered queries and their SQL."""

from __future__ import annotations

from simgrove.plans import geometry, work

QUERIES: dict = geometry.Q | work.Q
ORACLE_SQL: dict[str, str] = geometry.SQL | work.SQL
