"""Queries of the behaviour engine and their SQL."""

from __future__ import annotations

from ethogrid.plans import behaviour, behaviour_sql, checks, detections, pipelines, subjects, training

QUERIES = behaviour.QUERIES | subjects.QUERIES | pipelines.QUERIES | detections.QUERIES | checks.QUERIES | training.QUERIES
ORACLE_SQL = behaviour_sql.ORACLE | subjects.ORACLE | pipelines.ORACLE | detections.ORACLE | checks.ORACLE | training.ORACLE
flagship = behaviour.flagship
