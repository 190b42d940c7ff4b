"""Queries over the driver's tables, one for each operator, with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from depframe.plans import access, code, graphs, lines, programs, rows, shapes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = lines.QUERIES | code.QUERIES | shapes.QUERIES | rows.QUERIES | graphs.QUERIES | access.QUERIES | programs.QUERIES
ORACLES: dict[str, str] = lines.ORACLES | code.ORACLES | shapes.ORACLES | rows.ORACLES | graphs.ORACLES | access.ORACLES
