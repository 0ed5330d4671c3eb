"""Importing this module registers every query and completes its oracle statement."""

from shiftgrain.plans import q_aggregates, q_cards, q_chance, q_checks, q_feeds, q_joins, q_models, q_rows, q_scalars, q_stream, q_windows  # noqa: F401
from shiftgrain.plans.catalog import QUERIES, STATEMENTS
from shiftgrain.plans.oracle import with_tables

ORACLE = {name: with_tables(sql) for name, sql in STATEMENTS.items()}

__all__ = ["ORACLE", "QUERIES"]
