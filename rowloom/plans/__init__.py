"""Registered queries over the test tables, with SQL of the same outcome."""

from rowloom.plans.catalog import ORACLE_SQL, QUERIES, flagship

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
