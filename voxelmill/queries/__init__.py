"""Registered queries and their SQL: each module has ``QUERIES`` and ``ORACLES``."""
