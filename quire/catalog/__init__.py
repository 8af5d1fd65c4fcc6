"""The registered queries: each operator on the given tables, with its SQL twin."""

from quire.catalog.registry import ORACLES, QUERIES, load_all

__all__ = ["ORACLES", "QUERIES", "load_all"]
