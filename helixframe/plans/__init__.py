"""Named queries over the driver's tables and the SQL that checks them."""

from . import views  # noqa: F401  (views come first: the checks are built from them)
from . import graph_queries, gwas_queries, hit_queries, interval_queries, pangenome_queries, relational_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
