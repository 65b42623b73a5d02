"""The registered queries, each next to the SQL that states what it must return."""

from tablegraph.workload import catalog, files, graph, intake, streams
from tablegraph.workload.data import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "catalog", "files", "graph", "intake", "streams"]
