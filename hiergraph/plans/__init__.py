"""Registered queries and their SQL counterparts."""

from . import graphs, records, spatial, streams, tree

QUERIES: dict = tree.Q | graphs.Q | records.Q | spatial.Q | streams.Q
ORACLES: dict[str, str] = tree.S | graphs.S | records.S | spatial.S | streams.S
