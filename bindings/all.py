"""Importing this module registers every query."""

from bindings import frames  # noqa: F401
from bindings import live, logs, movement, ordered, profiling, small, stored, streams, topology  # noqa: F401
from bindings.registry import QUERIES, SQL  # noqa: F401
