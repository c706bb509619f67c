from . import catalog, cluster, events, io, quality, repair, signal, stats, streams, waves  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
