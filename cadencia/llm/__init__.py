"""Operators of a training-data pipeline; nothing else in the library imports them."""

from . import queries  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
