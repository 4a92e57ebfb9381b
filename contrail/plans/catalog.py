"""Imports every query module, which registers its queries."""

from . import q_airport, q_density, q_functions, q_los, q_rules, q_sequence, q_sources, q_stream, q_tables  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
