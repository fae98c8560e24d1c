"""The queries of the library, by group."""

from . import aggregates, chunks, decisions, filters, joins, models, mutations, retrieval, scans, sets, state, templates, text, windows  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
