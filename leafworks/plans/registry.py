"""All queries outside the language-model folder."""

from __future__ import annotations

from . import charts, evaluation, gates, pages, retrieval, samples, scalars, streams, traces, viz  # noqa: F401  they register their queries
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
