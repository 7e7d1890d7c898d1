"""Named queries over the tables, each with the SQL that must give the same rows."""

from . import evaluation, judging, ledgers, links, memory, packets, passages, prompts, retrieval, routing  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
