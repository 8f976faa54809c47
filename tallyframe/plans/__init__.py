"""All queries of the invoice engine."""

from . import checks, intake, ledger, pages, texts  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
