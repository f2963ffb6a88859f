"""Every operator as a query over the shared tables, with an equivalent SQL text where there is one."""

from .base import ORACLES, QUERIES
from . import dedup, feeds, filters, ledger, mail, pages, runs, scalars, scoring  # noqa: F401  (they register)

__all__ = ["ORACLES", "QUERIES"]
