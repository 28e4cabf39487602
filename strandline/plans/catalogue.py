"""The queries of the library and their SQL, by name."""

from __future__ import annotations

from . import pairing, relational

QUERIES: dict = {**relational.QUERIES, **pairing.QUERIES}
ORACLE: dict[str, str] = {**relational.ORACLE, **pairing.ORACLE}
