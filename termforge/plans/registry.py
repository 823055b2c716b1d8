"""All queries of the library by name, with their SQL equivalents."""

from __future__ import annotations

from . import more  # noqa: F401  registers its queries
from .more_sql import ORACLES as MORE
from .oracles import ORACLES
from .queries import QUERIES

FLAGSHIP = "mine_dirichlet_logodds"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return ORACLES | MORE
