"""Named queries over the star-schema tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from tesserae.plans import activity, documents, journal, scalars, state, store, text, threeway, timeline, views  # noqa: F401
from tesserae.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
