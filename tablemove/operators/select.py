"""Table selection against a listing (explicit names or ``*``).

Semantics: unknown names are dropped, duplicates keep their first position,
``*`` (or an empty spec element list containing ``*``) selects all tables in
listing order. An empty valid selection is an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class EmptySelection(ValueError):
    pass


def select_tables(listing: DataFrame, spec: str | Sequence[str]) -> DataFrame:
    """Return ``(position, tableName)`` of the selected tables, ordered.

    ``listing`` has a ``tableName`` column (from :func:`list_tables`). A
    listing is catalog metadata produced on the driver by ``SHOW TABLES``,
    and a spec is a user-typed list, so the matching names are gathered
    and numbered on the driver.
    """
    spark = listing.sparkSession
    names = [spec] if isinstance(spec, str) else list(spec)
    names = dedupe_keep_order(n.strip() for n in names if n is not None and n.strip())
    if "*" in names:
        chosen = sorted(r.tableName for r in listing.select("tableName").distinct().collect())
    else:
        wanted = spark.createDataFrame([(n,) for n in names], "tableName string")
        found = {r.tableName for r in wanted.join(listing.select("tableName"), "tableName", "left_semi").collect()}
        chosen = [n for n in names if n in found]
    return spark.createDataFrame(
        list(enumerate(chosen, start=1)), "position int, tableName string"
    )


def selected_names(listing: DataFrame, spec: str | Sequence[str]) -> list[str]:
    """Selected table names in order; raises :class:`EmptySelection` if none."""
    names = [r.tableName for r in select_tables(listing, spec).collect()]
    if not names:
        raise EmptySelection(f"no valid table in selection {spec!r}")
    return names


def dedupe_keep_order(values) -> list[str]:
    """First-seen order de-duplication of a short name list."""
    return list(dict.fromkeys(values))
