"""Columns by their literal names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(name: str) -> Column:
    """The column of exactly this name, which may hold dots, blanks and backticks (condition names are user text)."""
    return F.col("`" + name.replace("`", "``") + "`")
