"""Text normalisers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from varcost import constants as K


def code(col: Column) -> Column:
    """Upper-case key without surrounding spaces."""
    return F.trim(F.upper(col))


def title(col: Column) -> Column:
    """Each space-separated word capitalised, the rest in lower case."""
    return F.trim(F.initcap(col))


def digits(col: Column) -> Column:
    """Only the digits of a formatted number; NULL stays NULL."""
    return F.regexp_replace(col, "[^0-9]", "")


def official_region(col: Column) -> Column:
    """The region if it is an official one, else (also for NULL) the catch-all label."""
    name = code(col)
    return F.when(name.isin(*K.REGIONS), name).otherwise(K.REGION_OTHER)
