"""Keeping costly columns from being computed more than once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(c: Column) -> Column:
    """The same column as the output of a generator (one per select).

    Spark moves a filter on a computed column in front of the projection by repeating the
    computation in it: parsing or cleaning a text would be done twice. It does not move
    filters through a generator.
    """
    return F.explode(F.array(c))
