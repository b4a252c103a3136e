"""Booleans as people write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
TRUE, FALSE = ("yes", "y", "true", "t", "1"), ("no", "n", "false", "f", "0")


def parsed_boolean(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low.isin(*TRUE), True).when(low.isin(*FALSE), False)
