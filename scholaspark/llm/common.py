"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholaspark.lineage import cut as written
from scholaspark.operators.communities import components
from scholaspark.tables import table

__all__ = ["BROADCAST_LIMIT", "WORD", "bounded_rows", "components", "table", "written"]

#: Largest serialised size, in bytes, of anything that is sent to every task.
BROADCAST_LIMIT = 32 * 1024 * 1024


def bounded_rows(df: DataFrame, what: str, limit: int = BROADCAST_LIMIT) -> list:
    """The rows of a table that is small by its definition (words of a language,
    short forms of names); fails beyond ``limit`` bytes of text instead of
    flooding the driver."""
    size = df.agg(F.sum(sum((F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c in df.columns), F.lit(16)))).first()[0] or 0
    if size > limit:
        raise ValueError(f"{what} has more than {limit} bytes")
    return df.collect()


WORD = re.compile(r"[^\W_]+")
