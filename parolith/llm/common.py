"""Helpers the operators share."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parolith.session import cut, table  # noqa: F401  (re-exported for the operators)


def not_blank(c: str | Column) -> Column:
    """True where a text is neither null nor made of white space alone."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & c.rlike(r"[^\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def with_id(df: DataFrame, id_col: str) -> DataFrame:
    """The rows that have an id; the others can't be named in a result and take no part in any operator."""
    return df.where(quoted(id_col).isNotNull())


def bounded_rows(df: DataFrame, most: int, what: str) -> list:
    """All rows of a table that must be small; refuses a larger one instead of cutting it."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what} has more than {most} rows; raise the bound only if the driver and each worker can hold them")
    return rows


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def shuffle_width(spark: SparkSession) -> int:
    return int(re.sub(r"\D", "", spark.conf.get("spark.sql.shuffle.partitions", "200")) or 200)
