"""Problem 7: texts that look the same but differ in their characters.

``normalise_forms`` brings every text to one form (see textforms); ``find_forms`` lists the texts that another form
stands for. Both are one narrow pass: no shuffle, no state, so they scale with the scan. Rows that hold printable
ASCII alone are settled in the JVM and never reach Python.

Null texts stay null and are no case; empty and blank texts keep their ordinary blanks; texts of any length are read
whole; repeated rows give repeated results; an empty table gives an empty result; other columns never take part.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parolith.llm.common import quoted, with_id
from parolith.llm.textforms import is_case, one_form

#: Anything but printable ASCII; only such texts can be a case.
_UNUSUAL = r"[^ -~]"


@F.pandas_udf(T.StringType())
def _form(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: one_form(t) if isinstance(t, str) else None)


def normalise_forms(df: DataFrame, columns: Sequence[str], suffix: str = "_form") -> DataFrame:
    """Adds for each text column its one form, as ``<column><suffix>``; replaces a column already so named."""
    made = {f"{c}{suffix}": F.when(quoted(c).rlike(_UNUSUAL), _form(F.when(quoted(c).rlike(_UNUSUAL), quoted(c)))).otherwise(quoted(c)) for c in columns}
    return df.withColumns(made)


def find_forms(df: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
    """(id, field): one row per row and text column whose text isn't in its one form."""
    unusual = F.lit(False)
    for c in columns:
        unusual = unusual | F.coalesce(quoted(c).rlike(_UNUSUAL), F.lit(False))
    names = list(columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, fields = [], []
            for name, texts in zip(names, (b.iloc[:, k + 1] for k in range(len(names)))):
                hit = [isinstance(t, str) and is_case(t) for t in texts]
                got = b.iloc[:, 0][hit]
                ids += list(got)
                fields += [name] * len(got)
            yield pd.DataFrame({id_col: pd.Series(ids, dtype="int64"), "field": pd.Series(fields, dtype="object")})

    picked = with_id(df, id_col).where(unusual).select(quoted(id_col).cast("long").alias("id"), *[quoted(c).alias(f"t{k}") for k, c in enumerate(names)])
    return picked.mapInPandas(run, T.StructType([T.StructField(id_col, T.LongType()), T.StructField("field", T.StringType())]))
