"""Numbers as plain text: shortest digits that read back, never an exponent, no trailing point."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_number(x: float) -> str:
    if np.isinf(x):
        return "inf" if x > 0 else "-inf"
    return np.format_float_positional(x, unique=True, trim="-")


def plain(c: Column) -> Column:
    """For the text of a summary only; typed results stay doubles."""

    @F.pandas_udf("string")
    def formatted(s: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) else plain_number(x) for x in s], dtype=object)

    return formatted(c)
