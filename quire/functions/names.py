"""Names compared without case, accents or spacing."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def spaced(value: Column) -> Column:
    """Lower case, blanks collapsed."""
    return F.trim(F.regexp_replace(F.lower(value), r"\s+", " "))


@F.pandas_udf(StringType())
def folded(value: pd.Series) -> pd.Series:
    """Case folded (sharp s becomes ss), blanks collapsed, accents dropped; no built-in function decomposes letters."""

    def fold(text):
        if text is None:
            return None
        parts = unicodedata.normalize("NFKD", " ".join(text.casefold().split()))
        return "".join(c for c in parts if not unicodedata.combining(c))

    return value.map(fold)
