"""Output normalisation shared by registered queries (doubles to 6 decimals)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def round_doubles(df: DataFrame, places: int = 6) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            # round(x * 10^p) / 10^p: the product is one IEEE double in every engine
            # and its integer rounding has no decimal-string ambiguity, so Spark and
            # the SQL oracle agree bit for bit (rounding a 7-digit tie directly does not).
            scale = float(10 ** places)
            # "+ 0.0" turns -0.0 into 0.0 so the sign of zero never decides equality.
            cols.append((F.round(F.col(f.name) * scale) / scale + 0.0).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


