import datetime as dt

from pyspark.sql import functions as F

from barwise import schemas

T0 = dt.datetime(2024, 1, 2, 9, 30)


def bars_df(spark, closes, ticker="T", highs=None, lows=None, step_min=10, start=T0, volume=1):
    rows = []
    for i, c in enumerate(closes):
        h = highs[i] if highs is not None else (None if c is None else c + 1)
        lo = lows[i] if lows is not None else (None if c is None else c - 1)
        rows.append((ticker, start + dt.timedelta(minutes=step_min * i), c, h, lo, c, volume))
    return spark.createDataFrame(rows, schemas.BARS)


def by_ts(df):
    return [r.asDict() for r in df.orderBy("timestamp").collect()]
