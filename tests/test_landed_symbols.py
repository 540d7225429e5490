"""A folder for each symbol: a broken file is an event, the others load."""

import pytest
from pyspark.sql import functions as F

from barwise.session import scratch_path
from barwise.sources import adapters as A
from barwise.sources import landed as LD
from barwise.sources import vendor as VD


def _land(spark, raw, path, fmt):
    parts = raw.withColumn("Datetime", F.col("Datetime").cast("string")) if fmt != "parquet" else raw
    writer = parts.write.partitionBy("symbol")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_other_symbols_load(spark, sf_dir, fmt):
    raw, dim = A.vendor_bars(spark, sf_dir), A.symbol_dim(spark, sf_dir)
    path = scratch_path(spark, "symbols")
    symbols = sorted(r[0] for r in raw.select("symbol").distinct().collect())
    broken, half = symbols[0], symbols[1]
    _land(spark, raw.where(F.col("symbol") != broken), path, fmt)
    for symbol in (broken, half):
        # neither a table nor rows of one width
        bad = spark.createDataFrame([('a,"b',), ("1,2,3",), ("{x",)], "value string").coalesce(1)
        bad.write.mode("append").text(f"{path}/symbol={symbol}")
    files = f"part-*.{{{fmt},txt}}" if fmt != "parquet" else "part-*"
    loaded = LD.load_symbols(spark, path, fmt, files=files)
    got = VD.conform_vendor(LD.loaded_rows(loaded), dim)
    want = VD.conform_vendor(raw.where(F.col("symbol") != broken), dim)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    events = {r["ticker"]: r for r in LD.load_errors(loaded, dim).collect()}
    names = dict(tuple(r) for r in dim.select("symbol", "ticker").collect())
    assert set(events) == {names[broken], names[half]}
    assert {r["event_type"] for r in events.values()} == {"API_ERROR"}


def test_missing_columns_are_null_and_an_unknown_symbol_keeps_its_name(spark):
    path = scratch_path(spark, "symbols")
    spark.createDataFrame([("2024-01-02 09:30:00", 3)], "Datetime string, Volume long") \
        .write.parquet(f"{path}/symbol=A%2FB")
    spark.createDataFrame([("x",)], "value string").write.text(f"{path}/symbol=Z")
    loaded = LD.load_symbols(spark, path, files="part-*")
    row = LD.loaded_rows(loaded).first()
    assert (row["symbol"], row["Volume"], row["Open"]) == ("A/B", "3", None)
    dim = spark.createDataFrame([("A/B", "AB")], "symbol string, ticker string")
    assert [r["ticker"] for r in LD.load_errors(loaded, dim).collect()] == ["Z"]
