from pyspark.sql import functions as F

from barloom.streaming.ingest import category_volume, minute_bars, write_bars


def test_stream_equals_batch(spark, tmp_path):
    rows = [("A", "S", f"2024-01-01 00:{m:02d}:{s:02d}", float(40 + m + s / 60), float(39 + m), float(42 + m), s) for m in range(6) for s in (5, 20, 50)]
    rows.append(("A", "S", "2024-01-01 01:00:00", 50.0, 49.0, 51.0, 1))  # moves the watermark on
    df = spark.createDataFrame(rows, "contract_id string, category string, ts string, price double, yes_bid double, yes_ask double, size long").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    write_bars(minute_bars(stream), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("ts").collect()
    want = minute_bars(df).orderBy("ts").collect()[:6]
    assert [(r.ts, r.price_o, r.price_c, r.volume, r.trade_count) for r in got] == [(r.ts, r.price_o, r.price_c, r.volume, r.trade_count) for r in want] and len(got) == 6
    assert got[0].price_o == 40 + 5 / 60 and got[0].volume == 75
    assert category_volume(df, "1 hour", "30 minutes").filter("start = timestamp'2024-01-01 00:00:00'").first().volume == 450
