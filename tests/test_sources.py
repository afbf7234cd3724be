import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from barloom.config import Binning, Cleaning, Rolling, Settings, Surges, build, load_settings
from barloom.sources import bars as source
from barloom.sources.sinks import check_path, latex_table, write_table

HEADER = "datetime,price_c,yes_bid_c,yes_ask_c,volume,price_o,price_h,price_l,yes_bid_o,yes_bid_h,yes_bid_l,yes_ask_o,yes_ask_h,yes_ask_l,trade_count,contract_id"


@pytest.fixture
def folder(tmp_path):
    for cat, name, n in (("Weather", "RAIN-1.5", 4), ("Weather", "SNOW", 2), ("politics", "VOTE", 3)):
        (tmp_path / cat).mkdir(exist_ok=True)
        rows = [f"2024-01-01 00:0{i}:00+00:00,{50 + i},49,51,{i},,,,,,,,,,,{name}" for i in range(n)]
        rows.append("not a time,50,49,51,1,,,,,,,,,,,")
        (tmp_path / cat / f"{name}.csv").write_text("\n".join([HEADER, *rows]) + "\n")
    return str(tmp_path)


def test_read_bars(spark, folder):
    df = source.read_bars(spark, folder, min_observations=3)
    got = {(r.contract_id, r.category, r["count"]) for r in df.groupBy("contract_id", "category").count().collect()}
    assert got == {("RAIN-1.5", "Weather", 4), ("VOTE", "Politics", 3)}
    assert df.schema["ts"].dataType.typeName() == "timestamp"
    only = source.read_bars(spark, folder, ["politics"], 1)
    assert {r.contract_id for r in only.collect()} == {"VOTE"}


def test_first_id_of_a_file_is_that_of_all_its_rows(spark, tmp_path):
    (tmp_path / "Weather").mkdir()
    row = lambda i, name: f"2024-01-01 00:0{i}:00+00:00,50,49,51,1,,,,,,,,,,,{name}"
    (tmp_path / "Weather" / "file-a.csv").write_text("\n".join([HEADER, row(0, ""), row(1, "Z-FIRST"), row(2, "A-LATER"), row(3, "")]) + "\n")
    (tmp_path / "Weather" / "file-b.csv").write_text("\n".join([HEADER, row(0, ""), row(1, "")]) + "\n")
    got = source.read_bars(spark, str(tmp_path), min_observations=1).groupBy("contract_id").count().collect()
    assert {(r.contract_id, r["count"]) for r in got} == {("Z-FIRST", 4), ("file-b", 2)}


def test_point_lookup_and_catalog(spark, folder):
    assert source.read_contract(spark, folder, "SNOW").count() == 2
    with pytest.raises(ValueError):
        source.read_contract(spark, folder, "../../etc/passwd")
    rows = source.catalog(spark, folder).collect()
    assert {r.contract_id for r in rows} == {"RAIN-1.5", "SNOW", "VOTE"} and all(r.size_kb > 0 for r in rows)


def test_metadata(spark, tmp_path):
    assert source.read_metadata(spark, str(tmp_path / "none.csv")).count() == 0
    p = tmp_path / "m.csv"
    p.write_text("contract_id,pm_category,event_ticker,title,category,status,start_date,end_date,volume,open_interest,last_price,resolution_rule\nA,Sports,E,T,x,active,2024-01-01,2024-02-01 00:00:00+00:00,,5,1.5,r\n")
    r = source.read_metadata(spark, str(p)).first()
    assert (r.category, r.volume, r.open_interest, r.end_date.month) == ("Sports", 0, 5, 2)
    every = source.read_metadata(spark, str(p))
    assert source.contract_metadata(every, "A")["open_interest"] == 5 and source.contract_metadata(every, "B") is None


def test_schema_file(spark, tmp_path, bars):
    p = tmp_path / "s.json"
    p.write_text(json.dumps({"timeseries": {"ts": "t", "price_c": "d", "absent": "d"}}))
    assert source.SchemaFile(p).missing("timeseries", bars(price_c=[1.0])) == ["absent"]


def test_times(spark):
    df = spark.createDataFrame([("invalid",), ("2024-01-15 17:00:00+00:00",), (None,)], "t string").select(source.parse_time(F.col("t")).alias("ts"))
    got = [r[0] for r in df.collect()]
    assert got[0] is None and got[2] is None
    assert df.filter("ts is not null").select(F.hour(source.to_eastern(F.col("ts")))).first()[0] == 12


def test_categories_and_ids(spark):
    df = spark.createDataFrame([("NBA",), (" cpi ",), ("Weather",), ("new-york o'neil",), (None,)], "c string")
    assert [r[0] for r in df.select(source.canonical_category(F.col("c"))).collect()] == ["Sports", "Economics", "Weather", "New-York O'Neil", None]
    assert source.check_contract_id("A-1_b") == "A-1_b"
    for bad in ("", "a/b", "a.b", "../x"):
        with pytest.raises(ValueError):
            source.check_contract_id(bad)
    for bad in ("", "a/b", "..", "a\\b"):
        with pytest.raises(ValueError):
            source.check_filename(bad)


@pytest.mark.parametrize(("step", "code"), [(1, "SECOND"), (60, "MINUTE"), (3600, "HOUR"), (86400, "DAY")])
def test_frequency(bars, step, code):
    assert source.detect_frequency(bars(step=step, price_c=[1.0, 2.0, 3.0])).first().frequency == code
    assert source.detect_frequency(bars(price_c=[1.0])).first().frequency == "MINUTE"


def test_event_time(spark, bars):
    both = bars(price_c=[1.0, 2.0]).unionByName(bars(contract="B", category="Politics", price_c=[1.0, 2.0]))
    got = {r.contract_id: r.event_time.minute for r in source.with_event_time(both).select("contract_id", "event_time").distinct().collect()}
    assert got == {"A": 0, "B": 1}
    meta = spark.createDataFrame([("A", None), ("B", "2024-03-01")], "contract_id string, end_date string").withColumn("end_date", F.col("end_date").cast("timestamp"))
    got = {r.contract_id: r.event_time.month for r in source.with_event_time(both, meta).select("contract_id", "event_time").distinct().collect()}
    assert got == {"A": 1, "B": 3}


def test_settings(tmp_path):
    for bad in (lambda: Cleaning(min_observations=-1), lambda: Cleaning(winsorize_limits=(0.6, 0.1)), lambda: Cleaning(min_price=50, max_price=10), lambda: Rolling(20, 10, 60), lambda: Rolling(-5, 10, 60), lambda: Binning(mode="x"), lambda: Surges(lookback_window=0)):
        with pytest.raises(ValueError):
            bad()
    s = build(Settings, {"cleaning": {"min_observations": 7}, "features": {"rolling": {"short": 3}}, "unknown": 1})
    assert (s.cleaning.min_observations, s.features.rolling.short, s.binning.n_bins) == (7, 3, 50)
    p = tmp_path / "c.yaml"
    p.write_text("cleaning:\n  max_price: 98\n")
    assert load_settings(p).cleaning.max_price == 98 and load_settings().cleaning.max_price == 99


def test_sinks(spark, tmp_path, bars):
    base = tmp_path / "out"
    base.mkdir()
    assert check_path("a/b.csv", base) == (base / "a/b.csv").resolve()
    for bad in ("../x", "/etc/passwd"):
        with pytest.raises(ValueError):
            check_path(bad, base)
    with pytest.raises(ValueError):
        check_path("a/../../b")
    write_table(bars(price_c=[1.0, 2.0]), str(base / "t"), "csv")
    write_table(bars(price_c=[1.0, 2.0]), str(base / "t"), "csv")
    assert spark.read.option("header", True).csv(str(base / "t")).count() == 2
    assert r"a & 1.00 \\" in latex_table([{"k": "a", "v": 1.0}], ["k", "v"])


def test_source_files_exist():
    assert Path(source.__file__).exists()
