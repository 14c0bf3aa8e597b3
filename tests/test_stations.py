import datetime as dt

import pytest
from pyspark.sql import functions as F

from rainloom.functions import scalar as S
from rainloom.sources import stations as ST

CATALOG = "StationNumber,Station,StationId,Latitude,Longitude\n1,Chittagonj,10,22.35,91.82\n2,Syedpur,20,25.78,88.90\n"


def matrix(path, rows):
    days = ",".join(str(d) for d in range(1, 32))
    path.write_text("title\n" * 7 + f"Stati,Year,Month,{days}\n" + "".join(rows))


def month_row(name, cells):
    return f"{name},2018,2," + ",".join(cells + [""] * (31 - len(cells))) + "\n"


@pytest.fixture
def files(tmp_path):
    (tmp_path / "Stations.csv").write_text(CATALOG)
    return tmp_path


def test_month_matrix(spark, files):
    a = ["0"] * 28
    a[3], a[5] = "***", "12.5"
    matrix(files / "rain.csv", [month_row("Chittagong", a), month_row("Sydpur", ["1"] * 28)])
    d = ST.read_legacy(spark, str(files / "rain.csv"), str(files / "Stations.csv")).cache()
    assert d.count() == 56
    assert d.where("precip_mm is not null").count() == 55
    assert {r[0] for r in d.select("station_id").distinct().collect()} == {1, 2}
    got = d.where((F.col("station_id") == 1) & (F.col("date") == F.lit("2018-02-06"))).first()
    assert got.precip_mm == 12.5 and got.lat == 22.35


def test_sentinels_and_bounds(spark, files):
    cells = ["-999", "9999", "-3", "1500", "7"] + ["0"] * 23
    matrix(files / "rain.csv", [month_row("Syedpur", cells)])
    d = ST.read_legacy(spark, str(files / "rain.csv"), str(files / "Stations.csv"), start="2018-02-01", end="2018-02-05")
    v = {r.date.day: r.precip_mm for r in d.collect()}
    assert v == {1: None, 2: None, 3: None, 4: None, 5: 7.0}


def test_unknown_token_stops(spark, files):
    matrix(files / "rain.csv", [month_row("Syedpur", ["wet"] + ["0"] * 27)])
    with pytest.raises(Exception, match="unrecognized precipitation token"):
        ST.read_legacy(spark, str(files / "rain.csv"), str(files / "Stations.csv")).collect()


def test_unmatched_and_duplicate_stop(spark, files):
    matrix(files / "rain.csv", [month_row("Nowhere", ["0"] * 28)])
    with pytest.raises(Exception, match="no match"):
        ST.read_legacy(spark, str(files / "rain.csv"), str(files / "Stations.csv")).collect()
    matrix(files / "rain.csv", [month_row("Syedpur", ["0"] * 28)] * 2)
    with pytest.raises(Exception, match="duplicate station_id,date"):
        ST.read_legacy(spark, str(files / "rain.csv"), str(files / "Stations.csv")).collect()


def test_checks_reach_rows_outside_the_period(spark, files):
    """Unknown tokens and names stop the job wherever they are; a period that begins and ends inside a month keeps its days."""
    rain, stations = files / "rain.csv", str(files / "Stations.csv")
    far = "{},2011,7," + ",".join(["{}"] + ["0"] * 30) + "\n"
    for name, cell, message in [("Syedpur", "wet", "unrecognized precipitation token wet"), ("Nowhere", "0", "no match")]:
        matrix(rain, [month_row("Syedpur", ["1"] * 28), far.format(name, cell)])
        with pytest.raises(Exception, match=message):
            ST.read_legacy(spark, str(rain), stations, start="2018-02-03", end="2018-02-05").select("date").collect()
    matrix(rain, [month_row("Syedpur", ["1"] * 28 + ["wet", "wet"]), "Syedpur,2018,13," + ",".join(["wet"] * 31) + "\n"] + [far.format("Syedpur", "2")] * 2)
    d = ST.read_legacy(spark, str(rain), stations, start="2018-02-27", end="2018-03-05")
    assert [(r.date.isoformat(), r.precip_mm) for r in d.orderBy("date").collect()] == [("2018-02-27", 1.0), ("2018-02-28", 1.0)]


def test_missing_header_stops(spark, files):
    (files / "rain.csv").write_text("a,b\n1,2\n")
    with pytest.raises(Exception, match="no header row"):
        ST.read_legacy(spark, str(files / "rain.csv"), str(files / "Stations.csv")).collect()


def test_catalog_duplicates_stop(spark, files):
    (files / "Stations.csv").write_text(CATALOG + "3,chittagonj!,30,20,90\n")
    with pytest.raises(Exception, match="duplicate station_key"):
        ST.read_catalog(spark, str(files / "Stations.csv")).collect()


def test_station_folder(spark, files):
    (files / "Chittagong.csv").write_text("Datetime,Rainfall\n2020-01-01,1.5\n2020-01-02,***\n2020-01-03,2\n")
    (files / "dimla.csv").write_text("date,precip_mm\n2020-01-01,0\n2020-01-02,junk\n2020-01-03,4\n")
    (files / "other.csv").write_text("when,what\n2020-01-01,9\n")
    d = ST.read_station_dir(spark, str(files), str(files / "Stations.csv")).cache()
    assert d.count() == 6 and d.where("precip_mm is not null").count() == 4
    assert {(r.station_id, r.name) for r in d.select("station_id", "name").distinct().collect()} == {(1, "Chittagonj"), (36, "Dimla")}


def test_trace_and_station_sentinels(spark):
    d = spark.createDataFrame([("T",), ("9999",), ("-99.9",), ("3",)], "c string")
    assert [r[0] for r in d.select(S.clean_station("c")).collect()] == [0.05, 9999.0, None, 3.0]
