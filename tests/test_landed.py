"""The data source against the column functions, file by file, with files that cannot be read."""

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from panelscore.sources import landed, payloads

RECORDS = {
    "a": json.dumps([{"page": 1}, [
        {"countryiso3code": "abc", "date": "2001", "value": 1.5}, {"countryiso3code": "", "country": {"id": "de"}, "date": " 2002 ", "value": 2},
        {"countryiso3code": "ABC", "date": "2003", "value": None}, {"countryiso3code": "ABC", "date": "2001Q1", "value": 4.0}, {"date": "2001", "value": 9.0},
    ]]),
    "b": json.dumps([{"page": 1}, []]),
    "c": '[{"message": "none"}]',
    "d": '[{"page": 1}, [{"countryiso3code": "X',
    "e": "",
    "f": json.dumps([{"page": 1}, ["text"]]),
}


def sdmx(series, times, wrapped=False, dims=None):
    document = {
        "dataSets": [{"series": {k: {"observations": o} for k, o in series.items()}}],
        "structure": {"dimensions": {"series": dims or [], "observation": [{"id": "TIME_PERIOD", "values": [{"id": t} for t in times]}]}},
    }
    return json.dumps({"data": document} if wrapped else document)


AREAS = [{"id": "FREQ", "values": [{"id": "A"}]}, {"id": "REF_AREA", "values": [{"id": "N1"}, {"id": "zz"}]}]
OBSERVED = {
    "q": sdmx({"0": {"0": [1.0], "1": [2.5, 9], "2": [None], "3": [4.25]}}, ["2001-Q1", "2001-Q4", "2002-Q1", "2002-Q2"], True),
    "s": sdmx({"0:0": {"0": [1.0], "1": [2.0]}, "0:1": {"1": [3.0], "7": [8.0]}, "0:9": {"0": [5.0]}}, ["2001", "2002"], dims=AREAS),
    "t": '{"structure": {}}',
    "u": "[1, 2]",
}


def land(folder, files):
    for name, text in files.items():
        (folder / f"{name}.json").write_text(text)
    (folder / "_ignored.json").write_text("x")
    (folder / "other.csv").write_text("x")
    return str(folder)


@pytest.mark.parametrize("size", ["1", "300", "1000000"])
def test_records(spark, tmp_path, size):
    path = land(tmp_path, RECORDS)
    found = landed.read(spark, path, "records", partitionBytes=size)
    good = spark.createDataFrame([(t,) for k, t in RECORDS.items() if k in "ab"], "payload string")
    columns = ("entity", "period", "value", "source", "flag")
    assert rows(landed.records_to_long(found), *columns) == rows(payloads.records_to_long(good), *columns) != []
    bad = landed.read(spark, path, "records", True, partitionBytes=size)
    assert [(o[-6:], r.split(":")[0]) for o, r in rows(bad)] == [("c.json", "ValueError"), ("d.json", "JSONDecodeError"), ("e.json", "JSONDecodeError"), ("f.json", "ValueError")]


def test_observations(spark, tmp_path):
    path = land(tmp_path, OBSERVED)
    found = landed.read(spark, path, "observations").withColumn("name", F.regexp_extract("origin", r"(\w)\.json", 1))
    text = spark.createDataFrame(list(OBSERVED.items()), "name string, payload string")
    annual = payloads.quarterly_to_annual(text.where("name = 'q'"))
    assert rows(landed.quarterly_to_annual(found.where("name = 'q'"), ["name"]), "period", "value") == rows(annual, "period", "value") == [(2001, 2.5), (2002, 4.25)]
    aliases = spark.createDataFrame([("n1", "ONE")], "code string, entity string")
    panel = spark.createDataFrame([("ONE",), ("ZZ",)], "entity string")
    wanted = payloads.series_to_long(text.where("name = 's'").drop("name"), panel, aliases)
    got = landed.series_to_long(found.where("name = 's'").drop("name"), panel, aliases)
    assert rows(got, "entity", "period", "value") == rows(wanted, "entity", "period", "value") != []
    assert landed.read(spark, path, "observations", True).count() == 2


def test_single_file_nothing_landed_and_wrong_options(spark, tmp_path):
    path = land(tmp_path, RECORDS)
    assert landed.read(spark, f"{path}/a.json", "records").count() == 2
    assert landed.read(spark, f"file://{path}/a.json", "records").count() == 2
    (tmp_path / "empty").mkdir()
    assert landed.read(spark, str(tmp_path / "empty"), "records").collect() == []
    with pytest.raises(Exception, match="kind"):
        landed.read(spark, path, "pictures").collect()
