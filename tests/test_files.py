"""Documents line by line, rejected rows, counters in the job that reads, and counts of a stream by runs."""

import json

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from gridrisk import streaming
from gridrisk.operators import panel as panels
from gridrisk.sources import documents, incidents, panels as panel_files

HEAD = "target_month string, train_through string, tier string, "


def test_documents_are_written_line_by_line(spark, tmp_path):
    cells = [("2030-01", "2029-12", t, c, 0.5, 1.25, 3) for t in documents.TIERS for c in ("9_1", "10_2", 'odd"\\é_1', "10_10") if t == "ksi" or c != "9_1"] + [("2030-02", "2029-12", "ksi", "1_1", 1.0, 0.0, 0), ("2030-03", "2029-12", "ksi", "1_1", 1.0, 0.0, 0)]
    totals = [(m, "2029-12", t, "m", 2.5, 1.0, 2.0, 4.0) for m in ("2030-01", "2030-02") for t in documents.TIERS if (m, t) != ("2030-02", "ksi")]
    c = spark.createDataFrame(cells, HEAD + "cell string, rating double, expected double, p95 long").repartition(4)
    t = spark.createDataFrame(totals, HEAD + "model string, expected_total double, total_p5 double, total_p50 double, total_p95 double").repartition(3)
    documents.write_forecasts(c, t, str(tmp_path / "f"), {"made_at": F.lit("now")})
    texts = {p.parent.name: p.read_text() for p in (tmp_path / "f").glob("*/part-*")}
    assert set(texts) == {"target_month=2030-01", "target_month=2030-02"}  # a document is one file; a month without totals has none
    first, second = (json.loads(texts[k]) for k in sorted(texts))
    assert list(first) == ["target_month", "made_at", "train_through", "accidents", "ksi"] and first["made_at"] == "now"
    for tier in documents.TIERS:
        names = [x["cell"] for x in first[tier]["cells"]]
        assert names == sorted(x[3] for x in cells if x[0] == "2030-01" and x[2] == tier) and first[tier]["total_p50"] == 2.0
    assert second["ksi"] is None and second["accidents"]["cells"] == []
    back = documents.forecast_cells(documents.read_forecasts(spark, str(tmp_path / "f")))
    assert sorted(map(tuple, back.collect())) == sorted(x for x in cells if x[0] == "2030-01")


def test_rejected_panel_rows(spark, tmp_path):
    lines = ["2020-01,1_1,3,1", "2020-13,1_1,3,1", "2020-1,1_1,3,1", ",1_1,3,1", "2020-02,1_1,3x,1", "2020-02,1_1,3,", "2020-02,1_1, 3,y", "2020-03,2_2,NaN,1", "2020-04,2_2,1e1,0.5", "2020-05,2_2"]
    (tmp_path / "p.csv").write_text("month,cell,accidents,ksi\n" + "\n".join(lines) + "\n")
    path = str(tmp_path / "p.csv")
    assert sorted(map(tuple, panel_files.read(spark, path).collect())) == [("1_1", 2020 * 12, 3.0, 1.0), ("2_2", 2020 * 12 + 3, 10.0, 0.5)]
    bad = panel_files.rejected(spark, path)
    assert {r["reason"]: r["n"] for r in bad.groupBy("reason").agg(F.count("*").alias("n")).collect()} == {"month": 3, "accidents": 4, "ksi": 1}
    assert {(r["raw"]["month"], r["raw"]["ksi"]) for r in bad.where("reason = 'ksi'").collect()} == {("2020-02", None)}
    assert panel_files.parsed(spark, path).count() == len(lines)


def test_groups(spark, tmp_path):
    (tmp_path / "p.csv").write_text("month,cell,borough\n2020-02,a,X\n2020-01,a,Y\n2020-03,a,\n2020-01,b,Z\n2020-01,c,\n")
    assert {tuple(r) for r in panel_files.groups(spark, str(tmp_path / "p.csv"), "borough").collect()} == {("a", "X"), ("b", "Z")}


def records(spark, rows):
    return spark.createDataFrame([(e, 155_500.0, s, s in "12", t, k, "d") for e, s, t, k in rows], "easting double, northing double, severity string, ksi boolean, tenths long, k int, district string")


def test_counters_come_from_the_job_that_reads(spark):
    d = records(spark, [(500_500.0, "1", 10, 1), (None, "1", 10, 1), (1.0, "3", 1, 1), (500_500.0, "3", 1, None), (float("nan"), "3", 1, None)]).repartition(2)
    seen = Observation("counts")
    assert incidents.observed(d, seen).count() == 1
    assert seen.get == incidents.counters(d).first().asDict() == {"n_read": 5, "n_bad_coordinates": 1, "n_outside": 2, "n_bad_date": 1, "n_accepted": 1}
    assert sorted(r["reason"] for r in incidents.rejected(d).collect()) == ["coordinates", "date", "outside", "outside"]


@pytest.mark.parametrize("n, want", [(1, [(0, 0)]), (3, [(0, 0), (0, 1), (0, 2)]), (4, [(1, 0)]), (21, [(2, 0), (1, 16), (0, 20)]), (64, [(3, 0)])])
def test_runs(n, want):
    assert streaming.runs(n) == want


def test_batches_add_up_and_can_be_repeated(spark, tmp_path):
    path, unit, everything = str(tmp_path), panels.by_cell(), []
    for number in range(6):
        rows = [(500_500.0 + 1000 * ((number * k) % 5), "13"[k % 2], 1, k % 3) for k in range(number * 2)]  # the first batch is empty
        everything += rows
        for _ in range(2 if number in (0, 3, 5) else 1):
            streaming.write_batch(records(spark, rows), number, unit, path)
        want = panels.counts(records(spark, everything), unit)
        assert sorted(map(tuple, streaming.latest(spark, path).collect())) == sorted(map(tuple, want.collect()))
    streaming.write_batch(records(spark, []), 6, unit, path)
    assert spark.read.parquet(f"{path}/level=0/first=6").count() == 0  # what is written grows with the batch
