import math

import pytest
from pyspark.sql import functions as F

from gridrisk.config import ModelConfig
from gridrisk.functions import calendar, chance, geo, numbers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_cells(spark):
    assert one(spark, geo.cell_id(F.lit(531000.0), F.lit(181000.0), 2000.0)) == "265_90"
    assert one(spark, geo.cell_id(F.lit(-0.5), F.lit(1999.9), 1000.0)) == "-1_1"
    c = one(spark, geo.cell_centroid(F.lit("265_90"), 2000.0))
    assert (c["easting"], c["northing"]) == (531000.0, 181000.0)
    for bad in ("", "265", "a_b", "1_2_3", "1.5_2", None):
        assert one(spark, geo.cell_centroid(F.lit(bad).cast("string"), 2000.0)) is None
    assert len(one(spark, geo.neighbour_offsets(2))) == 24


@pytest.mark.parametrize(("text", "k"), [("2020-01", 24240), ("1999-12", 23999), ("2020-13", None), ("2020-1", None), ("20x0-01", None), ("", None), (None, None)])
def test_months(spark, text, k):
    assert one(spark, calendar.parse_month(F.lit(text).cast("string"))) == k


@pytest.mark.parametrize(("text", "k"), [("31/02/2020", 24241), ("99/12/1999", 23999), ("01/13/2020", None), ("1/02/2020", None), ("01-02-2020", None)])
def test_dates(spark, text, k):
    assert one(spark, calendar.parse_date_month(F.lit(text))) == k


def test_month_round_trip(spark):
    assert one(spark, calendar.month_text(F.lit(24241))) == "2020-02" == calendar.month_text_py(24241)
    assert calendar.parse_month_py("2020-02") == 24241
    with pytest.raises(ValueError):
        calendar.parse_month_py("2020-2")


@pytest.mark.parametrize(("text", "value"), [("12", 12.0), ("-1.5e2", -150.0), (".5", 0.5), (" 12", None), ("12d", None), ("NaN", None), ("", None)])
def test_strict_numbers(spark, text, value):
    assert one(spark, numbers.strict_double(F.lit(text))) == value


def test_scores(spark):
    yes, no = F.lit(True), F.lit(False)
    assert one(spark, numbers.brier(F.lit(1.0), yes)) == 0 and one(spark, numbers.brier(F.lit(1.0), no)) == 1
    assert one(spark, numbers.log_loss(F.lit(0.0), yes)) == pytest.approx(-math.log(1e-12)) and one(spark, numbers.log_loss(F.lit(1.0), yes)) == pytest.approx(0, abs=1e-9)
    dev = [one(spark, numbers.poisson_deviance(F.lit(float(mu)), F.lit(3))) for mu in (3, 2, 1)]
    assert dev[0] == 0 < dev[1] < dev[2]
    assert one(spark, numbers.poisson_deviance(F.lit(2.0), F.lit(0))) == 4
    assert [one(spark, numbers.probability_bin(F.lit(p))) for p in (0.0, 0.05, 0.95, 1.0)] == [0, 0, 9, 9]
    assert one(spark, numbers.round_half_up(F.lit(0.12345), 4)) == 0.1235
    assert one(spark, numbers.skill_percent(F.lit(0.0), F.lit(1.0))) is None


def test_poisson_moments(spark):
    for rate in (0.3, 5.0, 50.0):
        d = spark.range(20000).select(chance.poisson(F.lit(rate), chance.uniform(F.col("id"), F.lit("c")), chance.normal(chance.uniform(F.col("id"), F.lit("u")), chance.uniform(F.col("id"), F.lit("v")))).alias("n"))
        m = d.agg(F.avg("n"), F.var_samp("n")).first()
        assert m[0] == pytest.approx(rate, rel=0.03) and m[1] == pytest.approx(rate, rel=0.06)
    assert one(spark, chance.poisson(F.lit(0.0), F.lit(0.9), F.lit(1.0))) == 0


def test_names():
    assert ModelConfig().name == "poisson-factor" and ModelConfig(n=0).draws == 200 and ModelConfig().weight == 1
    assert ModelConfig(radius=2, shrink=20, ar=True).name == "poisson-factor+sp(r2,a20)+ar1"
