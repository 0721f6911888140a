import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridrisk.config import TIERS, MissingColumns, ModelConfig, NotForward, NotPublished
from gridrisk.functions import calendar
from gridrisk.operators import model, panel as panels, scoring
from gridrisk.plans import backtest, forecast, queries, resolve, sweep
from gridrisk.sources import documents, incidents, panels as panel_files

START = 2018 * 12


def panel(spark, cells, n=60):
    """cells: name to a function of the month's place and its month of the year."""
    rows = [(c, START + t, int(f(t, t % 12 + 1))) for c, f in cells.items() for t in range(n)]
    return spark.createDataFrame(rows, "entity string, k int, y long")


def next_month(p, config, dense=True):
    end = p.agg(F.max("k")).first()[0]
    fitted = model.Fitted(p, lambda axis: model.forward_targets(axis, end + 1, end + 1, end, config.hist_k), config, dense, end)
    return {r["entity"]: r for r in model.predict(fitted, config).collect()}, fitted


def test_rating_falls_and_base_is_recovered(spark):
    got, _ = next_month(panel(spark, {"0_0": lambda t, m: t % 10 == 0, "5_5": lambda t, m: 5, "9_9": lambda t, m: 2}), ModelConfig(n=500))
    assert got["0_0"]["rating"] > 0.8 and got["5_5"]["rating"] < 0.1
    assert got["9_9"]["expected"] == pytest.approx(2, abs=0.3)
    for r in got.values():
        assert r["rating"] >= math.exp(-r["expected"]) - 0.02


def test_season(spark):
    p = panel(spark, {"0_0": lambda t, m: 10 if m == 12 else 1}, 59)  # the next month is a December
    got, fitted = next_month(p, ModelConfig(n=200))
    s = {r["moy"]: r["s"] for r in fitted["seasons"].collect()}
    assert s[12] > 4 > 1 > s[6] and got["0_0"]["expected"] > 5


def test_spatial_prior(spark):
    cells = {f"{i}_{j}": (lambda t, m: 0) if (i, j) == (1, 1) else (lambda t, m: 5) for i in range(3) for j in range(3)} | {f"{50 + i}_0": lambda t, m: 0 for i in range(20)}
    p = panel(spark, cells, 36)
    near, _ = next_month(p, ModelConfig(n=100, radius=1, shrink=20))
    far, _ = next_month(p, ModelConfig(n=100, shrink=20))
    assert near["1_1"]["expected"] > far["1_1"]["expected"]


def test_ar_momentum(spark):
    p = panel(spark, {f"{i}_0": lambda t, m: 2 + 6 * (t >= 57) + (t % 2) for i in range(8)})
    total = lambda c: sum(r["expected"] for r in next_month(p, c)[0].values())
    assert total(ModelConfig(n=400, ar=True)) > total(ModelConfig(n=400))


def test_shared_factor_correlates_cells(spark):
    p = panel(spark, {f"{i}_0": lambda t, m: 2 + 6 * (t // 12 % 2) for i in range(2)})
    _, fitted = next_month(p, ModelConfig(n=400))
    a, b = (r["counts"] for r in model.ensembles(fitted, ModelConfig(n=400)).collect())
    ma, mb = sum(a) / 400, sum(b) / 400
    r = sum((x - ma) * (y - mb) for x, y in zip(a, b)) / math.sqrt(sum((x - ma) ** 2 for x in a) * sum((y - mb) ** 2 for y in b))
    assert r > 0.2


def test_analytic_p95_follows_the_rate(spark):
    config, bases = ModelConfig(n=3), {"none": 0.0, "few": 0.7, "some": 45.0, "many": 400.0, "most": 3000.0}
    fitted = {
        "seasons": spark.createDataFrame([(START, m, 1.0) for m in range(1, 13)], "target int, moy int, s double"),
        "based": spark.createDataFrame([(START, e, b) for e, b in bases.items()], "target int, entity string, base double"),
        "drawn": spark.createDataFrame([(START, m, f) for m, f in enumerate((-0.2, 0.0, 0.3), 1)], "target int, member int, f double"),
    }

    def plain(b):
        cdf = 0.0
        for c in range(100_000):
            cdf += sum(math.exp(c * math.log(r) - r - math.lgamma(c + 1)) if r else float(c == 0) for r in (b * math.exp(f) for f in (-0.2, 0.0, 0.3))) / 3
            if cdf >= 0.95:
                return c

    assert {r["entity"]: r["p95"] for r in model.p95_analytic(fitted, config).collect()} == {e: plain(b) for e, b in bases.items()}


def test_all_zero_panel(spark):
    got, fitted = next_month(panel(spark, {"0_0": lambda t, m: 0}, 30), ModelConfig(n=50, ar=True))
    assert got["0_0"]["rating"] == 1 and got["0_0"]["expected"] == 0
    par = fitted["parameters"].first()
    assert (par["n"], par["sigma"]) == (0, 0)


def test_general_path_equals_dense_path(spark):
    p = panel(spark, {f"{i}_{i % 2}": (lambda i: lambda t, m: (t * (i + 3) + m) % 4)(i) for i in range(4)}, 40)
    for config in (ModelConfig(n=20, ar=True), ModelConfig(n=20, hist_k=18, radius=1, shrink=5)):
        a, b = (model.predict(backtest.fit(p, config, 24, dense), config).orderBy("target", "entity").collect() for dense in (True, False))
        assert len(a) == len(b) == 16 * 4
        for x, y in zip(a, b):
            assert x["rating"] == pytest.approx(y["rating"], abs=1e-9) and x["expected"] == pytest.approx(y["expected"], abs=1e-9)


def plain_fit(rows, target, hist_k, radius, a):
    """cnt, e, base by entity and expected by month, as the model is defined, of rows (entity, k, y)."""
    present = sorted({k for _, k, _ in rows if k < target})
    kept = set(present[-hist_k:] if hist_k else present)
    w = [r for r in rows if r[1] in kept]
    overall = sum(y for *_, y in w) / len(w) if w else 0.0
    s = {}
    for m in range(1, 13):
        of = [y for _, k, y in w if k % 12 + 1 == m]
        s[m] = sum(of) / len(of) / overall if of and overall else 1.0
    cnt, e = Counter(), Counter()
    for i, k, y in w:
        cnt[i] += y
        e[i] += s[k % 12 + 1]
    base = {}
    for i in {r[0] for r in rows}:
        x, z = map(int, i.split("_"))
        near = [j for j in {r[0] for r in rows} if j != i and max(abs(int(j.split("_")[0]) - x), abs(int(j.split("_")[1]) - z)) <= radius]
        prior = sum(cnt[j] for j in near) / sum(e[j] for j in near) if radius and sum(e[j] for j in near) > 0 else overall
        base[i] = (cnt[i] + a * prior) / (e[i] + a)
    expected = Counter()
    for i, k, _ in w:
        expected[k] += base[i] * s[k % 12 + 1]
    return cnt, e, base, expected


@pytest.mark.parametrize("hist_k, radius", [(0, 0), (7, 1), (0, 2)])
def test_irregular_panels(spark, hist_k, radius):
    rnd = np.random.default_rng(hist_k + radius)
    rows = [(f"{i}_{j}", START + k, int(rnd.poisson(1 + (k % 12 == 3)))) for i in range(-1, 4) for j in range(3) for k in range(30) if rnd.random() < 0.25 + 0.1 * j and k not in (5, 11)]
    rows += rows[:10] + [("9_9", START + 28, 3)]  # repeated rows, and one that only has a row late
    config = ModelConfig(n=5, hist_k=hist_k, radius=radius, shrink=2.0)
    fitted = backtest.fit(spark.createDataFrame(rows, "entity string, k int, y long").repartition(3), config, 12)
    assert not fitted.dense
    targets = [r["target"] for r in fitted["targets"].collect()]
    based, series = defaultdict(dict), defaultdict(dict)
    for r in fitted["based"].collect():
        based[r["target"]][r["entity"]] = r
    for r in fitted["series"].collect():
        series[r["target"]][r["k"]] = r
    assert len(targets) == len({k for _, k, _ in rows}) - 12
    for t in targets:
        cnt, e, base, expected = plain_fit(rows, t, hist_k, radius, 2.0)
        assert set(based[t]) == set(base) and set(series[t]) == set(expected)
        for i, b in base.items():
            assert (based[t][i]["cnt"], based[t][i]["e"], based[t][i]["base"]) == (cnt[i], pytest.approx(e[i], abs=1e-9), pytest.approx(b, abs=1e-9)), (t, i)
        for k, x in expected.items():
            assert series[t][k]["expected"] == pytest.approx(x, abs=1e-9)
    own = {(r["target"], r["entity"]): r["climatology"] for r in backtest.baselines(fitted["panel"], fitted["targets"], fitted["axis"]).collect()}
    for (t, i), rate in own.items():
        before = [y for j, k, y in rows if j == i and k < t] or [y for _, k, y in rows if k < t]
        assert rate == pytest.approx(sum(before) / len(before))
    forward = model.Fitted(fitted["panel"], lambda axis: model.forward_targets(axis, START + 22, START + 24, START + 20, hist_k), config, None, START + 20)
    cnt, e, base, _ = plain_fit([r for r in rows if r[1] <= START + 20] + [(r[0], START + 21, 0) for r in rows], START + 21, hist_k, radius, 2.0)
    for r in forward["based"].collect():
        assert (r["cnt"], r["base"]) == (cnt[r["entity"]], pytest.approx(base[r["entity"]], abs=1e-9))


def test_neighbours_in_a_full_square_and_without_any(spark):
    exposed = spark.createDataFrame([(1, f"{i}_{j}", 1, 1.0) for i in range(6) for j in range(6)] + [(1, "x", 4, 1.0), (1, "40_40", 9, 1.0)], "target int, entity string, cnt long, e double")
    seasons = spark.createDataFrame([(1, m, 1.0, 0.5) for m in range(1, 13)], "target int, moy int, s double, overall double")
    p = model.prior(exposed, seasons, 2)
    assert {r["entity"]: r["prior"] for r in p.collect()} == {f"{i}_{j}": 1.0 for i in range(6) for j in range(6)} | {"x": 0.5, "40_40": 0.5}


def test_crps_and_coverage(spark):
    totals = spark.createDataFrame([(1, m, x) for m, x in enumerate([3, 1, 4, 1, 5, 9, 2, 6], 1)], "target int, member int, total long")
    y = spark.createDataFrame([(1, 4)], "target int, y long")
    xs = [3, 1, 4, 1, 5, 9, 2, 6]
    pairwise = sum(abs(a - 4) for a in xs) / 8 - sum(abs(a - b) for a in xs for b in xs) / 128
    assert scoring.crps(totals, y).first()["crps"] == pytest.approx(pairwise)
    assert scoring.coverage(totals, y).first()["covered"]


def test_calibration(spark):
    rows = [("m", p, p, y) for p, share in ((0.3, 0.3), (0.9, 0.5)) for i in range(100) for y in [int(i < 100 * share)]]
    df = spark.createDataFrame(rows, "forecaster string, p double, mu double, y int")
    error = lambda p: scoring.calibration_error(scoring.reliability(df.where(F.col("p") == p), ["forecaster"]), ["forecaster"]).first()[1]
    assert error(0.3) <= 0.02 and error(0.9) >= 0.3


def test_backtest_report(spark):
    p = panel(spark, {f"{i}_0": (lambda i: lambda t, m: (t + i) % 3)(i) for i in range(3)}, 30)
    r = backtest.report(p, ModelConfig(n=30))
    s = {x["forecaster"]: x for x in r["scores"].collect()}
    assert set(s) == {"poisson-factor", "naive", "climatology"} and s["naive"]["n"] == 18 and s["naive"]["total_crps"] is None
    assert r["totals"].count() == 6


def test_panel_from_csv(spark, tmp_path):
    (tmp_path / "in.csv").write_text(
        "location_easting_osgr,location_northing_osgr,collision_severity,date,other\n"
        "500500,155500,1,01/01/2020,x\n500500,155500,3,31/02/2020,x\n565000,205000,2,05/03/2020,x\n"
        "499999,155500,1,01/01/2020,x\nNULL,155500,1,01/01/2020,x\n500500,155500,1,2020-01-01,x\n500500\n"
    )
    raw = incidents.read_csv(spark, str(tmp_path / "in.csv"))
    typed = incidents.typed(raw)
    assert incidents.counters(typed).first().asDict() == {"n_read": 7, "n_bad_coordinates": 2, "n_outside": 1, "n_bad_date": 1, "n_accepted": 3}
    p = panels.build(incidents.accepted(typed), panels.by_cell())
    assert panels.is_dense(p) and p.count() == 2 * 3
    assert panels.build(incidents.accepted(typed), panels.by_cell(), "tier").count() == 2 * 2
    panel_files.write(p, str(tmp_path / "p.csv"), csv=True)
    back = panel_files.read(spark, str(tmp_path / "p.csv"))
    assert sorted(map(tuple, back.select("entity", "k", "accidents").collect())) == sorted((r["entity"], r["k"], float(r["accidents"])) for r in p.collect())
    with pytest.raises(MissingColumns):
        incidents.typed(raw.drop("date"))
    assert panels.build(incidents.accepted(typed), panels.by_district()).count() == 0


def test_forecast_and_settlement(spark, tmp_path):
    p = panel(spark, {f"{i}_0": (lambda i: lambda t, m: (t + i) % 3)(i) for i in range(3)}, 30).withColumnRenamed("y", "accidents").withColumn("ksi", F.col("accidents") - (F.col("accidents") > 1).cast("long"))
    through = calendar.month_text_py(START + 26)
    forecast.publish(p, str(tmp_path / "f"), through, last=calendar.month_text_py(START + 28), n=40, side_km=2, made_at="now", source="/a/panel.csv")
    back = documents.read_forecasts(spark, str(tmp_path / "f"))
    assert sorted(r["target_month"] for r in back.collect()) == [calendar.month_text_py(START + 27), calendar.month_text_py(START + 28)]
    first = back.orderBy("target_month").first()
    assert (first["made_at"], first["cell_km"], first["n"], first["seed"], first["train_through"], first["model"]) == ("now", 2.0, 40, 1, through, "poisson-factor")
    assert first["settle_note"].endswith(first["target_month"]) and first["ksi"]["model"] == TIERS["ksi"].name
    assert first["train_source"] == "panel.csv" and [c["cell"] for c in first["accidents"]["cells"]] == ["0_0", "1_0", "2_0"]
    resolve.check(back, p)
    r = resolve.resolutions(documents.forecast_cells(back), documents.forecast_totals(back), p).where("tier = 'accidents'").orderBy("target_month").first()
    assert r["n"] == 3 and r["realised_total"] == 3 and r["unforecast_total"] == 0 and sum(x[2] for x in r["reliability"]) == 3
    with pytest.raises(NotPublished):
        resolve.check(back, p.where(F.col("k") < START + 28))
    with pytest.raises(NotForward):
        resolve.check(back.withColumn("train_through", F.lit("x")), p)
    with pytest.raises(NotForward):
        forecast.publish(p, str(tmp_path / "g"), through, through)
    with pytest.raises(ValueError):
        forecast.publish(p, str(tmp_path / "g"), through, "2030-05", "2030-04")
    assert forecast.as_at(p, START - 1).select("entity").distinct().count() == 3


def test_draws_do_not_depend_on_partitions(spark):
    p = panel(spark, {f"{i}_0": lambda t, m: t % 3 for i in range(3)}, 30)
    seen = set()
    for n in (1, 4, 8):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        _, fitted = next_month(p.repartition(n), ModelConfig(n=20))
        seen.add(tuple(tuple(r["counts"]) for r in model.ensembles(fitted, ModelConfig(n=20)).orderBy("entity").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(seen) == 1


def plain_deviances(rows, draws=400):
    """Units, and the mean deviance of the model and of the pooled rate, from (entity, month) of each incident."""
    entities, axis = sorted({e for e, _ in rows}), sorted({k for _, k in rows})
    seen = Counter(rows)
    y = np.array([[seen[e, k] for k in axis] for e in entities], float)
    moy, model_sum, naive_sum = np.array([k % 12 for k in axis]), 0.0, 0.0

    def deviance(y, mu):
        mu = np.maximum(mu, 1e-12)
        return 2 * (np.where(y > 0, y * np.log(np.maximum(y, 1) / mu), 0) - (y - mu)).sum()

    def uniform(target, member, stream):
        return (int(hashlib.md5(f"1|{target}|{member}|{stream}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52

    for t in range(24, len(axis)):
        h, m, overall = y[:, :t], moy[:t], y[:, :t].mean()
        s = np.array([h[:, m == x].mean() / overall if (m == x).any() else 1.0 for x in range(12)])
        base = (h.sum(1) + overall) / (s[m].sum() + 1)
        f = np.log((h.sum(0) + 0.5) / (base.sum() * s[m] + 0.5))
        z = [math.sqrt(-2 * math.log(uniform(axis[t], d, "u"))) * math.cos(2 * math.pi * uniform(axis[t], d, "v")) for d in range(1, draws + 1)]
        model_sum += deviance(y[:, t], base * s[moy[t]] * np.exp(f.std() * np.array(z)).mean())
        naive_sum += deviance(y[:, t], np.full(len(entities), overall))
    n = len(entities) * (len(axis) - 24)
    return len(entities), model_sum / n, naive_sum / n


def test_sweep_counts_all_units_in_one_scan(spark):
    typed = spark.createDataFrame([(500_100.0 + 700 * k, 155_100.0 + 300 * k, "1" if k % 3 else "3", bool(k % 3), 1, START + k % 4, "" if k == 5 else f"d{k % 2}") for k in range(40)], "easting double, northing double, severity string, ksi boolean, tenths long, k int, district string")
    got = sweep.studies(typed, sweep.UNITS)
    assert {tuple(r["study"]) for r in got.collect()} == {(t, u) for t in ("accidents", "ksi") for u in sweep.UNITS}
    for (unit, side), tier in ((u, t) for u in sweep.UNITS.items() for t in ("accidents", "ksi")):
        want = panels.build(typed, panels.by_cell(side) if side else panels.by_district(), "tier" if tier == "ksi" else "all").select("entity", "k", F.col(tier).alias("y"))
        mine = got.where((F.col("study.tier") == tier) & (F.col("study.unit") == unit)).select("entity", "k", "y")
        assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, want.collect())), (unit, tier)


def test_resolution_sweep_covers_all_units(spark):
    d = "/root/testdata/sf0.001"
    got = {(r["tier"], r["unit"]): r for r in queries.QUERIES["resolution_sweep"](spark, d).collect()}
    rows = queries.accepted(spark, d).collect()
    for unit, side in {"0.5 km": 500, "1 km": 1000, "2 km": 2000, "3 km": 3000, "4 km": 4000, "district": 0}.items():
        for tier in ("accidents", "ksi"):
            n, a, b = plain_deviances([((r["easting"] // side, r["northing"] // side) if side else r["district"], r["k"]) for r in rows if tier == "accidents" or r["ksi"]])
            r = got.pop((tier, unit))
            assert (r["n_units"], r["model_deviance"], r["naive_deviance"], r["deviance_skill"]) == (n, pytest.approx(a, abs=2e-6), pytest.approx(b, abs=2e-6), pytest.approx(100 * (b - a) / b, abs=1e-3)), (tier, unit)
    assert not got


def test_queries_take_the_published_draws(spark, monkeypatch):
    d, seen = "/root/testdata/sf0.001", []
    for name in ("ensembles", "p95_analytic"):
        monkeypatch.setattr(model, name, (lambda real: lambda f, c: seen.append(c.draws) or real(f, c))(getattr(model, name)))
    for q in ("cell_ensembles", "p95_analytic_whole", "forecast_documents"):
        queries.QUERIES[q](spark, d)
    assert seen == [400] * 3  # both tiers of a forecast are drawn together
