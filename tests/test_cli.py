"""The five commands, from an incident file to a settlement."""

import json

import pytest

from gridrisk import cli


@pytest.fixture(scope="module")
def work(tmp_path_factory):
    d = tmp_path_factory.mktemp("cli")
    lines = ["location_easting_osgr,location_northing_osgr,collision_severity,date,local_authority_ons_district"]
    for t in range(30):
        for i in range(3):
            for j in range((t + i) % 3 + 1):
                lines.append(f"{500500 + 1000 * i},155500,{1 + (j + t) % 3},{1 + j:02d}/{t % 12 + 1:02d}/{2020 + t // 12},E{i}")
    (d / "in.csv").write_text("\n".join(lines) + "\nNULL,155500,1,01/01/2020,E0\n")
    return d


def run(spark, *words):
    return cli.main([str(w) for w in words], spark)


def test_commands(spark, work, capsys):
    assert run(spark, "build", "--source", work / "in.csv", "--out", work / "panel", "--csv") == 0
    assert "n_accepted" in capsys.readouterr().out
    assert next((work / "panel").glob("*.csv")).read_text().splitlines()[0] == "month,cell,accidents,ksi,weighted_days"
    assert run(spark, "backtest", "--panel", work / "panel", "--n", 20, "--ar", "--spatial-r", 1, "--shrink", 5) == 0
    assert "poisson-factor+sp(r1,a5)+ar1" in capsys.readouterr().out
    assert run(spark, "forecast", "--panel", work / "panel", "--out", work / "frozen", "--train-through", "2022-03", "--last", "2022-05", "--n", 20) == 0
    months = sorted(p.name for p in (work / "frozen").iterdir() if p.name.startswith("target_month"))
    assert months == ["target_month=2022-04", "target_month=2022-05"]
    assert run(spark, "resolve", "--forecasts", work / "frozen", "--panel", work / "panel", "--out", work / "settled") == 0
    assert "in_interval" in capsys.readouterr().out
    text = next((work / "settled" / "target_month=2022-04").glob("*.txt")).read_text()
    first, _ = json.JSONDecoder().raw_decode(text)
    assert first["n"] == 3 and first["tier"] in ("accidents", "ksi") and sum(line[2] for line in first["reliability"]) == 3


def test_sweep(spark, work, capsys):
    assert run(spark, "sweep", "--source", work / "in.csv", "--n", 10) == 0
    out = capsys.readouterr().out
    assert all(unit in out for unit in ("0.5 km", "4 km", "district"))


def test_errors(spark, work, capsys):
    assert run(spark, "build", "--source", work / "none.csv", "--out", work / "x") == 1
    assert run(spark, "forecast", "--panel", work / "none", "--out", work / "x") == 1
    assert run(spark, "forecast", "--panel", work / "in.csv", "--out", work / "x") == 1
    assert len([x for x in capsys.readouterr().err.splitlines() if x]) == 3
    with pytest.raises(SystemExit):
        run(spark, "build", "--out", work / "x")
