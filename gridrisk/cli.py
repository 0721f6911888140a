"""python -m gridrisk.cli build | sweep | backtest | forecast | resolve"""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import Observation, SparkSession

from .config import ModelConfig
from .operators import panel as panels
from .plans import backtest, forecast, resolve, sweep
from .sources import documents, incidents, panels as panel_files
from .sources.work import staged


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gridrisk")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build", help="incident CSV to dense panel")
    b.add_argument("--source", required=True)
    b.add_argument("--out", required=True)
    b.add_argument("--cell-km", type=float, default=1.0)
    b.add_argument("--csv", action="store_true")
    s = sub.add_parser("sweep", help="skill by grouping unit")
    s.add_argument("--source", required=True)
    t = sub.add_parser("backtest", help="expanding-window scores of a panel")
    t.add_argument("--panel", required=True)
    t.add_argument("--col", default="accidents")
    t.add_argument("--hist-k", type=int, default=0)
    t.add_argument("--spatial-r", type=int, default=0)
    t.add_argument("--shrink", type=float, default=1.0)
    t.add_argument("--ar", action="store_true")
    for x in (s, t):
        x.add_argument("--min-history", type=int, default=24)
    f = sub.add_parser("forecast", help="freeze forward forecasts")
    f.add_argument("--panel", required=True)
    f.add_argument("--out", required=True)
    f.add_argument("--train-through")
    f.add_argument("--first", metavar="YYYY-MM")
    f.add_argument("--last", metavar="YYYY-MM")
    f.add_argument("--cell-km", type=float, default=1.0)
    f.add_argument("--seed", type=int, default=1)
    for x in (s, t, f):
        x.add_argument("--n", type=int, default=400)
    r = sub.add_parser("resolve", help="settle frozen forecasts")
    r.add_argument("--forecasts", required=True)
    r.add_argument("--panel", required=True)
    r.add_argument("--out")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("gridrisk").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        if a.command in ("build", "sweep"):
            typed = incidents.typed(incidents.read_csv(spark, a.source))
            if a.command == "build":
                seen = Observation("build")
                counted = staged(panels.counts(incidents.observed(typed, seen), panels.by_cell(1000 * a.cell_km)), "counts")  # the one scan of the source
                panel_files.write(panels.densify(counted), a.out, a.csv)
                spark.createDataFrame([seen.get]).select("n_read", "n_bad_coordinates", "n_outside", "n_bad_date", "n_accepted").show()
            else:
                sweep.skill(incidents.accepted(typed), config=ModelConfig(n=a.n), min_history=a.min_history).orderBy("tier", "unit").show()
        elif a.command == "backtest":
            p = panel_files.read(spark, a.panel, (a.col,)).withColumnRenamed(a.col, "y")
            for df in backtest.report(p, ModelConfig(a.n, 1, a.hist_k, a.shrink, a.spatial_r, a.ar), a.min_history).values():
                df.show(100, truncate=False)
        elif a.command == "forecast":
            forecast.publish(panel_files.read(spark, a.panel), a.out, a.train_through, a.first, a.last, a.cell_km, a.n, a.seed, a.panel)
        else:
            d, p = documents.read_forecasts(spark, a.forecasts), panel_files.read(spark, a.panel)
            resolve.check(d, p)
            out = resolve.resolutions(documents.forecast_cells(d), documents.forecast_totals(d), p, a.panel)
            out.show(100)
            if a.out:
                documents.write(out, a.out, indent=True)
    except (ValueError, AnalysisException) as e:  # a missing path is Spark's to notice
        print(str(e).partition("\n")[0], file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
