"""The registered queries: each operator over incidents that the order tables stand in for, with SQL that gives the same rows.

Doubles are rounded to six places on both sides. The horizon of forward forecasts is the year after the panel's last
full month.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import streaming
from ..config import TIERS, ModelConfig
from ..functions import calendar, chance, geo, numbers
from ..operators import model, panel as panels, scoring, splitting
from ..sources import documents, incidents, panels as panel_source
from ..sources.work import new_folder, staged
from . import backtest, forecast, resolve, sweep

MIN_HISTORY = 24
IID, TRAILING, SPATIAL = ModelConfig(), ModelConfig(hist_k=24), ModelConfig(radius=2, shrink=20, ar=True)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def six(c: str | F.Column, name: str | None = None):
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name or c)


def raw(spark: SparkSession, d: str, sparse: bool = False) -> DataFrame:
    return incidents.typed(incidents.from_orders(spark, d, sparse))


def accepted(spark: SparkSession, d: str, sparse: bool = False) -> DataFrame:
    return incidents.accepted(raw(spark, d, sparse))


def measure(spark: SparkSession, d: str, column: str = "accidents", sparse: bool = False) -> DataFrame:
    return panels.build(accepted(spark, d, sparse), panels.by_cell()).select("entity", "k", F.col(column).alias("y"))


def fitted(spark: SparkSession, d: str, config: ModelConfig, column: str = "accidents", sparse: bool = False) -> model.Fitted:
    """The stages of the backtest's months."""
    return backtest.fit(measure(spark, d, column, sparse), config, MIN_HISTORY, True)


def incident_sql(sparse: bool = False) -> str:
    e = "500000 + (o_custkey * 7919) % 65000" if sparse else "CASE WHEN o_orderkey % 97 = 0 THEN 700000 ELSE 500000 + 1000 * (o_custkey % 13) + o_orderkey % 1000 END"
    n = "155000 + (o_custkey * 104729) % 50000" if sparse else "155000 + 1000 * ((o_custkey // 13) % 10) + (o_orderkey // 7) % 1000"
    return f"""inc AS (
  SELECT {e} AS e, {n} AS n, substr(o_orderpriority, 1, 1) AS sev, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INT) AS k, 'N' || c_nationkey AS district
  FROM orders JOIN customer ON o_custkey = c_custkey),
acc AS (
  SELECT *, sev IN ('1', '2') AS serious, CASE sev WHEN '1' THEN 10 WHEN '2' THEN 4 WHEN '3' THEN 1 ELSE 0 END AS tenths,
         CAST(floor(e / 1000) AS BIGINT) || '_' || CAST(floor(n / 1000) AS BIGINT) AS cell
  FROM inc WHERE e BETWEEN 500000 AND 565000 AND n BETWEEN 155000 AND 205000)"""


def panel_sql(unit: str = "cell", where: str = "true", sparse: bool = False) -> str:
    return f"""{incident_sql(sparse)},
cnt AS (SELECT {unit} AS entity, k, count(*) AS accidents, count(*) FILTER (serious) AS ksi, CAST(sum(tenths) AS BIGINT) AS tenths FROM acc WHERE {where} AND {unit} <> '' GROUP BY ALL),
panel AS (
  SELECT a.entity, b.k, coalesce(accidents, 0) AS accidents, coalesce(ksi, 0) AS ksi, coalesce(tenths, 0) AS tenths
  FROM (SELECT DISTINCT entity FROM cnt) a CROSS JOIN (SELECT DISTINCT k FROM cnt) b LEFT JOIN cnt ON cnt.entity = a.entity AND cnt.k = b.k)"""


def poisson_sql(rates: str, by: str, out: str, u: str, z: str) -> str:
    """Poisson counts n of a table's rates r: the inverse distribution function at u up to 30, beyond it the rounded normal at z."""
    return f"""{out}_steps AS (
  SELECT {by}, u, sum(exp(-r + c * ln(r) - lgamma(c + 1))) OVER (PARTITION BY {by} ORDER BY c) AS cdf
  FROM (SELECT {by}, r, {u} AS u, unnest(range(0, CAST(trunc(r + 10 * sqrt(r) + 15) AS BIGINT))) AS c FROM {rates} WHERE r > 0 AND r <= 30) x),
{out}_small AS (SELECT {by}, count(*) FILTER (u > cdf) AS n FROM {out}_steps GROUP BY ALL),
{out} AS (SELECT {by}, CAST(CASE WHEN r <= 0 THEN 0 WHEN r > 30 THEN greatest(0, trunc(r + sqrt(r) * {z} + 0.5)) ELSE n END AS BIGINT) AS n FROM {rates} LEFT JOIN {out}_small USING ({by}))"""


def uniform_sql(*key: str) -> str:
    """chance.uniform of a key, given as SQL."""
    joined = " || '|' || ".join(key)
    return f"((('0x' || substr(md5({joined}), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)"


def normal_sql(u: str, v: str) -> str:
    return f"(sqrt(-2 * ln({u})) * cos(2 * pi() * {v}))"


def model_sql(config: ModelConfig, column: str = "accidents", sparse: bool = False, unit: str = "cell", where: str = "true", forward: bool = False) -> str:
    """The stages of the model as common table expressions, each target's window joined as its definition says.

    forward: targets are the twelve months after the panel's last but one, and the last isn't known.
    """
    r, a = config.radius, config.weight
    mean, sd = ("CASE WHEN n >= 3 THEN mu + pow(phi, h) * (f_last - mu) ELSE 0.0 END", "CASE WHEN n >= 3 THEN sigma * sqrt(1 - pow(phi, 2 * h)) ELSE sigma END") if config.ar else ("0.0", "sigma")
    u = lambda s: uniform_sql(f"'{config.seed}'", "target", "member", f"'{s}'")
    known = "k <= (SELECT max(k) - 1 FROM panel)" if forward else "true"
    targets = """SELECT (SELECT max(k) FROM axis) + i AS target, (SELECT max(ord) FROM axis) + 1 AS target_ord, CAST(NULL AS INT) AS cutoff FROM (SELECT unnest(range(1, 13)) AS i) x""" if forward else f"""SELECT t.k AS target, t.ord AS target_ord, c.k AS cutoff FROM axis t LEFT JOIN axis c ON {config.hist_k} > 0 AND c.ord = t.ord - {config.hist_k} WHERE t.ord > {MIN_HISTORY}"""
    prior = f"""near AS (
  SELECT c.target, c.entity, CAST(sum(b.cnt) AS DOUBLE) AS near_cnt, sum(b.e) AS near_e
  FROM placed c JOIN placed b ON b.target = c.target AND b.i BETWEEN c.i - {r} AND c.i + {r} AND b.j BETWEEN c.j - {r} AND c.j + {r} AND b.entity <> c.entity
  GROUP BY ALL),
priors AS (SELECT c.*, coalesce(CASE WHEN near_e > 0 THEN near_cnt / near_e END, overall) AS prior FROM placed c LEFT JOIN near USING (target, entity) JOIN whole USING (target))""" if r else "priors AS (SELECT c.*, overall AS prior FROM expo c JOIN whole USING (target))"
    return f"""{panel_sql(unit, where, sparse)},
p AS (SELECT entity, k, k % 12 + 1 AS moy, {column} AS y FROM panel WHERE {known}),
axis AS (SELECT k, moy, row_number() OVER (ORDER BY k) AS ord, CAST(sum(y) AS BIGINT) AS total, count(*) AS n_rows FROM p GROUP BY k, moy),
targets AS ({targets}),
known AS (SELECT target, axis.* FROM axis JOIN targets ON k < target AND (cutoff IS NULL OR k >= cutoff)),
whole AS (SELECT target, CAST(sum(total) AS DOUBLE) / sum(n_rows) AS overall FROM known GROUP BY target),
rates AS (SELECT target, moy, CAST(sum(total) AS DOUBLE) / sum(n_rows) AS rate FROM known GROUP BY ALL),
season AS (
  SELECT w.target, m.moy, coalesce(CASE WHEN overall <> 0 THEN rate / overall END, 1.0) AS s, overall
  FROM whole w CROSS JOIN (SELECT unnest(range(1, 13)) AS moy) m LEFT JOIN rates r ON r.target = w.target AND r.moy = m.moy),
expo AS (
  SELECT t.target, p.entity, CAST(sum(y) AS BIGINT) AS cnt, sum(s) AS e
  FROM p JOIN targets t ON k < t.target AND (cutoff IS NULL OR k >= cutoff) JOIN season z ON z.target = t.target AND z.moy = p.moy GROUP BY ALL),
placed AS (SELECT *, CAST(split_part(entity, '_', 1) AS INT) AS i, CAST(split_part(entity, '_', 2) AS INT) AS j FROM expo),
{prior},
based AS (SELECT *, (cnt + {a} * prior) / (e + {a}) AS base FROM priors),
sums AS (SELECT target, sum(base) AS sum_base FROM based GROUP BY target),
series AS (
  SELECT k0.target, k0.k, k0.total AS obs, sum_base * s AS expected, CASE WHEN sum_base * s > 0 THEN ln((k0.total + 0.5) / (sum_base * s + 0.5)) END AS f
  FROM known k0 JOIN sums USING (target) JOIN season z ON z.target = k0.target AND z.moy = k0.moy),
stats AS (SELECT target, max(k) AS last_k, count(f) AS n, avg(f) AS mu, sqrt(var_pop(f)) AS sigma, arg_max(f, k) AS f_last FROM series GROUP BY target),
lagged AS (SELECT target, f, lag(f) OVER (PARTITION BY target ORDER BY k) AS before FROM series WHERE f IS NOT NULL),
slopes AS (SELECT target, sum((f - mu) * (before - mu)) / nullif(sum(CASE WHEN before IS NOT NULL THEN (before - mu) * (before - mu) END), 0) AS slope FROM lagged JOIN stats USING (target) GROUP BY target),
par AS (SELECT target, n, mu, sigma, least(greatest(coalesce(slope, 0.0), 0.0), 0.95) AS phi, greatest(1, target - last_k) AS h, f_last FROM stats JOIN slopes USING (target)),
params AS (SELECT *, {mean} AS f_mean, {sd} AS f_sd FROM par),
drawn AS (SELECT target, member, f_mean + f_sd * (sqrt(-2 * ln({u("u")})) * cos(2 * pi() * {u("v")})) AS f FROM params CROSS JOIN (SELECT unnest(range(1, {config.draws + 1})) AS member) x),
lam AS (SELECT b.target, b.entity, base * s AS mu FROM based b JOIN season z ON z.target = b.target AND z.moy = b.target % 12 + 1),
pred AS (SELECT l.target, l.entity, l.mu, avg(exp(-l.mu * exp(f))) AS rating, l.mu * avg(exp(f)) AS expected FROM lam l JOIN drawn d ON d.target = l.target GROUP BY l.target, l.entity, l.mu),
mus AS (SELECT target, sum(mu) AS mu FROM lam GROUP BY target),
total_rates AS (SELECT target, member, mus.mu * exp(f) AS r FROM drawn JOIN mus USING (target)),
{poisson_sql("total_rates", "target, member", "total_counts", u("tc"), normal_sql(u("tu"), u("tv")))},
totals AS (SELECT target, member, n AS total FROM total_counts),
pool AS (SELECT target, CAST(sum(total) AS DOUBLE) / sum(n_rows) AS naive FROM axis JOIN targets ON k < target GROUP BY target),
own AS (SELECT target, entity, CAST(sum(y) AS DOUBLE) / count(*) AS rate FROM p JOIN targets ON k < target GROUP BY ALL),
lines AS (SELECT t.target, p.entity, p.y, naive, coalesce(rate, naive) AS climatology FROM p JOIN targets t ON p.k = t.target JOIN pool USING (target) LEFT JOIN own ON own.target = t.target AND own.entity = p.entity),
scored AS (
  SELECT l.target, l.entity, 'poisson-factor' AS forecaster, 1 - rating AS p, expected AS mu, y FROM lines l JOIN pred USING (target, entity)
  UNION ALL SELECT target, entity, 'naive', 1 - exp(-naive), naive, y FROM lines
  UNION ALL SELECT target, entity, 'climatology', 1 - exp(-climatology), climatology, y FROM lines),
each AS (
  SELECT *, pow(p - CASE WHEN y > 0 THEN 1 ELSE 0 END, 2) AS brier, -ln(CASE WHEN y > 0 THEN least(greatest(p, 1e-12), 1 - 1e-12) ELSE 1 - least(greatest(p, 1e-12), 1 - 1e-12) END) AS log_loss,
         2 * (CASE WHEN y > 0 THEN y * ln(y / CASE WHEN mu > 0 THEN mu ELSE 1e-12 END) ELSE 0.0 END - (y - CASE WHEN mu > 0 THEN mu ELSE 1e-12 END)) AS deviance,
         greatest(least(CAST(trunc(p * 10) AS INT), 9), 0) AS bin
  FROM scored),
curve AS (SELECT forecaster, bin, avg(p) AS mean_p, avg(CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END) AS frequency, count(*) AS n FROM each GROUP BY ALL)"""


#: Bits of their names' MD5 that tell the fixture's cells apart.
SPLIT_BITS = 16


HALF = 0.5 + splitting.TIE


def ensemble_sql(config: ModelConfig) -> str:
    """cell_counts (target, entity, member, n), after model_sql: totals split down the tree of cells, a few statements a level."""
    parts = [f"""cells AS (SELECT target, entity, mu, ('0x' || substr(md5(entity), 1, 13))::BIGINT AS place FROM lam),
nodes AS (SELECT target, level, place >> (52 - level) AS node, sum(mu) AS rate FROM cells CROSS JOIN (SELECT unnest(range(0, {SPLIT_BITS + 1})) AS level) x GROUP BY ALL),
halves AS (
  SELECT p.target, p.level, p.node, a.rate AS first, b.rate AS second FROM nodes p LEFT JOIN nodes a ON a.target = p.target AND a.level = p.level + 1 AND a.node = 2 * p.node
  LEFT JOIN nodes b ON b.target = p.target AND b.level = p.level + 1 AND b.node = 2 * p.node + 1),
walk0 AS (SELECT target, member, 0::BIGINT AS node, total AS n FROM totals WHERE total > 0)"""]
    for k in range(SPLIT_BITS):
        key = f"md5('{config.seed}|' || target || '|{k}|' || node || '|' || member)"
        u, v = (f"(('0x' || substr(m, {at}, 13))::BIGINT + 0.5) / 4503599627370496.0" for at in (1, 14))
        parts.append(f"""met{k} AS (SELECT w.target, member, w.node, n, first, second, first / (first + second) AS p FROM walk{k} w JOIN halves h ON h.target = w.target AND h.node = w.node AND level = {k}),
keyed{k} AS (SELECT *, CASE WHEN p <= {HALF} THEN p ELSE 1 - p END AS q, n * p * (1 - p) AS spread, {key} AS m FROM met{k} WHERE first IS NOT NULL AND second IS NOT NULL),
steps{k} AS (
  SELECT target, member, node, u, sum(exp(lgamma(n + 1) - lgamma(c + 1) - lgamma(n - c + 1) + c * ln(q) + (n - c) * ln(1 - q))) OVER (PARTITION BY target, member, node ORDER BY c) AS cdf
  FROM (SELECT target, member, node, n, q, {u} AS u, unnest(range(0, least(n, CAST(trunc(n * q + 10 * sqrt(spread) + 15) AS BIGINT)))) AS c FROM keyed{k} WHERE spread <= 30) x),
counted{k} AS (SELECT target, member, node, count(*) FILTER (u > cdf) AS c FROM steps{k} GROUP BY ALL),
drawn{k} AS (
  SELECT target, member, node, n, p, coalesce(c, CAST(least(n, greatest(0, trunc(n * q + sqrt(spread) * {normal_sql(u, v)} + 0.5))) AS BIGINT)) AS c FROM keyed{k} LEFT JOIN counted{k} USING (target, member, node)),
walk{k + 1} AS (
  SELECT target, member, 2 * node AS node, CASE WHEN p <= {HALF} THEN c ELSE n - c END AS n FROM drawn{k} WHERE CASE WHEN p <= {HALF} THEN c ELSE n - c END > 0
  UNION ALL SELECT target, member, 2 * node + 1, CASE WHEN p <= {HALF} THEN n - c ELSE c END FROM drawn{k} WHERE CASE WHEN p <= {HALF} THEN n - c ELSE c END > 0
  UNION ALL SELECT target, member, 2 * node + CASE WHEN first IS NULL THEN 1 ELSE 0 END, n FROM met{k} WHERE first IS NULL OR second IS NULL)""")
    parts.append(f"""cell_counts AS (
  SELECT c.target, c.entity, x.member, coalesce(n, 0) AS n FROM cells c CROSS JOIN (SELECT unnest(range(1, {config.draws + 1})) AS member) x
  LEFT JOIN walk{SPLIT_BITS} w ON w.target = c.target AND w.member = x.member AND w.node = c.place >> {52 - SPLIT_BITS})""")
    return ",\n".join(parts)


@query(f"WITH {incident_sql()} SELECT cell, count(*) AS n FROM acc GROUP BY cell")
def cell_id_counts(spark: SparkSession, d: str) -> DataFrame:
    return accepted(spark, d).groupBy(panels.by_cell().alias("cell")).agg(F.count("*").alias("n"))


@query(f"WITH {incident_sql()} SELECT DISTINCT cell, (floor(e / 1000) + 0.5) * 1000 AS easting, (floor(n / 1000) + 0.5) * 1000 AS northing FROM acc")
def cell_centroids(spark: SparkSession, d: str) -> DataFrame:
    c = accepted(spark, d).select(panels.by_cell().alias("cell")).distinct().withColumn("c", geo.cell_centroid(F.col("cell"), 1000.0))
    return c.select("cell", "c.easting", "c.northing")


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INT) AS k, CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS moy, count(*) AS n FROM orders GROUP BY ALL")
def month_parse(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/orders.parquet").select(F.date_format("o_orderdate", "dd/MM/yyyy").alias("date"))
    k = calendar.parse_month(calendar.month_text(calendar.parse_date_month(F.col("date"))))
    t = t.select(k.alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    return t.select(calendar.month_text(F.col("k")).alias("month"), "k", calendar.year_of(F.col("k")).alias("year"), calendar.month_of(F.col("k")).alias("moy"), "n")


@query("""SELECT count(*) AS n_read, count(*) FILTER (o_orderkey % 11 = 0 AND o_orderkey % 5 <> 0) AS n_bad_date, count(*) FILTER (o_orderkey % 5 = 0) AS n_bad_number,
count(*) FILTER (o_orderkey % 11 <> 0 AND o_orderkey % 5 <> 0) AS n_good FROM orders""")
def bad_row_filter(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    number = F.when(key % 5 == 0, F.concat(F.lit(" "), key.cast("string"), F.lit("d"))).otherwise(key.cast("string"))
    month = F.when(key % 11 == 0, F.date_format("o_orderdate", "yyyy-'13'")).otherwise(F.date_format("o_orderdate", "yyyy-MM"))
    t = spark.read.parquet(f"{d}/orders.parquet").select(numbers.strict_double(number).alias("v"), calendar.parse_month(month).alias("k"))
    v, k = F.col("v").isNotNull(), F.col("k").isNotNull()
    return t.agg(F.count("*").alias("n_read"), F.count_if(v & ~k).alias("n_bad_date"), F.count_if(~v).alias("n_bad_number"), F.count_if(v & k).alias("n_good"))


@query(f"WITH {incident_sql()} SELECT count(*) AS n_read, CAST(0 AS BIGINT) AS n_bad_coordinates, (SELECT count(*) FROM inc) - (SELECT count(*) FROM acc) AS n_outside, CAST(0 AS BIGINT) AS n_bad_date, (SELECT count(*) FROM acc) AS n_accepted FROM inc")
def ingest_counters(spark: SparkSession, d: str) -> DataFrame:
    return incidents.counters(raw(spark, d))


@query(f"WITH {incident_sql()} SELECT sev AS severity, serious AS ksi, count(*) AS n, CAST(sum(tenths) AS BIGINT) AS tenths FROM acc GROUP BY ALL")
def severity_rollup(spark: SparkSession, d: str) -> DataFrame:
    return accepted(spark, d).groupBy("severity", "ksi").agg(F.count("*").alias("n"), F.sum("tenths").alias("tenths"))


@query(f"WITH {panel_sql()} SELECT * FROM panel")
def panel_dense(spark: SparkSession, d: str) -> DataFrame:
    return panels.build(accepted(spark, d), panels.by_cell())


@query(f"WITH {panel_sql(where='serious', sparse=True)} SELECT * FROM panel")
def panel_dense_ksi_axis(spark: SparkSession, d: str) -> DataFrame:
    return panels.build(accepted(spark, d, sparse=True), panels.by_cell(), "tier")


@query(f"WITH {panel_sql('district')} SELECT * FROM panel")
def panel_by_district(spark: SparkSession, d: str) -> DataFrame:
    return panels.build(accepted(spark, d), panels.by_district())


@query(f"WITH {panel_sql()} SELECT 'accidents' AS tier, entity, k, accidents AS y FROM panel UNION ALL SELECT 'ksi', entity, k, ksi FROM panel")
def tier_union(spark: SparkSession, d: str) -> DataFrame:
    return panels.tiers(panel_dense(spark, d))


@query(f"WITH {panel_sql()} SELECT count(*) AS n_rows, count(DISTINCT entity) AS n_entities, count(DISTINCT k) AS n_months, CAST(0 AS BIGINT) AS n_repeated, true AS dense FROM panel")
def panel_density(spark: SparkSession, d: str) -> DataFrame:
    return panels.density(panel_dense(spark, d))


@query(f"WITH {model_sql(IID)} SELECT target, moy, round(s, 6) AS s, round(overall, 6) AS overall FROM season")
def season_profile(spark: SparkSession, d: str) -> DataFrame:
    return fitted(spark, d, IID)["seasons"].select("target", "moy", six("s"), six("overall"))


@query(f"WITH {model_sql(TRAILING)} SELECT target, moy, round(s, 6) AS s, round(overall, 6) AS overall FROM season")
def season_trailing_k(spark: SparkSession, d: str) -> DataFrame:
    return fitted(spark, d, TRAILING)["seasons"].select("target", "moy", six("s"), six("overall"))


@query(f"WITH {model_sql(TRAILING)} SELECT target, entity, cnt, round(e, 6) AS e FROM expo")
def cell_exposure(spark: SparkSession, d: str) -> DataFrame:
    return fitted(spark, d, TRAILING)["based"].select("target", "entity", "cnt", six("e"))


@query(f"WITH {model_sql(IID)} SELECT target, entity, round(e, 6) AS e, cnt FROM expo")
def cell_exposure_general(spark: SparkSession, d: str) -> DataFrame:
    """The path for panels that aren't dense: running sums by month of the year, which marks of the targets read."""
    f = backtest.fit(measure(spark, d), IID, MIN_HISTORY, dense=False)
    return f["based"].select("target", "entity", six("e"), "cnt")


@query(f"WITH {model_sql(IID)} SELECT target, entity, round(base, 6) AS base FROM based")
def base_global(spark: SparkSession, d: str) -> DataFrame:
    return fitted(spark, d, IID)["based"].select("target", "entity", six("base"))


@query(f"WITH {model_sql(SPATIAL, 'ksi')} SELECT target, entity, round(prior, 6) AS prior FROM based")
def neighbour_prior(spark: SparkSession, d: str) -> DataFrame:
    return fitted(spark, d, SPATIAL, "ksi")["based"].select("target", "entity", six("prior"))


@query(f"WITH {model_sql(SPATIAL, 'ksi')} SELECT target, entity, round(base, 9) AS base FROM based")
def base_spatial(spark: SparkSession, d: str) -> DataFrame:
    return fitted(spark, d, SPATIAL, "ksi")["based"].select("target", "entity", F.round("base", 9).alias("base"))  # sums of 64ths tie at six places


@query(f"WITH {model_sql(IID)} SELECT target, k, obs, round(expected, 6) AS expected, round(f, 6) AS f FROM series")
def factor_series(spark: SparkSession, d: str) -> DataFrame:
    return fitted(spark, d, IID)["series"].select("target", "k", "obs", six("expected"), six("f"))


@query(f"WITH {model_sql(IID)} SELECT target, round(f_mean, 6) AS f_mean, round(f_sd, 6) AS f_sd FROM params")
def factor_sigma(spark: SparkSession, d: str) -> DataFrame:
    return fitted(spark, d, IID)["parameters"].select("target", six("f_mean"), six("f_sd"))


@query(f"WITH {model_sql(SPATIAL)} SELECT target, n, round(mu, 6) AS mu, round(sigma, 6) AS sigma, round(phi, 6) AS phi, h FROM params")
def factor_ar1(spark: SparkSession, d: str) -> DataFrame:
    return fitted(spark, d, SPATIAL)["parameters"].select("target", "n", six("mu"), six("sigma"), six("phi"), "h")


@query(f"WITH {model_sql(SPATIAL)} SELECT target, round(f_last, 6) AS f_last, round(f_mean, 6) AS f_mean, round(f_sd, 6) AS f_sd FROM params")
def factor_forecast(spark: SparkSession, d: str) -> DataFrame:
    return fitted(spark, d, SPATIAL)["parameters"].select("target", six("f_last"), six("f_mean"), six("f_sd"))


@query(f"WITH {model_sql(IID)} SELECT target, member, round(f, 6) AS f FROM drawn")
def factor_draws(spark: SparkSession, d: str) -> DataFrame:
    return fitted(spark, d, IID)["drawn"].select("target", "member", six("f"))


@query(f"WITH {model_sql(IID)} SELECT target, entity, round(rating, 6) AS rating, round(expected, 6) AS expected FROM pred")
def ratings_iid(spark: SparkSession, d: str) -> DataFrame:
    return model.predict(fitted(spark, d, IID), IID).select("target", "entity", six("rating"), six("expected"))


@query(f"WITH {model_sql(SPATIAL, 'ksi')} SELECT target, entity, round(rating, 6) AS rating, round(expected, 6) AS expected FROM pred")
def ratings_ar_spatial(spark: SparkSession, d: str) -> DataFrame:
    return model.predict(fitted(spark, d, SPATIAL, "ksi"), SPATIAL).select("target", "entity", six("rating"), six("expected"))


TOP = model_sql(IID)


@query(f"""WITH {TOP}, last AS (SELECT max(target) AS target FROM targets),
ranked AS (SELECT entity, round(1 - rating, 6) AS p_incident, round(expected, 6) AS expected FROM pred JOIN last USING (target))
SELECT * FROM ranked ORDER BY p_incident DESC, entity LIMIT 20""")
def riskiest_cells(spark: SparkSession, d: str) -> DataFrame:
    """The twenty cells most likely to have an incident in the last month, as forecast from the months before it."""
    f = fitted(spark, d, IID)
    last = f["targets"].agg(F.max("target").alias("target"))
    p = model.predict(f, IID).join(F.broadcast(last), "target").select("entity", six(1 - F.col("rating"), "p_incident"), six("expected"))
    return p.orderBy(F.desc("p_incident"), "entity").limit(20)


FEW = ModelConfig(n=50)


def _p95_analytic_sql(config: ModelConfig) -> str:
    return f"""WITH {model_sql(config, "ksi", unit="district")}, unit_rates AS (SELECT l.target, l.entity, l.mu * exp(f) AS r FROM lam l JOIN drawn d ON d.target = l.target),
tops AS (SELECT target, entity, max(r) AS top FROM unit_rates GROUP BY ALL),
counts AS (SELECT target, entity, unnest(range(0, CAST(trunc(top + 10 * sqrt(top) + 15) AS BIGINT) + 1)) AS c FROM tops),
terms AS (
  SELECT target, entity, c, avg(CASE WHEN r > 0 THEN exp(-r + c * ln(r) - lgamma(c + 1)) WHEN c = 0 THEN 1.0 ELSE 0.0 END) AS mass
  FROM unit_rates JOIN counts USING (target, entity) GROUP BY ALL),
cdfs AS (SELECT target, entity, c, sum(mass) OVER (PARTITION BY target, entity ORDER BY c) AS cdf FROM terms)
SELECT target, entity, min(c) FILTER (cdf >= 0.95) AS p95 FROM cdfs GROUP BY ALL"""


def _p95_analytic(spark: SparkSession, d: str, config: ModelConfig) -> DataFrame:
    counted = staged(panels.counts(accepted(spark, d), panels.by_district()), "counts")  # entities, months and values are each read from it
    p = panels.densify(counted).select("entity", "k", F.col("ksi").alias("y"))
    return model.p95_analytic(backtest.fit(p, config, MIN_HISTORY, True), config)


@query(_p95_analytic_sql(FEW))
def p95_analytic(spark: SparkSession, d: str) -> DataFrame:
    return _p95_analytic(spark, d, FEW)


@query(_p95_analytic_sql(IID))
def p95_analytic_whole(spark: SparkSession, d: str) -> DataFrame:
    """p95_analytic with the draws of the published model."""
    return _p95_analytic(spark, d, IID)


@query(f"""WITH {model_sql(IID)}, ranked AS (SELECT target, total, row_number() OVER (PARTITION BY target ORDER BY total) - 1 AS i, count(*) OVER (PARTITION BY target) AS n FROM totals)
SELECT target, max(total) FILTER (i = floor(0.05 * (n - 1))) AS total_p5, max(total) FILTER (i = floor(0.5 * (n - 1))) AS total_p50, max(total) FILTER (i = floor(0.95 * (n - 1))) AS total_p95 FROM ranked GROUP BY target""")
def total_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return model.total_quantiles(model.totals(fitted(spark, d, IID), IID))


@query(f"WITH {model_sql(IID)} SELECT target, entity, round(naive, 6) AS rate, round(1 - exp(-naive), 6) AS p FROM lines")
def naive_forecast(spark: SparkSession, d: str) -> DataFrame:
    f = fitted(spark, d, IID)
    b = backtest.baselines(f["panel"], f["targets"], f["axis"])
    return b.select("target", "entity", six("naive", "rate"), six(numbers.occurrence(F.col("naive")), "p"))


@query(f"WITH {model_sql(IID)} SELECT target, entity, round(climatology, 6) AS rate, round(1 - exp(-climatology), 6) AS p FROM lines")
def climatology_forecast(spark: SparkSession, d: str) -> DataFrame:
    f = fitted(spark, d, IID)
    b = backtest.baselines(f["panel"], f["targets"], f["axis"])
    return b.select("target", "entity", six("climatology", "rate"), six(numbers.occurrence(F.col("climatology")), "p"))


def _means(spark: SparkSession, d: str, forecaster: str) -> DataFrame:
    rows = backtest.scored(fitted(spark, d, IID), IID, (forecaster,))
    return scoring.means(rows, ["forecaster"]).select("forecaster", six("brier"), six("log_loss"), six("deviance"), "n")


def _means_sql(forecaster: str) -> str:
    return f"WITH {model_sql(IID)} SELECT forecaster, round(avg(brier), 6) AS brier, round(avg(log_loss), 6) AS log_loss, round(avg(deviance), 6) AS deviance, count(*) AS n FROM each WHERE forecaster = '{forecaster}' GROUP BY forecaster"


@query(_means_sql("naive"))
def score_naive(spark: SparkSession, d: str) -> DataFrame:
    return _means(spark, d, "naive")


@query(_means_sql("climatology"))
def score_climatology(spark: SparkSession, d: str) -> DataFrame:
    return _means(spark, d, "climatology")


@query(_means_sql("poisson-factor"))
def score_model(spark: SparkSession, d: str) -> DataFrame:
    return _means(spark, d, "poisson-factor")


@query(f"WITH {model_sql(IID)} SELECT forecaster, bin, round(mean_p, 6) AS mean_p, round(frequency, 6) AS frequency, n FROM curve")
def reliability_curve(spark: SparkSession, d: str) -> DataFrame:
    rows = backtest.scored(fitted(spark, d, IID), IID)
    return scoring.reliability(rows, ["forecaster"]).select("forecaster", "bin", six("mean_p"), six("frequency"), "n")


@query(f"WITH {model_sql(IID)} SELECT forecaster, round(sum(n * abs(mean_p - frequency)) / sum(n), 6) AS calibration_error FROM curve GROUP BY forecaster")
def calibration_error(spark: SparkSession, d: str) -> DataFrame:
    rows = backtest.scored(fitted(spark, d, IID), IID)
    return scoring.calibration_error(scoring.reliability(rows, ["forecaster"]), ["forecaster"]).select("forecaster", six("calibration_error"))


def _totals(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    f = fitted(spark, d, IID)
    return model.totals(f, IID), backtest.realised(f)


@query(f"""WITH {model_sql(IID)}, ranked AS (SELECT target, totals.total, axis.total AS y, row_number() OVER (PARTITION BY target ORDER BY totals.total, member) - 1 AS i, count(*) OVER (PARTITION BY target) AS n FROM totals JOIN axis ON k = target)
SELECT target, round(avg(abs(total - y)) - CAST(sum((2 * i - n + 1) * total) AS DOUBLE) / max(n * n), 6) AS crps FROM ranked GROUP BY target""")
def crps_by_month(spark: SparkSession, d: str) -> DataFrame:
    return scoring.crps(*_totals(spark, d)).select("target", six("crps"))


@query(f"""WITH {model_sql(IID)}, ranked AS (SELECT target, totals.total, axis.total AS y, row_number() OVER (PARTITION BY target ORDER BY totals.total) - 1 AS i, count(*) OVER (PARTITION BY target) AS n FROM totals JOIN axis ON k = target),
q AS (SELECT target, y, max(total) FILTER (i = floor(0.05 * (n - 1))) AS low, max(total) FILTER (i = floor(0.95 * (n - 1))) AS high FROM ranked GROUP BY target, y)
SELECT *, y BETWEEN low AND high AS covered FROM q""")
def coverage_by_month(spark: SparkSession, d: str) -> DataFrame:
    return scoring.coverage(*_totals(spark, d))


@query(f"""WITH {model_sql(IID)}, ranked AS (SELECT target, totals.total, axis.total AS y, row_number() OVER (PARTITION BY target ORDER BY totals.total) - 1 AS i, count(*) OVER (PARTITION BY target) AS n FROM totals JOIN axis ON k = target),
months AS (
  SELECT target, avg(abs(total - y)) - CAST(sum((2 * i - n + 1) * total) AS DOUBLE) / max(n * n) AS crps,
         CASE WHEN max(y) BETWEEN max(total) FILTER (i = floor(0.05 * (n - 1))) AND max(total) FILTER (i = floor(0.95 * (n - 1))) THEN 1.0 ELSE 0.0 END AS covered
  FROM ranked GROUP BY target),
whole_totals AS (SELECT round(avg(crps), 6) AS crps, round(avg(covered), 6) AS coverage FROM months),
means AS (SELECT forecaster, round(avg(brier), 6) AS brier, round(avg(log_loss), 6) AS log_loss, round(avg(deviance), 6) AS deviance, count(*) AS n FROM each GROUP BY forecaster),
errors AS (SELECT forecaster, round(sum(n * abs(mean_p - frequency)) / sum(n), 6) AS calibration_error FROM curve GROUP BY forecaster)
SELECT forecaster, brier, log_loss, deviance, n, calibration_error, CASE WHEN forecaster = 'poisson-factor' THEN crps END AS total_crps,
       CASE WHEN forecaster = 'poisson-factor' THEN coverage END AS total_coverage, CASE WHEN forecaster = 'poisson-factor' THEN '{IID.name}' END AS model_name
FROM means JOIN errors USING (forecaster) CROSS JOIN whole_totals""")
def backtest_report(spark: SparkSession, d: str) -> DataFrame:
    """The whole report: mean scores, calibration, and the means over months of the totals' CRPS and interval coverage."""
    s = backtest.report(measure(spark, d), IID, MIN_HISTORY, True)["scores"]
    return s.select("forecaster", *[six(c) for c in ("brier", "log_loss", "deviance")], "n", *[six(c) for c in ("calibration_error", "total_crps", "total_coverage")], "model_name")


@query(f"""WITH {panel_sql()}, end_of AS (SELECT max(k) - 6 AS through FROM panel), known AS (SELECT entity, k, accidents FROM panel, end_of WHERE k <= through)
SELECT entity, CAST(count(*) AS BIGINT) AS n_months, CAST(sum(accidents) AS BIGINT) AS accidents FROM known GROUP BY entity""")
def asof_history(spark: SparkSession, d: str) -> DataFrame:
    p = staged(panel_dense(spark, d), "panel")
    through = p.agg(F.max("k")).first()[0] - 6
    return forecast.as_at(p, through).groupBy("entity").agg(F.count("k").alias("n_months"), F.coalesce(F.sum("accidents"), F.lit(0)).alias("accidents"))


def _frozen(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cells and totals of forecasts of three months that the rate of the year before freezes, and the panel.

    The cells of the southernmost row aren't forecast, and the interval is narrow, so that some totals fall outside it.
    """
    p = staged(panel_dense(spark, d), "panel")
    through = p.agg(F.max("k")).first()[0] - 4
    rates = p.where((F.col("k") <= through) & (F.col("k") > through - 12) & ~F.col("entity").endswith("_155")).groupBy("entity")
    rates = rates.agg((F.sum("accidents") / 12.0).alias("accidents"), (F.sum("ksi") / 12.0).alias("ksi")).unpivot(["entity"], ["accidents", "ksi"], "tier", "rate")
    months = spark.range(through + 1, through + 4).select(calendar.month_text(F.col("id")).alias("target_month"), F.lit(calendar.month_text_py(through)).alias("train_through"))
    half_up = numbers.round_half_up
    cells = rates.select("tier", F.col("entity").alias("cell"), half_up(F.exp(-F.col("rate")), 4).alias("rating"), half_up(F.col("rate"), 4).alias("expected"), F.lit(0).cast("long").alias("p95"))
    totals = rates.groupBy("tier").agg(half_up(F.sum("rate"), 1).alias("expected_total"))
    totals = totals.select("tier", F.lit("frozen").alias("model"), "expected_total", *[half_up(F.col("expected_total") * x, 1).alias(c) for c, x in (("total_p5", 0.9), ("total_p50", 1.0), ("total_p95", 1.1))])
    dated = lambda df: df.crossJoin(F.broadcast(months)).select("target_month", "train_through", *df.columns)
    return dated(cells), dated(totals), p


FROZEN = f"""{panel_sql()}, lim AS (SELECT max(k) AS last, max(k) - 4 AS through FROM panel),
rates AS (SELECT entity, sum(accidents) / 12.0 AS a, sum(ksi) / 12.0 AS s FROM panel, lim WHERE k <= through AND k > through - 12 AND NOT entity LIKE '%\\_155' ESCAPE '\\' GROUP BY entity),
tiers AS (SELECT 'accidents' AS tier, entity, a AS rate FROM rates UNION ALL SELECT 'ksi', entity, s FROM rates),
frozen AS (SELECT tier, entity, trunc(exp(-rate) * 10000 + 0.5) / 10000 AS rating, trunc(rate * 10000 + 0.5) / 10000 AS expected FROM tiers),
wholes AS (SELECT tier, trunc(sum(rate) * 10 + 0.5) / 10 AS expected_total FROM tiers GROUP BY tier),
intervals AS (SELECT tier, expected_total, trunc(expected_total * 0.9 * 10 + 0.5) / 10 AS total_p5, trunc(expected_total * 1.1 * 10 + 0.5) / 10 AS total_p95 FROM wholes),
dated AS (SELECT CAST(through + i AS INT) AS target, (through + i) // 12 || '-' || lpad(CAST((through + i) % 12 + 1 AS VARCHAR), 2, '0') AS target_month FROM lim, (SELECT unnest(range(1, 4)) AS i) x),
settled AS (
  SELECT tier, target, target_month, f.entity AS cell, 1 - rating AS p, expected AS mu, CASE tier WHEN 'ksi' THEN ksi ELSE accidents END AS y
  FROM frozen f CROSS JOIN dated JOIN panel p ON p.entity = f.entity AND p.k = target),
months AS (SELECT 'accidents' AS tier, k AS target, sum(accidents) AS all_total FROM panel GROUP BY k UNION ALL SELECT 'ksi', k, sum(ksi) FROM panel GROUP BY k),
bins AS (
  SELECT tier, target, greatest(least(CAST(trunc(p * 10) AS INT), 9), 0) AS bin, avg(p) AS mean_p, avg(CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END) AS frequency, count(*) AS n
  FROM settled GROUP BY ALL),
resolved AS (
  SELECT tier, target, target_month, count(*) AS n, round(avg(pow(p - CASE WHEN y > 0 THEN 1 ELSE 0 END, 2)), 6) AS brier,
         round(avg(2 * (CASE WHEN y > 0 THEN y * ln(y / CASE WHEN mu > 0 THEN mu ELSE 1e-12 END) ELSE 0.0 END - (y - CASE WHEN mu > 0 THEN mu ELSE 1e-12 END))), 6) AS deviance,
         CAST(sum(y) AS BIGINT) AS realised_total, sum(y) BETWEEN max(total_p5) AND max(total_p95) AS in_interval, CAST(max(all_total) - sum(y) AS BIGINT) AS unforecast_total
  FROM settled JOIN intervals USING (tier) JOIN months USING (tier, target) GROUP BY ALL)"""
MATRIX = "SELECT tier, target, bin, trunc(mean_p * 1000 + 0.5) / 1000 AS mean_p, trunc(frequency * 1000 + 0.5) / 1000 AS frequency, n FROM bins"


@query(f"WITH {FROZEN} SELECT tier, target, cell, round(p, 6) AS p, round(mu, 6) AS mu, y FROM settled")
def settle_cells(spark: SparkSession, d: str) -> DataFrame:
    cells, _, p = _frozen(spark, d)
    return resolve.settled_cells(cells, p).select("tier", "target", "cell", six("p"), six("mu"), "y")


SUMMARY = ["target", "n", "brier", "deviance", "realised_total", "in_interval", "unforecast_total"]


@query(f"WITH {FROZEN} SELECT tier, {', '.join(SUMMARY)} FROM resolved")
def settle_summary(spark: SparkSession, d: str) -> DataFrame:
    r = resolve.resolutions(*_frozen(spark, d)).withColumns({"brier": six("brier"), "deviance": six("deviance"), "target": calendar.parse_month(F.col("target_month"))})
    return r.select("tier", *SUMMARY)


def _matrix(resolved: DataFrame) -> DataFrame:
    """tier, target, and the lines of the reliability matrix; its bins follow from the mean."""
    lines = resolved.select("tier", calendar.parse_month(F.col("target_month")).alias("target"), F.explode("reliability").alias("x"))
    return lines.select("tier", "target", F.col("x")[0].alias("mean_p"), F.col("x")[1].alias("frequency"), F.col("x")[2].cast("long").alias("n"))


@query(f"WITH {FROZEN} SELECT tier, target, mean_p, frequency, n FROM ({MATRIX}) m")
def settle_reliability(spark: SparkSession, d: str) -> DataFrame:
    return _matrix(resolve.resolutions(*_frozen(spark, d)))


@query(f"WITH {FROZEN} SELECT tier, target_month, entity AS cell, rating, expected FROM frozen CROSS JOIN dated")
def forecast_files(spark: SparkSession, d: str) -> DataFrame:
    """Forecast documents written as JSON and read back."""
    cells, totals, _ = _frozen(spark, d)
    path = new_folder(spark, "forecasts")
    documents.write_forecasts(cells, totals, path)
    return documents.forecast_cells(documents.read_forecasts(spark, path)).select("tier", "target_month", "cell", "rating", "expected")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    cells, totals, _ = _frozen(spark, d)
    path = new_folder(spark, "forecasts")
    documents.write_forecasts(cells, totals, path, forecast.head(1.5, 50, 7, "/in/panel.csv", "2030-01-02T03:04:05Z"))
    return documents.read_forecasts(spark, path)


@query(f"""WITH {FROZEN}, c AS (SELECT count(*) AS cells FROM rates)
SELECT target_month, '2030-01-02T03:04:05Z' AS made_at, 'poisson-factor' AS model, 1.5::DOUBLE AS cell_km, 50::BIGINT AS n, 7::BIGINT AS seed, through // 12 || '-' || lpad(CAST(through % 12 + 1 AS VARCHAR), 2, '0') AS train_through,
       'panel.csv' AS train_source, 'settle against the first panel that covers ' || target_month AS settle_note, cells AS n_accidents, cells AS n_ksi, expected_total FROM dated CROSS JOIN lim CROSS JOIN c JOIN wholes ON tier = 'ksi'""")
def forecast_headers(spark: SparkSession, d: str) -> DataFrame:
    """What forecast documents say of themselves, and how many cells their tiers have."""
    of = ["target_month", "made_at", "model", "cell_km", "n", "seed", "train_through", "train_source", "settle_note"]
    return _documents(spark, d).select(*of, *[F.size(f"{t}.cells").cast("long").alias(f"n_{t}") for t in TIERS], F.col("ksi.expected_total"))


@query(f"WITH {FROZEN} SELECT tier, target_month, CAST(row_number() OVER (PARTITION BY tier, target_month ORDER BY entity) - 1 AS INT) AS place, entity AS cell FROM frozen CROSS JOIN dated")
def document_order(spark: SparkSession, d: str) -> DataFrame:
    """The place of each cell in its document, whose cells are in order of their names."""
    docs = _documents(spark, d)
    parts = [docs.select(F.lit(t).alias("tier"), "target_month", F.posexplode(f"{t}.cells").alias("place", "c")).select("tier", "target_month", "place", "c.cell") for t in TIERS]
    return parts[0].unionByName(parts[1])


@query(f"WITH {panel_sql('unit').replace('FROM inc WHERE', ', CASE WHEN k % 3 = 0 THEN substr(district, 3) ELSE district END AS unit FROM inc WHERE')} SELECT * FROM panel")
def panel_empty_units(spark: SparkSession, d: str) -> DataFrame:
    """The panel by a unit that many records lack: those aren't counted."""
    return panels.build(accepted(spark, d), F.when(F.col("k") % 3 == 0, F.substring("district", 3, 9)).otherwise(F.col("district")))


@query(f"WITH {FROZEN} SELECT tier, target_month, n, realised_total, in_interval, unforecast_total FROM resolved")
def resolution_files(spark: SparkSession, d: str) -> DataFrame:
    """Resolution documents written as JSON and read back."""
    path = new_folder(spark, "resolutions")
    documents.write(resolve.resolutions(*_frozen(spark, d)), path)
    fields = "tier string, target_month string, n bigint, realised_total bigint, in_interval boolean, unforecast_total bigint"
    return spark.read.text(path).select(F.from_json("value", fields).alias("d")).select("d.*")


@query(f"WITH {panel_sql()} SELECT k // 12 || '-' || lpad(CAST(k % 12 + 1 AS VARCHAR), 2, '0') AS month, k, entity, CAST(accidents AS DOUBLE) AS accidents, CAST(ksi AS DOUBLE) AS ksi, printf('%.2f', tenths / 10.0) AS weighted_days FROM panel")
def panel_files(spark: SparkSession, d: str) -> DataFrame:
    """The panel written as CSV and read back, its weights as text."""
    path = new_folder(spark, "panel")
    panel_source.write(panel_dense(spark, d), path, csv=True)
    weights = spark.read.option("header", True).csv(path).select("month", F.col("cell").alias("entity"), "weighted_days")
    return panel_source.read(spark, path).withColumn("month", calendar.month_text(F.col("k"))).join(weights, ["entity", "month"])


def forward_sql(config: ModelConfig, tier: str) -> str:
    u = "row_number() OVER (PARTITION BY target, entity ORDER BY n) - 1"
    return f"""(WITH {model_sql(config, tier, forward=True)},
{ensemble_sql(config)},
ordered AS (SELECT target, entity, n, {u} AS i, count(*) OVER (PARTITION BY target, entity) AS draws FROM cell_counts),
p95s AS (SELECT target, entity, max(n) FILTER (i = floor(0.95 * (draws - 1))) AS p95 FROM ordered GROUP BY ALL),
ordered_sums AS (SELECT target, total, row_number() OVER (PARTITION BY target ORDER BY total) - 1 AS i, count(*) OVER (PARTITION BY target) AS draws FROM totals),
quantiles AS (
  SELECT target, CAST(max(total) FILTER (i = floor(0.05 * (draws - 1))) AS DOUBLE) AS total_p5, CAST(max(total) FILTER (i = floor(0.5 * (draws - 1))) AS DOUBLE) AS total_p50,
         CAST(max(total) FILTER (i = floor(0.95 * (draws - 1))) AS DOUBLE) AS total_p95
  FROM ordered_sums GROUP BY target),
expected_totals AS (SELECT target, trunc(sum(expected) * 10 + 0.5) / 10 AS expected_total FROM pred GROUP BY target)"""


def month_sql(k: str) -> str:
    return f"{k} // 12 || '-' || lpad(CAST({k} % 12 + 1 AS VARCHAR), 2, '0')"


def _forward(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = staged(panel_dense(spark, d), "panel")
    last = p.agg(F.max("k")).first()[0]
    return forecast.rows(p, *forecast.limits(p, calendar.month_text_py(last - 1)))


CELLS_SQL = " UNION ALL ".join(f"SELECT * FROM {forward_sql(c, t)} SELECT '{t}' AS tier, {month_sql('target')} AS target_month, entity AS cell, trunc(rating * 10000 + 0.5) / 10000 AS rating, trunc(expected * 10000 + 0.5) / 10000 AS expected, p95 FROM pred JOIN p95s USING (target, entity))" for t, c in TIERS.items())


@query(CELLS_SQL)
def forecast_cells(spark: SparkSession, d: str) -> DataFrame:
    """The published cells: rating, expected count and 95 % count."""
    return _forward(spark, d)[0].drop("train_through")


@query(" UNION ALL ".join(f"SELECT * FROM {forward_sql(c, t)} SELECT '{t}' AS tier, {month_sql('target')} AS target_month, '{c.name}' AS model, expected_total, total_p5, total_p50, total_p95 FROM expected_totals JOIN quantiles USING (target))" for t, c in TIERS.items()))
def forecast_totals(spark: SparkSession, d: str) -> DataFrame:
    """The published totals, which the cells' draws add up to member by member."""
    return _forward(spark, d)[1].drop("train_through")


@query(f"WITH {model_sql(IID)} SELECT target, member, total FROM totals")
def coherent_totals(spark: SparkSession, d: str) -> DataFrame:
    """The cells' draws added up member by member; the SQL draws the totals and no cells."""
    return model.summed_totals(model.ensembles(fitted(spark, d, IID), IID))


def _ensembles_sql(config: ModelConfig) -> str:
    return f"WITH {model_sql(config)}, {ensemble_sql(config)}, ordered AS (SELECT target, entity, n, row_number() OVER (PARTITION BY target, entity ORDER BY n) - 1 AS i, count(*) OVER (PARTITION BY target, entity) AS draws FROM cell_counts) SELECT target, entity, max(n) FILTER (i = floor(0.95 * (draws - 1))) AS p95, round(sum(n) / {config.draws}.0, 6) AS mean FROM ordered GROUP BY target, entity"


def _ensembles(spark: SparkSession, d: str, config: ModelConfig) -> DataFrame:
    e = model.ensembles(fitted(spark, d, config), config)
    return e.select("target", "entity", model.order_statistic("counts", 0.95).alias("p95"), six(F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c) / config.draws, "mean"))


KEYED = ModelConfig(n=20)


@query(_ensembles_sql(KEYED))
def cell_ensembles_keyed(spark: SparkSession, d: str) -> DataFrame:
    """cell_ensembles with 20 draws."""
    return _ensembles(spark, d, KEYED)


@query(_ensembles_sql(IID))
def cell_ensembles(spark: SparkSession, d: str) -> DataFrame:
    """Drawn counts of each cell: p95 and mean."""
    return _ensembles(spark, d, IID)


SWEPT = {"1 km": 1000.0, "district": 0.0}
SWEEP_N = ModelConfig(n=100)


def _sweep_sql(units: dict[str, float], config: ModelConfig) -> str:
    parts = []
    for name, side in units.items():
        unit = f"(CAST(floor(e / {side:g}) AS BIGINT) || '_' || CAST(floor(n / {side:g}) AS BIGINT))" if side else "district"
        for tier in ("accidents", "ksi"):
            sql = model_sql(config, tier, unit=unit, where="serious" if tier == "ksi" else "true")
            pick = lambda f, c: f"avg({c}) FILTER (forecaster = '{f}')"
            md, nd, ml, nl = pick("poisson-factor", "deviance"), pick("naive", "deviance"), pick("poisson-factor", "log_loss"), pick("naive", "log_loss")
            parts.append(f"""SELECT * FROM (WITH {sql} SELECT '{tier}' AS tier, '{name}' AS unit, (SELECT count(DISTINCT entity) FROM p) AS n_units, round({md}, 6) AS model_deviance, round({nd}, 6) AS naive_deviance,
round(100 * ({nd} - {md}) / {nd}, 6) AS deviance_skill, round(100 * ({nl} - {ml}) / {nl}, 6) AS log_loss_skill,
(SELECT round(sum(n * abs(mean_p - frequency)) / sum(n), 6) FROM curve WHERE forecaster = 'poisson-factor') AS calibration_error FROM each)""")
    return " UNION ALL ".join(parts)


def _sweep(spark: SparkSession, d: str, units: dict[str, float], config: ModelConfig) -> DataFrame:
    s = sweep.skill(accepted(spark, d), units, config, MIN_HISTORY)
    return s.select("tier", "unit", "n_units", *[six(c) for c in ("model_deviance", "naive_deviance", "deviance_skill", "log_loss_skill", "calibration_error")])


@query(_sweep_sql(SWEPT, SWEEP_N))
def resolution_sweep_skill(spark: SparkSession, d: str) -> DataFrame:
    return _sweep(spark, d, SWEPT, SWEEP_N)


@query(_sweep_sql(sweep.UNITS, IID))
def resolution_sweep(spark: SparkSession, d: str) -> DataFrame:
    """The whole comparison: all units of sweep.UNITS with the draws of the published model."""
    return _sweep(spark, d, sweep.UNITS, IID)


@query(f"SELECT *, '{{through}}' AS train_through FROM ({CELLS_SQL}) x".replace("'{through}'", f"(SELECT {month_sql('(max(k) - 1)')} FROM (WITH {incident_sql()} SELECT CAST(max(k) AS INT) AS k FROM acc) y)"))
def forecast_documents(spark: SparkSession, d: str) -> DataFrame:
    """The cells of forecast documents, with the month that they were trained through."""
    return _forward(spark, d)[0]


@query(f"WITH {incident_sql()} SELECT cell AS entity, k, count(*) AS accidents, count(*) FILTER (serious) AS ksi, CAST(sum(tenths) AS BIGINT) AS tenths FROM acc GROUP BY ALL")
def streamed_counts(spark: SparkSession, d: str) -> DataFrame:
    """The counts of a stream over the records in ten files, a batch each, against those of the tables."""
    source, path = new_folder(spark, "records"), new_folder(spark, "streamed")
    incidents.from_orders(spark, d).repartition(10).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(source)
    streaming.keep_counts(incidents.typed(stream).where(incidents.reason().isNull()), panels.by_cell(), path, new_folder(spark, "streamed-state")).awaitTermination()
    return streaming.latest(spark, path)


SPOILT = """SELECT CASE WHEN o_orderkey % 11 = 0 THEN strftime(o_orderdate, '%Y-13') ELSE strftime(o_orderdate, '%Y-%m') END AS month, o_orderkey % 50 AS cell,
  CASE WHEN o_orderkey % 5 = 0 THEN ' ' || o_orderkey || 'd' ELSE '' || o_orderkey END AS accidents, CASE WHEN o_orderkey % 7 = 0 THEN 'NaN' ELSE '1' END AS ksi, o_orderkey FROM orders"""


@query(f"""WITH spoilt AS ({SPOILT}), judged AS (
  SELECT *, CASE WHEN o_orderkey % 11 = 0 THEN 'month' WHEN o_orderkey % 5 = 0 THEN 'accidents' WHEN o_orderkey % 7 = 0 THEN 'ksi' END AS reason FROM spoilt)
SELECT CAST(cell AS VARCHAR) AS entity, coalesce(reason, 'none') AS reason, count(*) AS n, min(accidents) AS least_text FROM judged GROUP BY ALL""")
def rejected_panel_rows(spark: SparkSession, d: str) -> DataFrame:
    """A panel file of which some months and values don't parse: rows by cell and by the reason that they were rejected for."""
    key, path = F.col("o_orderkey"), new_folder(spark, "spoilt")
    spark.read.parquet(f"{d}/orders.parquet").select(
        F.when(key % 11 == 0, F.date_format("o_orderdate", "yyyy-'13'")).otherwise(F.date_format("o_orderdate", "yyyy-MM")).alias("month"),
        (key % 50).alias("cell"),
        F.when(key % 5 == 0, F.concat(F.lit(" "), key.cast("string"), F.lit("d"))).otherwise(key.cast("string")).alias("accidents"),
        F.when(key % 7 == 0, "NaN").otherwise("1").alias("ksi"),
    ).write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    rows = panel_source.parsed(spark, path)
    return rows.groupBy("entity", F.coalesce("reason", F.lit("none")).alias("reason")).agg(F.count("*").alias("n"), F.min("raw.accidents").alias("least_text"))


@query(f"""WITH {incident_sql()}, spoilt AS (SELECT *, row_number() OVER () AS r FROM inc),
judged AS (SELECT *, CASE WHEN sev = '4' THEN 'coordinates' WHEN NOT (e BETWEEN 500000 AND 565000 AND n BETWEEN 155000 AND 205000) THEN 'outside' WHEN sev = '5' THEN 'date' END AS reason FROM spoilt)
SELECT district, reason, count(*) AS n FROM judged WHERE reason IS NOT NULL GROUP BY ALL""")
def rejected_incidents(spark: SparkSession, d: str) -> DataFrame:
    """Records of which some have no number for a coordinate and some no date: those rejected, by district and reason."""
    sev = F.col(incidents.SEVERITY)
    spoilt = incidents.from_orders(spark, d).withColumns({
        incidents.EASTING: F.when(sev == "4", F.concat(F.col(incidents.EASTING), F.lit("m"))).otherwise(F.col(incidents.EASTING)),
        incidents.DATE: F.when(sev == "5", F.regexp_replace(incidents.DATE, "/", "-")).otherwise(F.col(incidents.DATE)),
    })
    return incidents.rejected(incidents.typed(spoilt)).groupBy("district", "reason").agg(F.count("*").alias("n"))


@query(f"WITH {incident_sql()}, by_month AS (SELECT cell, k, max(district) AS district FROM acc GROUP BY ALL) SELECT cell AS entity, arg_max(district, k) AS \"group\" FROM by_month GROUP BY cell")
def panel_groups(spark: SparkSession, d: str) -> DataFrame:
    """The district of each cell's last month with one, as a panel file keeps it beside the counts."""
    path, a = new_folder(spark, "grouped"), accepted(spark, d)
    of = a.groupBy(panels.by_cell().alias("entity"), "k").agg(F.max("district").alias("group"))
    panel_source.write(panel_dense(spark, d), path, csv=True, groups=of)
    return panel_source.groups(spark, path)


@query("SELECT CAST(user_id AS VARCHAR) AS entity, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INT) AS k, count(*) AS n FROM events GROUP BY ALL")
def daily_event_counts(spark: SparkSession, d: str) -> DataFrame:
    """The counting operator over another unit and calendar: users and days."""
    e = spark.read.parquet(f"{d}/events.parquet").select(F.lit("").alias("district"), F.datediff(F.to_date("ts"), F.lit("1970-01-01")).alias("k"), F.lit(False).alias("ksi"), F.lit(0).alias("tenths"), F.col("user_id").cast("string").alias("unit"))
    return panels.counts(e, F.col("unit")).select("entity", "k", F.col("accidents").alias("n"))


@query("""SELECT l_orderkey AS key, round(((('0x' || substr(md5('7|' || l_orderkey || '|' || l_linenumber || '|u'), 1, 13))::BIGINT + 0.5) / 4503599627370496.0), 9) AS u FROM lineitem""")
def keyed_uniforms(spark: SparkSession, d: str) -> DataFrame:
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return li.select(F.col("l_orderkey").alias("key"), F.round(chance.uniform(F.lit(7), F.col("l_orderkey"), F.col("l_linenumber"), F.lit("u")), 9).alias("u"))
