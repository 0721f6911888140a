"""The hierarchical Poisson model, stage by stage, for all targets of a table at once.

A panel has entity, k and y. A targets table has target, its ordinal, and cutoff, the first month of the window (null: all). What
is by month or by target is small and broadcast; what is by entity is shuffled by entity or stays where it is.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ModelConfig
from ..functions import calendar, chance, geo
from ..sources.work import staged
from . import panel as panels, quantiles, splitting


def study(df: DataFrame) -> list[str]:
    """The column of the study, where a table holds several: all stages then go by study as they go by target."""
    return ["study"] if "study" in df.columns else []


def by_target(df: DataFrame) -> list[str]:
    return [*study(df), "target"]


def months(panel: DataFrame) -> DataFrame:
    """k, moy, ord, total and n_rows of each month present. One row a month, so the ordering is a small one."""
    of = study(panel)
    m = panel.groupBy(*of, "k").agg(F.sum("y").alias("total"), F.count("*").alias("n_rows"))
    w = Window.partitionBy(*of).orderBy("k") if of else Window.orderBy("k")
    return m.select(*of, "k", calendar.month_of(F.col("k")).alias("moy"), F.row_number().over(w).alias("ord"), "total", "n_rows")


def backtest_targets(axis: DataFrame, min_history: int, hist_k: int = 0) -> DataFrame:
    """Every month present with at least min_history months present before it."""
    t = axis.where(F.col("ord") > min_history).select(*study(axis), F.col("k").alias("target"), F.col("ord").alias("target_ord"))
    return _with_cutoff(t, axis, hist_k)


def forward_targets(axis: DataFrame, first: int, last: int, through: int, hist_k: int = 0, studies: tuple[str, ...] = ()) -> DataFrame:
    """The months first to last, forecast from what is known through a month: all have the same window. studies: those of the axis, if it has any."""
    known = axis.where(F.col("k") <= through)
    n = F.coalesce(F.max("ord"), F.lit(0)).alias("n")
    if studies:
        named = axis.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, studies))).alias("study"))
        known_n = named.join(F.broadcast(known.groupBy("study").agg(n)), "study", "left").fillna(0, ["n"])
    else:
        known_n = known.agg(n)
    t = known_n.select(*study(known_n), F.explode(F.sequence(F.lit(first), F.lit(last))).alias("target"), (F.col("n") + 1).alias("target_ord"))
    return _with_cutoff(t, known, hist_k).withColumn("through", F.lit(through))


def _with_cutoff(targets: DataFrame, axis: DataFrame, hist_k: int) -> DataFrame:
    if hist_k <= 0:
        return targets.withColumn("cutoff", F.lit(None).cast("int"))
    start = axis.select(*study(axis), F.col("k").alias("cutoff"), (F.col("ord") + hist_k).alias("target_ord"))
    return targets.join(F.broadcast(start), [*study(axis), "target_ord"], "left")


def known_months(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """target, and the rows (of months) in its window."""
    limit = (F.col("k") < F.col("target")) & (F.col("cutoff").isNull() | (F.col("k") >= F.col("cutoff")))
    if "through" in targets.columns:
        limit = limit & (F.col("k") <= F.col("through"))
    if not study(targets):
        return rows.join(F.broadcast(targets), limit)
    return rows.join(F.broadcast(targets.withColumnRenamed("study", "of")), limit & (F.col("study") == F.col("of"))).drop("of")


def season(axis: DataFrame, targets: DataFrame) -> DataFrame:
    """target, moy (1 to 12), s and overall. s is 1 for a month of the year without rows or where nothing happened at all."""
    w, by = known_months(axis, targets), by_target(targets)
    overall = w.groupBy(*by).agg(F.coalesce(F.try_divide(F.sum("total").cast("double"), F.sum("n_rows")), F.lit(0.0)).alias("overall"))
    own = w.groupBy(*by, "moy").agg((F.sum("total").cast("double") / F.sum("n_rows")).alias("rate"))
    grid = targets.select(*by).join(overall, by, "left").select(*by, F.coalesce("overall", F.lit(0.0)).alias("overall"), F.explode(F.sequence(F.lit(1), F.lit(12))).alias("moy"))
    return grid.join(own, [*by, "moy"], "left").select(*by, "moy", F.coalesce(F.try_divide("rate", "overall"), F.lit(1.0)).alias("s"), "overall")


YEAR = range(1, 13)


def _weighed(counted: DataFrame, seasons: DataFrame) -> DataFrame:
    """target, entity, cnt and e: the numbers n1 to n12 of rows by month of the year, times the target's seasons."""
    by = by_target(seasons)
    year = seasons.groupBy(*by).agg(*[F.max(F.when(F.col("moy") == m, F.col("s"))).alias(f"s{m}") for m in YEAR])
    e = sum((F.col(f"n{m}") * F.col(f"s{m}") for m in YEAR), F.lit(0.0))
    return counted.join(F.broadcast(year), by).select(*by, "entity", "cnt", e.alias("e"))


def _of_targets(entities: DataFrame, targets: DataFrame, *columns: str) -> DataFrame:
    """Each entity with each target of its study."""
    few = F.broadcast(targets.select(*by_target(targets), *columns))
    return entities.join(few, study(targets)) if study(targets) else entities.crossJoin(few)


def running_history(panel: DataFrame, targets: DataFrame) -> DataFrame:
    """target, entity, cnt and n1 to n12: the sum and the numbers of rows, by month of the year, in each target's window.

    Each entity's rows and one mark for each target (and one for each cutoff, which is taken off) are put in order of months, and one pass
    keeps running sums, which the marks read. What is shuffled grows with panel + entities x targets, whatever the windows hold.
    """
    of = study(targets)
    marks = _of_targets(panel.select(*of, "entity").distinct(), targets, "cutoff").select(
        *of, "entity", "target", F.explode(F.array(F.struct(F.col("target").alias("k"), F.lit(1).alias("sign")), F.struct(F.col("cutoff").alias("k"), F.lit(-1).alias("sign")))).alias("at")
    ).select(*of, "entity", "target", "at.k", "at.sign").where("k is not null")
    rows = panel.select(*of, "entity", "k", F.col("y").alias("cnt"), *[(calendar.month_of(F.col("k")) == m).cast("long").alias(f"n{m}") for m in YEAR])
    line = rows.unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy(*of, "entity").orderBy("k", F.col("target").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = ["cnt", *[f"n{m}" for m in YEAR]]
    read = line.select(*of, "entity", "target", "sign", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(c) for c in sums]).where("target is not null")
    return read.groupBy(*of, "target", "entity").agg(*[F.sum(F.col("sign") * F.col(c)).alias(c) for c in sums])


def exposure(panel: DataFrame, axis: DataFrame, targets: DataFrame, seasons: DataFrame, dense: bool) -> DataFrame:
    """target, entity, cnt and e (the seasons summed over the entity's rows), for every entity of the panel.

    Forward targets share one window, so it is summed once. Dense panels: counts before each month are running sums, and e is the
    same for all entities, so it comes from the month table. Other panels: running_history.
    """
    of = study(targets)
    if "through" in targets.columns:
        limits = F.broadcast(targets.select(*of, "through", "cutoff").distinct())
        inside = (F.col("k") <= F.col("through")) & (F.col("cutoff").isNull() | (F.col("k") >= F.col("cutoff")))
        own = (panel.join(limits, of) if of else panel.crossJoin(limits)).groupBy(*of, "entity").agg(
            F.coalesce(F.sum(F.when(inside, F.col("y"))), F.lit(0)).alias("cnt"), *[F.count_if(inside & (calendar.month_of(F.col("k")) == m)).alias(f"n{m}") for m in YEAR]
        )
        return _weighed(_of_targets(own, targets), seasons)
    if not dense:
        return _weighed(running_history(panel, targets), seasons)
    by = by_target(targets)
    e = known_months(axis, targets).join(F.broadcast(seasons.drop("overall")), [*by, "moy"]).groupBy(*by).agg(F.sum("s").alias("e"))
    run = panel.select(*of, "entity", F.col("k").alias("target"), F.coalesce(F.sum("y").over(Window.partitionBy(*of, "entity").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("upto"))
    own = run.join(F.broadcast(targets.select(*by, "cutoff")), by)
    cut = targets.where("cutoff is not null").select(*of, F.col("cutoff").alias("target"), F.col("target").alias("of")).distinct()
    cut = run.join(F.broadcast(cut), by).select(*of, F.col("of").alias("target"), "entity", F.col("upto").alias("before"))
    own = own.join(cut, [*by, "entity"], "left").select(*by, "entity", (F.col("upto") - F.coalesce("before", F.lit(0))).alias("cnt"))
    return own.join(F.broadcast(e), by, "left").fillna(0.0, ["e"])


def prior(exposed: DataFrame, seasons: DataFrame, radius: int) -> DataFrame:
    """exposed with prior: the overall rate, or with a radius the neighbours' counts over their exposures.

    Sums over the square around a cell are sums along one axis of sums along the other: each cell sends its numbers to the 2r + 1 rows around it,
    and a range window goes along the row; what stands in the middle is taken off. Entities that aren't cells, and cells
    whose neighbours have no exposure, take the overall rate.
    """
    by = by_target(exposed)
    overall = F.broadcast(seasons.select(*by, "overall").distinct())
    if radius <= 0:
        return exposed.join(overall, by).withColumn("prior", F.col("overall")).drop("overall")
    placed = exposed.withColumn("ij", geo.cell_ij(F.col("entity"))).select(*by, "entity", "cnt", "e", F.col("ij.i").alias("i"), F.col("ij.j").alias("j"))
    sent = placed.where("i is not null").select(*by, "cnt", "e", "i", "j", F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("d"))
    own = F.col("d") == 0
    column = sent.groupBy(*by, "i", (F.col("j") + F.col("d")).alias("j")).agg(
        F.sum("cnt").alias("cnt"), F.sum("e").alias("e"), F.sum(F.when(own, F.col("cnt"))).alias("own_cnt"), F.sum(F.when(own, F.col("e"))).alias("own_e")
    )
    row = Window.partitionBy(*by, "j").orderBy("i").rangeBetween(-radius, radius)
    around = column.select(*by, "i", "j", (F.sum("cnt").over(row) - F.col("own_cnt")).alias("near_cnt"), (F.sum("e").over(row) - F.col("own_e")).alias("near_e")).where("near_cnt is not null")
    near = F.when(F.col("near_e") > 1e-9, F.col("near_cnt") / F.col("near_e"))  # what is left of sums of seasons when nothing is left is rounding
    return placed.join(around, [*by, "i", "j"], "left").join(overall, by).select(*by, "entity", "cnt", "e", F.coalesce(near, F.col("overall")).alias("prior"))


def base(with_prior: DataFrame, config: ModelConfig) -> DataFrame:
    a = config.weight
    return with_prior.withColumn("base", (F.col("cnt") + a * F.col("prior")) / (F.col("e") + a))


def factor_series(panel: DataFrame, axis: DataFrame, targets: DataFrame, seasons: DataFrame, based: DataFrame, dense: bool) -> DataFrame:
    """target, k, obs, expected and f = log((obs + 1/2) / (expected + 1/2)) of the window's months; f is null without expectation.

    Panels that aren't dense: an entity's rows meet its bases of all targets, and are added up by target and month before anything is shuffled.
    """
    s, by = F.broadcast(seasons.drop("overall")), by_target(targets)
    known = known_months(axis, targets)
    if dense:
        whole = based.groupBy(*by).agg(F.sum("base").alias("sum_base"))
        m = known.join(F.broadcast(whole), by).join(s, [*by, "moy"]).select(*by, "k", F.col("total").alias("obs"), (F.col("sum_base") * F.col("s")).alias("expected"))
    else:
        present = panel.select(*study(panel), "entity", "k").join(based.select(*by, "entity", "base"), [*study(panel), "entity"]).groupBy(*by, "k").agg(F.sum("base").alias("sum_base"))
        m = known.join(present, [*by, "k"]).join(s, [*by, "moy"]).select(*by, "k", F.col("total").alias("obs"), (F.col("sum_base") * F.col("s")).alias("expected"))
    return m.withColumn("f", F.when(F.col("expected") > 0, F.log((F.col("obs") + 0.5) / (F.col("expected") + 0.5))))


def factor_parameters(series: DataFrame, targets: DataFrame, config: ModelConfig) -> DataFrame:
    """target, n, mu, sigma, phi, h, f_mean and f_sd. Lags go by position among the months with a factor, h by the calendar."""
    by = by_target(targets)
    stats = series.groupBy(*by).agg(
        F.max("k").alias("last_k"),
        F.count("f").alias("n"),
        F.coalesce(F.avg("f"), F.lit(0.0)).alias("mu"),
        F.coalesce(F.var_pop("f"), F.lit(0.0)).alias("var"),
        F.max_by("f", F.when(F.col("f").isNotNull(), F.col("k"))).alias("f_last"),
    )
    lagged = series.where("f is not null").withColumn("before", F.lag("f").over(Window.partitionBy(*by).orderBy("k"))).join(F.broadcast(stats.select(*by, "mu")), by)
    slope = lagged.groupBy(*by).agg(F.try_divide(F.sum((F.col("f") - F.col("mu")) * (F.col("before") - F.col("mu"))), F.sum(F.pow(F.col("before") - F.col("mu"), F.lit(2.0)))).alias("slope"))
    p = targets.select(*by).join(stats, by, "left").join(slope, by, "left").fillna(0, ["n"]).fillna(0.0, ["mu", "var"])
    phi = F.least(F.greatest(F.coalesce("slope", F.lit(0.0)), F.lit(0.0)), F.lit(0.95))
    p = p.select(*by, "n", "mu", F.sqrt("var").alias("sigma"), phi.alias("phi"), F.greatest(F.lit(1), F.col("target") - F.coalesce("last_k", F.col("target"))).alias("h"), "f_last")
    if not config.ar:
        return p.withColumn("f_mean", F.lit(0.0)).withColumn("f_sd", F.col("sigma"))
    enough = F.col("n") >= 3
    mean = F.when(enough, F.col("mu") + F.pow("phi", "h") * (F.col("f_last") - F.col("mu"))).otherwise(0.0)
    return p.withColumn("f_mean", mean).withColumn("f_sd", F.when(enough, F.col("sigma") * F.sqrt(1 - F.pow(F.col("phi"), 2 * F.col("h")))).otherwise(F.col("sigma")))


def draws(parameters: DataFrame, config: ModelConfig) -> DataFrame:
    """target, member, f: the factors that all cells of a target share."""
    key = lambda stream: (F.lit(config.seed), F.col("target"), F.col("member"), F.lit(stream))
    by = by_target(parameters)
    d = parameters.select(*by, "f_mean", "f_sd", F.explode(F.sequence(F.lit(1), F.lit(config.draws))).alias("member"))
    return d.select(*by, "member", (F.col("f_mean") + F.col("f_sd") * chance.normal(chance.uniform(*key("u")), chance.uniform(*key("v")))).alias("f"))


def factors(drawn: DataFrame) -> DataFrame:
    """target, xs, the array of exp(f) by member, and their mean."""
    by_member = F.array_sort(F.collect_list(F.struct("member", F.exp("f").alias("x"))))
    return drawn.groupBy(*by_target(drawn)).agg(F.transform(by_member, lambda s: s["x"]).alias("xs"), F.avg(F.exp("f")).alias("mean_x"))


class Fitted(dict):
    """The stages of a fit by name: panel, axis, targets, seasons, based, series, parameters, drawn.

    Each is built when it is first asked for. What several later stages read is written then; the others are plans.
    """

    def __init__(self, panel: DataFrame, targets: Callable[[DataFrame], DataFrame], config: ModelConfig, dense: bool | None = None, through: int | None = None, studies: dict[str, ModelConfig] | None = None):
        """targets: from the month table to the targets. dense: None looks whether the panel is. through: months after it aren't known.
        studies: where studies differ in radius and shrink, their own configurations."""
        super().__init__()
        self._studies = studies or {}
        self._panel, self._targets, self._config, self._dense, self._through = panel, targets, config, dense, through

    def __missing__(self, name: str) -> DataFrame:
        self[name] = getattr(self, f"_build_{name}")()
        return self[name]

    @property
    def dense(self) -> bool:
        if self._dense is None:
            self._dense = panels.is_dense(self["panel"])
        return self._dense

    def _build_panel(self) -> DataFrame:
        return staged(self._panel, "panel")

    def _build_axis(self) -> DataFrame:
        known = self["panel"] if self._through is None else self["panel"].where(F.col("k") <= self._through)
        return staged(months(known), "axis")

    def _build_targets(self) -> DataFrame:
        return self._targets(self["axis"])

    def _build_seasons(self) -> DataFrame:
        return staged(season(self["axis"], self["targets"]), "seasons")

    def _build_based(self) -> DataFrame:
        exposed = exposure(self["panel"], self["axis"], self["targets"], self["seasons"], self.dense)
        if not self._studies:
            return staged(base(prior(exposed, self["seasons"], self._config.radius), self._config), "based")
        exposed = staged(exposed, "exposed")
        own = [base(prior(exposed.where(F.col("study") == name), self["seasons"].where(F.col("study") == name), c.radius), c) for name, c in self._studies.items()]
        return staged(reduce(DataFrame.unionByName, own), "based")

    def _build_series(self) -> DataFrame:
        return factor_series(self["panel"], self["axis"], self["targets"], self["seasons"], self["based"], self.dense)

    def _build_parameters(self) -> DataFrame:
        return staged(factor_parameters(self["series"], self["targets"], self._config), "parameters")

    def _build_drawn(self) -> DataFrame:
        return draws(self["parameters"], self._config)


def intensity(fitted: dict[str, DataFrame]) -> DataFrame:
    """target, entity, mu = base x season of the target's month."""
    by = by_target(fitted["based"])
    s = fitted["seasons"].where(F.col("moy") == calendar.month_of(F.col("target"))).select(*by, "s")
    return fitted["based"].join(F.broadcast(s), by).select(*by, "entity", (F.col("base") * F.col("s")).alias("mu"))


def predict(fitted: dict[str, DataFrame], config: ModelConfig) -> DataFrame:
    """target, entity, mu, rating (chance of no incident) and expected, from the shared factors, without any cell's draws."""
    n, by = float(config.draws), by_target(fitted["based"])
    p = intensity(fitted).join(F.broadcast(factors(fitted["drawn"])), by)
    rating = F.aggregate("xs", F.lit(0.0), lambda a, x: a + F.exp(-F.col("mu") * x)) / n
    return p.select(*by, "entity", "mu", rating.alias("rating"), (F.col("mu") * F.col("mean_x")).alias("expected"))


def ensembles(fitted: dict[str, DataFrame], config: ModelConfig) -> DataFrame:
    """target, entity and counts by member, which add up to totals() member by member: each total split between the entities."""
    by = by_target(fitted["based"])
    whole = totals(fitted, config).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("member", "total"))), lambda s: s["total"]).alias("counts"))
    entities = fitted["based"].groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    return splitting.split(intensity(fitted), whole, config.seed, entities)


def order_statistic(values: str, q: float):
    """The value at place floor(q (n - 1)), counted from 0, of an array; 0 if it is empty."""
    return F.coalesce(F.get(F.array_sort(values), F.floor(q * (F.size(values) - 1)).cast("int")), F.lit(0))


def p95(fitted: dict[str, DataFrame], config: ModelConfig) -> DataFrame:
    """target, entity, p95 of the drawn counts."""
    return ensembles(fitted, config).select(*by_target(fitted["based"]), "entity", order_statistic("counts", 0.95).alias("p95"))


def p95_analytic(fitted: dict[str, DataFrame], config: ModelConfig) -> DataFrame:
    """target, entity, p95: the least c at which the mean over members of the Poisson distribution function reaches 0.95.

    A few rows may hold all of the work, so they are dealt over as many tasks as a shuffle has.
    """
    mu = intensity(fitted)
    dealt = mu.repartition(int(mu.sparkSession.conf.get("spark.sql.shuffle.partitions")), "target", "entity")
    return quantiles.poisson(dealt.join(F.broadcast(factors(fitted["drawn"])), "target"), 0.95, "p95")


def totals(fitted: dict[str, DataFrame], config: ModelConfig) -> DataFrame:
    """target, member, total: given the factor the sum of cells is Poisson too, so one draw a member will do."""
    by = by_target(fitted["based"])
    rate = intensity(fitted).groupBy(*by).agg(F.sum("mu").alias("mu"))
    d = fitted["drawn"].join(F.broadcast(rate), by)
    key = lambda stream: (F.lit(config.seed), F.col("target"), F.col("member"), F.lit(stream))
    return d.select(*by, "member", chance.poisson(F.col("mu") * F.exp("f"), chance.uniform(*key("tc")), chance.normal(chance.uniform(*key("tu")), chance.uniform(*key("tv")))).alias("total"))


def summed_totals(drawn_counts: DataFrame) -> DataFrame:
    """target, member, total: cells' draws added up member by member, to hold against totals()."""
    by = by_target(drawn_counts)
    return drawn_counts.select(*by, F.posexplode("counts").alias("m", "c")).groupBy(*by, (F.col("m") + 1).alias("member")).agg(F.sum("c").alias("total"))


def total_quantiles(drawn_totals: DataFrame) -> DataFrame:
    """target, total_p5, total_p50, total_p95."""
    by = by_target(drawn_totals)
    return drawn_totals.groupBy(*by).agg(F.collect_list("total").alias("t")).select(*by, *[order_statistic("t", q).alias(f"total_p{int(100 * q)}") for q in (0.05, 0.5, 0.95)])
