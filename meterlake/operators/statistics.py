"""Statistics over daily series: rows of a key, a metric_type, a day and a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.registry import with_definition
from ..functions.significance import correlation_t, p_value, with_q_values


def aligned(series: DataFrame, *keys: str, lags: tuple[int, ...] = (0,)) -> DataFrame:
    """Pairs of metrics (a before b by name) on shared days; b may lag behind a, by each of ``lags`` days."""
    a = series.select(*keys, "day", F.col("metric_type").alias("metric_a"), F.col("value").alias("x"))
    lagged = series.withColumn("lag_days", F.explode(F.array(*map(F.lit, lags))))
    b = lagged.select(*keys, "lag_days", F.date_sub("day", F.col("lag_days")).alias("day"), F.col("metric_type").alias("metric_b"), F.col("value").alias("y"))
    return a.join(b, [*keys, "day"]).where("metric_a < metric_b")


def with_ranks(pairs: DataFrame, *keys: str) -> DataFrame:
    """Mid-ranks of both values among the pair's days; one sort for each side."""
    group = [*keys, "lag_days", "metric_a", "metric_b"]

    def rank(c: str) -> Column:
        order = Window.partitionBy(*group).orderBy(c)
        return F.rank().over(order) + (F.count("*").over(order.rangeBetween(Window.currentRow, Window.currentRow)) - 1) / 2

    return pairs.withColumn("rx", rank("x")).withColumn("ry", rank("y"))


def _corr(x: str, y: str) -> Column:
    """Zero where one side doesn't vary."""
    flat = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y))
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when(flat, F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(r, F.lit(0.0)))))


def correlations(series: DataFrame, *keys: str, min_days: int = 10, lags: tuple[int, ...] = (0,)) -> DataFrame:
    """Pearson and Spearman of each pair and lag with enough shared days; the weaker of the two is the headline."""
    ranked = with_ranks(aligned(series, *keys, lags=lags), *keys)
    told = ranked.groupBy(*keys, "lag_days", "metric_a", "metric_b").agg(F.count("*").alias("n"), _corr("x", "y").alias("pearson"), _corr("rx", "ry").alias("spearman")).where(F.col("n") >= min_days)
    weaker = F.when(F.abs("pearson") <= F.abs("spearman"), F.col("pearson")).otherwise(F.col("spearman"))
    return told.withColumn("headline", weaker).withColumn("strength", strength_label(F.col("headline")))


def strength_label(r: Column) -> Column:
    size = F.abs(r)
    return F.when(size < 0.2, "negligible").when(size < 0.4, "weak").when(size < 0.6, "moderate").when(size < 0.8, "strong").otherwise("very strong")


def tested_correlations(series: DataFrame, *keys: str, min_days: int = 10) -> DataFrame:
    """Correlations with p of the headline and q over all pairs of a key."""
    told = correlations(series, *keys, min_days=min_days)
    tested = told.withColumn("p_value", F.coalesce(p_value(correlation_t(F.col("headline"), F.col("n")), F.col("n") - 2), F.lit(0.0)))
    return with_q_values(tested, "p_value", *keys)


def best_lag(series: DataFrame, *keys: str, most: int = 7, min_days: int = 10, least: float = 0.3) -> DataFrame:
    """The lag of 1 to ``most`` days at which b follows a best, by the size of Spearman's rho."""
    every = correlations(series, *keys, min_days=min_days, lags=tuple(range(1, most + 1)))
    group = [*keys, "metric_a", "metric_b"]
    rest = [c for c in every.columns if c not in group]
    best = every.groupBy(*group).agg(F.max_by(F.struct(*rest), F.struct(F.round(F.abs("spearman"), 9), -F.col("lag_days"))).alias("_best"))
    return best.select(*group, "_best.*").where(F.abs("spearman") >= least)


def trend(series: DataFrame, *keys: str, min_days: int = 7) -> DataFrame:
    """Least squares over the position of each day, gaps ignored. Flat is a slope for each day below a tenth of the
    deviation, or a fit with r2 below 0.1; the change over all days is in percent of the mean."""
    numbered = series.withColumn("i", (F.row_number().over(Window.partitionBy(*keys).orderBy("day")) - 1).cast("double"))
    fit = numbered.groupBy(*keys).agg(
        F.count("*").alias("n"), F.regr_slope("value", "i").alias("slope"), F.regr_intercept("value", "i").alias("intercept"), F.regr_r2("value", "i").alias("r2"), F.stddev_pop("value").alias("deviation"), F.avg("value").alias("mean")
    )
    fit = fit.withColumn("r2", F.when(F.col("deviation") == 0, 0.0).otherwise(F.col("r2")))
    flat = (F.abs("slope") < 0.1 * F.col("deviation")) | (F.col("r2") < 0.1)
    direction = F.when(flat, "flat").when(F.col("slope") > 0, "rising").otherwise("falling")
    change = F.when(F.col("mean") == 0, 0.0).otherwise(F.col("slope") * F.col("n") / F.abs("mean") * 100)
    return fit.where(F.col("n") >= min_days).withColumn("direction", direction).withColumn("change_percent", change)


def moving_average(series: DataFrame, width: int, *keys: str) -> DataFrame:
    """Of the last ``width`` days that have a value; null until there are as many."""
    order = Window.partitionBy(*keys).orderBy("day")
    average = F.avg("value").over(order.rowsBetween(1 - width, 0))
    return series.withColumn("moving_average", F.when(F.row_number().over(order) >= width, average))


def weekday_pattern(series: DataFrame, *keys: str) -> DataFrame:
    """The mean of each day of the week, from Monday = 0, and whether it is a weekend."""
    found = series.withColumn("weekday", F.weekday("day")).groupBy(*keys, "weekday").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return found.withColumn("weekend", F.col("weekday") >= 5)


def anomalies(series: DataFrame, *keys: str, threshold: float = 2.5, min_days: int = 10, last: int | None = 20) -> DataFrame:
    """Values far from the median in units of 1.4826 median absolute deviations, or of the standard deviation where
    over half the values are equal; the newest ``last`` of each."""
    middle = series.groupBy(*keys).agg(F.median("value").alias("median"), F.count("*").alias("n")).where(F.col("n") >= min_days)
    off = series.join(middle, [*keys]).withColumn("off", F.abs(F.col("value") - F.col("median")))
    mad = F.median("off") * 1.4826
    spread = off.groupBy(*keys).agg(F.when(mad > 0, mad).otherwise(F.stddev_pop("value")).alias("spread"))
    found = off.join(spread, [*keys]).where("spread > 0").withColumn("z", (F.col("value") - F.col("median")) / F.col("spread")).where(F.abs("z") >= threshold)
    found = found.withColumn("anomalies", F.count("*").over(Window.partitionBy(*keys))).drop("off", "n")
    if last is None:
        return found
    return found.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("day").desc()))).where(F.col("_n") <= last).drop("_n")


def compare_periods(series: DataFrame, first: tuple[str, str], second: tuple[str, str], *keys: str) -> DataFrame:
    """Means of two closed periods and Welch's t with population variances; degrees of freedom are cut to whole."""
    states = []
    for name, (start, end) in (("a", first), ("b", second)):
        v = F.when(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date")), F.col("value"))
        states += [F.count(v).alias(f"n_{name}"), F.avg(v).alias(f"mean_{name}"), F.var_pop(v).alias(f"var_{name}")]
    told = series.groupBy(*keys).agg(*states).where("n_a > 1 AND n_b > 1")
    ea, eb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    freedom = F.floor((ea + eb) ** 2 / (ea**2 / (F.col("n_a") - 1) + eb**2 / (F.col("n_b") - 1)))
    told = told.where("var_a + var_b > 0").withColumn("difference", F.col("mean_b") - F.col("mean_a"))
    return told.withColumn("t", F.col("difference") / F.sqrt(ea + eb)).withColumn("df", freedom.cast("long"))


def quality(series: DataFrame, window_days: int, *keys: str, min_days: int = 10) -> DataFrame:
    """How much of a window a series covers, and whether it is enough: ``min_days`` days of any metric (a column of
    ``series`` and key), and half of all days of one that is expected daily."""
    told = series.groupBy(*keys).agg(F.count_distinct("day").alias("days")).withColumn("coverage", F.col("days") / window_days)
    known = with_definition(told, ("cadence",))
    return known.withColumn("sufficient", (F.col("days") >= min_days) & ((F.col("cadence") != "daily") | (F.col("coverage") >= 0.5)))


def quantile_states(points: DataFrame, *keys: str, accuracy: int = 400) -> DataFrame:
    """A sketch of each key's values that merges with others and holds a bounded number of values. With ``accuracy``
    400 a rank is told to within about 0.7 % of the values; of up to 400 values it holds all, and is exact."""
    return points.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy(*keys).agg(F.kll_sketch_agg_double("value", F.lit(accuracy)).alias("sketch"), F.count("*").alias("n"))


def merged_quantiles(states: DataFrame, *keys: str) -> DataFrame:
    return states.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"))


def quantile(share: float) -> Column:
    """The value of a sketch that ``share`` of the values don't exceed."""
    return F.kll_sketch_get_quantile_double("sketch", F.lit(share))
