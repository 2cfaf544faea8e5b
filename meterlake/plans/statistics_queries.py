"""Queries over intervals and daily series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.significance import p_value, with_q_values
from ..operators import intervals as I
from ..operators import rollups as R
from ..operators import statistics as S
from ..operators.points import json_text
from .driver_tables import COLLAPSE_SQL, POINTS_SQL, points, table
from .register import query, rounded, text, text_sql

DAILY = f"daily AS (SELECT tenant_id, metric_type, CAST(date_trunc('day', timestamp) AS DATE) AS day, {COLLAPSE_SQL} AS value FROM points GROUP BY tenant_id, metric_type, date_trunc('day', timestamp))"
PAIRS = "pairs AS (SELECT a.tenant_id, a.metric_type AS metric_a, b.metric_type AS metric_b, a.value AS x, b.value AS y FROM daily a JOIN daily b ON a.tenant_id = b.tenant_id AND a.day = b.day AND a.metric_type < b.metric_type)"
RANKS = "ranked AS (SELECT *, rank() OVER (PARTITION BY tenant_id, metric_a, metric_b ORDER BY x) + (count(*) OVER (PARTITION BY tenant_id, metric_a, metric_b, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY tenant_id, metric_a, metric_b ORDER BY y) + (count(*) OVER (PARTITION BY tenant_id, metric_a, metric_b, y) - 1) / 2.0 AS ry FROM pairs)"
KEY = ("tenant_id", "metric_type")


def _sql(select: str, *more: str) -> str:
    return ",\n".join([f"WITH {POINTS_SQL}", *more]) + "\n" + select


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = R.rollup(points(spark, sf_dir), "day", *KEY)
    return days.select(*KEY, F.to_date("bucket_start").alias("day"), "value")


@query(_sql(f"SELECT *, strftime(day, '%Y-%m-%d') AS d, round(value, 9) AS v FROM daily", DAILY).replace("SELECT *, strftime(day, '%Y-%m-%d') AS d, round(value, 9) AS v", "SELECT tenant_id, metric_type, strftime(day, '%Y-%m-%d') AS day, round(value, 9) AS value"))
def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(spark, sf_dir).select(*KEY, F.date_format("day", "yyyy-MM-dd").alias("day"), rounded("value").alias("value"))


@query(_sql("SELECT tenant_id, metric_a, metric_b, count(*) AS n, round(corr(x, y), 7) AS pearson FROM pairs GROUP BY ALL HAVING count(*) >= 10", DAILY, PAIRS))
def series_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.correlations(daily(spark, sf_dir), "tenant_id").select("tenant_id", "metric_a", "metric_b", "n", rounded("pearson", 7).alias("pearson"))


@query(_sql("SELECT tenant_id, metric_a, metric_b, round(corr(rx, ry), 7) AS spearman FROM ranked GROUP BY ALL HAVING count(*) >= 10", DAILY, PAIRS, RANKS))
def series_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.correlations(daily(spark, sf_dir), "tenant_id").select("tenant_id", "metric_a", "metric_b", rounded("spearman", 7).alias("spearman"))


@query(_sql("SELECT tenant_id, metric_a, metric_b, CASE WHEN s < 0.2 THEN 'negligible' WHEN s < 0.4 THEN 'weak' WHEN s < 0.6 THEN 'moderate' WHEN s < 0.8 THEN 'strong' ELSE 'very strong' END AS strength FROM (SELECT tenant_id, metric_a, metric_b, least(abs(corr(x, y)), abs(corr(rx, ry))) AS s FROM ranked GROUP BY ALL HAVING count(*) >= 10)", DAILY, PAIRS, RANKS))
def correlation_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.correlations(daily(spark, sf_dir), "tenant_id").select("tenant_id", "metric_a", "metric_b", "strength")


@query()
def correlation_pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.tested_correlations(daily(spark, sf_dir), "tenant_id")


@query("WITH t AS (SELECT l_returnflag AS k, l_linenumber AS i, avg(l_discount) AS p FROM lineitem GROUP BY ALL), r AS (SELECT *, p * count(*) OVER (PARTITION BY k) / rank() OVER (PARTITION BY k ORDER BY p) AS raw FROM t) SELECT k, i, round(least(1.0, min(raw) OVER (PARTITION BY k ORDER BY p DESC)), 7) AS q_value FROM r")
def bh_qvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean discounts stand for p-values."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    tests = lines.groupBy(F.col("l_returnflag").alias("k"), F.col("l_linenumber").alias("i")).agg(F.avg("l_discount").alias("p"))
    return with_q_values(tests, "p", "k").select("k", "i", rounded("q_value", 7).alias("q_value"))


_LAGGED = """lagged AS (SELECT g.k, a.tenant_id, a.metric_type AS metric_a, b.metric_type AS metric_b, a.value AS x, b.value AS y FROM range(1, 8) g(k) CROSS JOIN daily a JOIN daily b ON a.tenant_id = b.tenant_id AND b.day = a.day + CAST(g.k AS INTEGER) AND a.metric_type < b.metric_type),
lr AS (SELECT *, rank() OVER (PARTITION BY k, tenant_id, metric_a, metric_b ORDER BY x) + (count(*) OVER (PARTITION BY k, tenant_id, metric_a, metric_b, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY k, tenant_id, metric_a, metric_b ORDER BY y) + (count(*) OVER (PARTITION BY k, tenant_id, metric_a, metric_b, y) - 1) / 2.0 AS ry FROM lagged),
lc AS (SELECT k, tenant_id, metric_a, metric_b, corr(rx, ry) AS rho FROM lr GROUP BY ALL HAVING count(*) >= 10)"""


@query(_sql("SELECT tenant_id, metric_a, metric_b, k AS lag_days, round(rho, 7) AS spearman FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, metric_a, metric_b ORDER BY round(abs(rho), 9) DESC, k) AS n FROM lc) WHERE n = 1 AND abs(rho) >= 0.3", DAILY, _LAGGED))
def lagged_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.best_lag(daily(spark, sf_dir), "tenant_id").select("tenant_id", "metric_a", "metric_b", F.col("lag_days").cast("long").alias("lag_days"), rounded("spearman", 7).alias("spearman"))


@query(_sql("SELECT tenant_id, metric_type, count(*) AS n, round(regr_slope(value, i), 7) AS slope, round(regr_intercept(value, i), 7) AS intercept, round(regr_r2(value, i), 7) AS r2, CASE WHEN abs(regr_slope(value, i)) < 0.1 * stddev_pop(value) OR regr_r2(value, i) < 0.1 THEN 'flat' WHEN regr_slope(value, i) > 0 THEN 'rising' ELSE 'falling' END AS direction, round(regr_slope(value, i) * count(*) / abs(avg(value)) * 100, 6) AS change_percent FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, metric_type ORDER BY day) - 1 AS i FROM daily) GROUP BY ALL", DAILY))
def trend_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.trend(daily(spark, sf_dir), *KEY).select(*KEY, "n", *[rounded(c, 7).alias(c) for c in ("slope", "intercept", "r2")], "direction", rounded("change_percent", 6).alias("change_percent"))


@query(_sql("SELECT tenant_id, metric_type, strftime(day, '%Y-%m-%d') AS day, CASE WHEN row_number() OVER w >= 7 THEN round(avg(value) OVER (PARTITION BY tenant_id, metric_type ORDER BY day ROWS 6 PRECEDING), 7) END AS moving_average FROM daily WINDOW w AS (PARTITION BY tenant_id, metric_type ORDER BY day)", DAILY))
def moving_average_7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.moving_average(daily(spark, sf_dir), 7, *KEY).select(*KEY, F.date_format("day", "yyyy-MM-dd").alias("day"), rounded("moving_average", 7).alias("moving_average"))


@query(_sql("SELECT tenant_id, metric_type, isodow(day) - 1 AS weekday, count(*) AS n, round(avg(value), 7) AS mean, isodow(day) >= 6 AS weekend FROM daily GROUP BY tenant_id, metric_type, isodow(day)", DAILY))
def weekday_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.weekday_pattern(daily(spark, sf_dir), *KEY).select(*KEY, F.col("weekday").cast("long").alias("weekday"), "n", rounded("mean", 7).alias("mean"), "weekend")


@query(_sql("SELECT tenant_id, metric_type, strftime(day, '%Y-%m-%d') AS day, round(z, 7) AS z, anomalies FROM (SELECT *, count(*) OVER (PARTITION BY tenant_id, metric_type) AS anomalies, row_number() OVER (PARTITION BY tenant_id, metric_type ORDER BY day DESC) AS r FROM (SELECT d.*, (value - m) / s AS z FROM daily d JOIN (SELECT tenant_id, metric_type, m, CASE WHEN median(abs(value - m)) > 0 THEN 1.4826 * median(abs(value - m)) ELSE stddev_pop(value) END AS s FROM daily JOIN (SELECT tenant_id, metric_type, median(value) AS m FROM daily GROUP BY ALL HAVING count(*) >= 10) USING (tenant_id, metric_type) GROUP BY ALL) USING (tenant_id, metric_type) WHERE s > 0) WHERE abs(z) >= 2.5) WHERE r <= 20", DAILY))
def anomalies_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.anomalies(daily(spark, sf_dir), *KEY).select(*KEY, F.date_format("day", "yyyy-MM-dd").alias("day"), rounded("z", 7).alias("z"), "anomalies")


_PERIODS = """cmp AS (SELECT tenant_id, metric_type, count(value) FILTER (day BETWEEN DATE '2024-01-01' AND DATE '2024-01-15') AS n_a, count(value) FILTER (day BETWEEN DATE '2024-01-15' AND DATE '2024-01-30') AS n_b,
avg(value) FILTER (day BETWEEN DATE '2024-01-01' AND DATE '2024-01-15') AS mean_a, avg(value) FILTER (day BETWEEN DATE '2024-01-15' AND DATE '2024-01-30') AS mean_b,
var_pop(value) FILTER (day BETWEEN DATE '2024-01-01' AND DATE '2024-01-15') AS var_a, var_pop(value) FILTER (day BETWEEN DATE '2024-01-15' AND DATE '2024-01-30') AS var_b FROM daily GROUP BY ALL)"""


@query(_sql("SELECT tenant_id, metric_type, n_a, n_b, round(mean_b - mean_a, 7) AS difference, round((mean_b - mean_a) / sqrt(var_a / n_a + var_b / n_b), 7) AS t, CAST(floor(pow(var_a / n_a + var_b / n_b, 2) / (pow(var_a / n_a, 2) / (n_a - 1) + pow(var_b / n_b, 2) / (n_b - 1))) AS BIGINT) AS df FROM cmp WHERE n_a > 1 AND n_b > 1 AND var_a + var_b > 0", DAILY, _PERIODS))
def period_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both periods hold the day between them."""
    told = S.compare_periods(daily(spark, sf_dir), ("2024-01-01", "2024-01-15"), ("2024-01-15", "2024-01-30"), *KEY)
    return told.select(*KEY, "n_a", "n_b", rounded("difference", 7).alias("difference"), rounded("t", 7).alias("t"), "df")


@query()
def period_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = S.compare_periods(daily(spark, sf_dir), ("2024-01-01", "2024-01-15"), ("2024-01-15", "2024-01-30"), *KEY)
    return told.select(*KEY, "t", "df", p_value(F.col("t"), F.col("df")).alias("p_value"))


@query(_sql("SELECT tenant_id, metric_type, count(DISTINCT day) AS days, round(count(DISTINCT day) / 30.0, 9) AS coverage, CASE WHEN metric_type IN ('steps', 'heart_rate_max') THEN 'daily' WHEN metric_type = 'body_weight' THEN 'event' ELSE 'continuous' END AS cadence, count(DISTINCT day) >= 10 AND (metric_type NOT IN ('steps', 'heart_rate_max') OR count(DISTINCT day) / 30.0 >= 0.5) AS sufficient FROM daily GROUP BY tenant_id, metric_type", DAILY))
def series_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.quality(daily(spark, sf_dir), 30, *KEY).withColumn("coverage", rounded("coverage"))


_DELTAS = "deltas AS (SELECT *, (epoch_us(timestamp) - epoch_us(previous)) / 1e6 AS seconds FROM (SELECT tenant_id, metric_type, timestamp, lag(timestamp) OVER (PARTITION BY tenant_id, metric_type ORDER BY timestamp) AS previous FROM (SELECT DISTINCT tenant_id, metric_type, timestamp FROM points)))"
_USUAL = "usual AS (SELECT tenant_id, metric_type, median(seconds) AS s, count(*) AS n FROM deltas WHERE seconds > 0 GROUP BY ALL)"


@query(_sql("SELECT tenant_id, metric_type, round(s, 6) AS interval_seconds, n AS intervals FROM usual", _DELTAS, _USUAL))
def expected_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.expected_interval(points(spark, sf_dir), *KEY).withColumn("interval_seconds", rounded("interval_seconds", 6))


_WINDOW = ("2024-01-02 06:00:00", "2024-01-29 18:00:00")
_SPANS = f"""inside AS (SELECT DISTINCT tenant_id, source_id, metric_type, timestamp AS b FROM points WHERE metric_type IN ('heart_rate', 'workout_heart_rate') AND timestamp BETWEEN '{_WINDOW[0]}' AND '{_WINDOW[1]}'),
steps_ AS (SELECT *, lag(b) OVER (PARTITION BY tenant_id, source_id, metric_type ORDER BY b) AS a FROM inside),
often AS (SELECT tenant_id, source_id, metric_type, median((epoch_us(b) - epoch_us(a)) / 1e6) AS s FROM steps_ WHERE a IS NOT NULL GROUP BY ALL),
spans AS (SELECT tenant_id, source_id, metric_type, a, b FROM steps_ WHERE a IS NOT NULL UNION ALL SELECT tenant_id, source_id, metric_type, TIMESTAMP '{_WINDOW[0]}', min(b) FROM inside GROUP BY ALL UNION ALL SELECT tenant_id, source_id, metric_type, max(b), TIMESTAMP '{_WINDOW[1]}' FROM inside GROUP BY ALL)"""


@query(_sql(f"SELECT tenant_id, source_id, metric_type, {text_sql('a')} AS gap_start, {text_sql('b')} AS gap_end FROM spans JOIN often USING (tenant_id, source_id, metric_type) WHERE (epoch_us(b) - epoch_us(a)) / 1e6 > 2.5 * s", _SPANS))
def cadence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interruptions of what is measured continuously, the ends of the window included."""
    keys = ("tenant_id", "source_id", "metric_type")
    own = I.of_cadence(points(spark, sf_dir), "continuous")
    return I.cadence_gaps(own, *_WINDOW, *keys).select(*keys, text("start").alias("gap_start"), text("end").alias("gap_end"))


@query(_sql("SELECT u AS user_bucket, metric_type, strftime(day, '%Y-%m-%d') AS day FROM (SELECT u, metric_type, CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT DISTINCT u, metric_type FROM seen)) g WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.u = g.u AND s.metric_type = g.metric_type AND s.day = g.day)", "seen AS (SELECT DISTINCT CAST(json_extract_string(metadata, '$.k') AS BIGINT) AS u, metric_type, CAST(timestamp + INTERVAL 120 MINUTE AS DATE) AS day FROM points WHERE metric_type IN ('steps', 'heart_rate_max'))"))
def daily_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = I.of_cadence(points(spark, sf_dir), "daily").withColumn("user_bucket", json_text("k").cast("long"))
    found = I.daily_gaps(own, "2024-01-01", "2024-01-30", "user_bucket", "metric_type", offset_minutes=120)
    return found.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(_sql("SELECT tenant_id, CAST(floor(epoch(timestamp) / 21600) * 21600 AS BIGINT) AS bucket_epoch, count(*) AS n FROM points GROUP BY ALL"))
def coverage_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.bucket_counts(points(spark, sf_dir), 21_600, "tenant_id")


@query(_sql("SELECT tenant_id, b AS bucket_epoch, n, CASE WHEN n >= 0.9 * expected THEN 'full' ELSE 'partial' END AS state FROM c JOIN (SELECT tenant_id, median(n) AS expected FROM c GROUP BY ALL) USING (tenant_id)", "c AS (SELECT tenant_id, CAST(floor(epoch(timestamp) / 86400) * 86400 AS BIGINT) AS b, count(*) AS n FROM points GROUP BY ALL)"))
def bucket_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    buckets = I.bucket_counts(points(spark, sf_dir), 86_400, "tenant_id")
    return I.classify(buckets, 0.9, "tenant_id").select("tenant_id", "bucket_epoch", "n", "state")


def _ranges(spark: SparkSession, sf_dir: str, metric: str) -> DataFrame:
    """Each point covers as many minutes from its time on as its value says."""
    own = points(spark, sf_dir).where(F.col("metric_type") == metric)
    return own.select("tenant_id", "source_id", F.col("timestamp").alias("start"), (F.col("timestamp") + F.make_dt_interval(mins=F.floor("value").cast("int") + 1)).alias("end"))


def _islands(name: str, metric: str) -> str:
    return f"""{name} AS (SELECT tenant_id, source_id, min(s) AS s, max(e) AS e FROM (SELECT *, sum(o) OVER (PARTITION BY tenant_id, source_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM
    (SELECT *, CASE WHEN max(e) OVER (PARTITION BY tenant_id, source_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= s THEN 0 ELSE 1 END AS o FROM
    (SELECT tenant_id, source_id, timestamp AS s, timestamp + to_minutes(CAST(floor(value) AS BIGINT) + 1) AS e FROM points WHERE metric_type = '{metric}'))) GROUP BY tenant_id, source_id, i)"""


@query(_sql(f"SELECT tenant_id, source_id, {text_sql('s')} AS range_start, {text_sql('e')} AS range_end FROM m", _islands("m", "steps")))
def merge_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = I.merge_adjacent(_ranges(spark, sf_dir, "steps"), "tenant_id", "source_id")
    return merged.select("tenant_id", "source_id", text("start").alias("range_start"), text("end").alias("range_end"))


_EDGE = "edges AS (SELECT tenant_id, source_id, e AS a, lead(s) OVER (PARTITION BY tenant_id, source_id ORDER BY s) AS b FROM m UNION ALL SELECT tenant_id, source_id, TIMESTAMP '2024-01-01', min(s) FROM m GROUP BY ALL)"


@query(_sql(f"SELECT tenant_id, source_id, {text_sql('a')} AS open_start, {text_sql('least(coalesce(b, TIMESTAMP ' + chr(39) + '2024-02-01' + chr(39) + '), TIMESTAMP ' + chr(39) + '2024-02-01' + chr(39) + ')')} AS open_end FROM edges WHERE a < least(coalesce(b, TIMESTAMP '2024-02-01'), TIMESTAMP '2024-02-01')", _islands("m", "steps"), _EDGE))
def subtract_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    holes = _ranges(spark, sf_dir, "steps")
    outer = holes.select("tenant_id", "source_id").distinct().select("*", F.lit("2024-01-01").cast("timestamp_ntz").alias("start"), F.lit("2024-02-01").cast("timestamp_ntz").alias("end"))
    return I.subtract(outer, holes, "tenant_id", "source_id").select("tenant_id", "source_id", text("start").alias("open_start"), text("end").alias("open_end"))


@query(_sql(f"SELECT m.tenant_id, m.source_id, {text_sql('greatest(m.s, h.s)')} AS range_start, {text_sql('least(m.e, h.e)')} AS range_end FROM m JOIN h ON m.tenant_id = h.tenant_id AND m.source_id = h.source_id AND m.s < h.e AND h.s < m.e", _islands("m", "steps"), _islands("h", "heart_rate")))
def range_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (I.merge_adjacent(_ranges(spark, sf_dir, m), "tenant_id", "source_id") for m in ("steps", "heart_rate"))
    return I.intersect(a, b, "tenant_id", "source_id").select("tenant_id", "source_id", text("start").alias("range_start"), text("end").alias("range_end"))


@query(_sql(f"SELECT m.tenant_id, m.source_id, {text_sql('greatest(m.s, h.s)')} AS range_start, {text_sql('least(m.e, h.e)')} AS range_end FROM m JOIN h ON m.tenant_id = h.tenant_id AND m.source_id = h.source_id AND m.s < h.e AND h.s < m.e", _islands("m", "steps"), _islands("h", "heart_rate")))
def covered_by_all_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where both metrics are covered, by a sweep over the ends of all ranges."""
    both = _ranges(spark, sf_dir, "steps").withColumn("metric_type", F.lit("steps")).unionByName(_ranges(spark, sf_dir, "heart_rate").withColumn("metric_type", F.lit("heart_rate")))
    return I.covered_by_all(both, both, "metric_type", "tenant_id", "source_id").select("tenant_id", "source_id", text("start").alias("range_start"), text("end").alias("range_end"))


@query(_sql("SELECT tenant_id, metric_type, strftime(day, '%Y-%m-%d') AS day, count(*) AS sources, round(max(v) - min(v), 7) AS spread FROM (SELECT tenant_id, metric_type, source_id, CAST(date_trunc('day', timestamp) AS DATE) AS day, avg(value) AS v FROM points GROUP BY ALL) GROUP BY tenant_id, metric_type, day HAVING count(*) > 1 AND (max(v) - min(v)) / max(abs(v)) > 0.1"))
def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which sources of a metric differ by more than a tenth."""
    means = points(spark, sf_dir).groupBy("tenant_id", "metric_type", "source_id", F.to_date("timestamp").alias("day")).agg(F.avg("value").alias("v"))
    met = means.groupBy("tenant_id", "metric_type", "day").agg(F.count("*").alias("sources"), (F.max("v") - F.min("v")).alias("spread"), F.max(F.abs("v")).alias("most"))
    return met.where("sources > 1 AND spread / most > 0.1").select("tenant_id", "metric_type", F.date_format("day", "yyyy-MM-dd").alias("day"), "sources", rounded("spread", 7).alias("spread"))


@query("SELECT user_id, max(CASE WHEN e >= DATE '2024-01-29' THEN n ELSE 0 END) AS streak FROM (SELECT user_id, count(*) AS n, max(d) AS e FROM (SELECT *, d - CAST(row_number() OVER (PARTITION BY user_id ORDER BY d) AS INTEGER) AS island FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events)) GROUP BY user_id, island) GROUP BY user_id")
def contribution_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days in a row on which a user did anything, as of the last day."""
    days = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"))
    return I.current_streak(days, "2024-01-30", "user_id")


@query(_sql("SELECT tenant_id, metric_type, count(value) AS n, true AS within FROM points WHERE value IS NOT NULL GROUP BY ALL"))
def sketched_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians from the merged sketches of days; ``within``: their rank is off by 1.5 % of the values at most."""
    own = points(spark, sf_dir).where("value IS NOT NULL")
    days = S.quantile_states(own.withColumn("day", F.to_date("timestamp")), "tenant_id", "metric_type", "day")
    medians = S.merged_quantiles(days, "tenant_id", "metric_type").select("tenant_id", "metric_type", "n", S.quantile(0.5).alias("m"))
    ranks = own.join(medians, ["tenant_id", "metric_type"]).groupBy("tenant_id", "metric_type", "n").agg(F.count_if(F.col("value") < F.col("m")).alias("below"), F.count_if(F.col("value") <= F.col("m")).alias("upto"))
    half, slack = F.col("n") / 2, F.greatest(F.col("n") * 0.015, F.lit(1.0))
    return ranks.select("tenant_id", "metric_type", "n", ((F.col("below") <= half + slack) & (F.col("upto") >= half - slack)).alias("within"))
