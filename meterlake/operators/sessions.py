"""Workout sessions, strength sets, streams, tracks and the diary, put together from points."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fields of the metadata that may hold a session's title, in the order of preference.
TITLE_FIELDS = ("workout_name", "activity_name", "workout_title", "summary", "food_name", "meal_category")
MEAL_ORDER = ("breakfast", "lunch", "dinner", "snack")
EARTH_METERS = 6_371_008.8


def first_title(fields: list[Column]) -> Column:
    """The first that isn't empty, else an empty text."""
    return F.coalesce(*[F.nullif(F.trim(f), F.lit("")) for f in fields], F.lit(""))


def session_id(source_type: Column, source_id: Column, identity: Column, label: Column) -> Column:
    """The source's type and half a digest of what tells its sessions apart."""
    return F.concat(source_type, F.lit(":"), F.substring(F.sha2(F.concat_ws("|", source_id, identity, label), 256), 1, 16))


def session_key(tagged: Column, at: Column, title: Column, category: Column) -> Column:
    """Points of one session share its id, or, without one, their time, title and category."""
    return F.when(F.coalesce(tagged, F.lit("")) != "", F.concat(F.lit("s|"), tagged)).otherwise(F.concat_ws("|", F.lit("t"), at.cast("string"), category, title))


def encode_key(text: Column) -> Column:
    """Base64 for URLs, without padding."""
    return F.rtrim(F.translate(F.base64(text.cast("binary")), "+/", "-_"), F.lit("="))


def decode_key(key: Column) -> Column:
    standard = F.translate(key, "-_", "+/")
    return F.unbase64(F.concat(standard, F.substring(F.lit("==="), F.lit(1), F.pmod(4 - F.length(key) % 4, F.lit(4)).cast("int")))).cast("string")


def session_list(sets: DataFrame) -> DataFrame:
    """Each session with its time, sets, exercises, muscle groups and volume.

    Sets are summed by exercise and muscle group first, a plain sum that needs no objects; what is left of a
    session is a few rows."""
    parts = sets.groupBy("tenant_id", "session_id", "exercise_title", "muscle_group").agg(F.min("at").alias("_at"), F.count("*").alias("_n"), F.sum(F.col("weight_kg") * F.col("reps")).alias("_volume"))
    return parts.groupBy("tenant_id", "session_id").agg(
        F.min("_at").alias("start"),
        F.sum("_n").alias("sets"),
        F.size(F.collect_set("exercise_title")).cast("long").alias("exercises"),  # a session is small
        F.array_join(F.sort_array(F.collect_set("muscle_group")), ",").alias("muscle_groups"),
        F.sum("_volume").alias("volume"),
    )


def pivot_sets(measures: DataFrame) -> DataFrame:
    """Sets from up to three measures each: rows of a set's key with a metric_type and a value."""
    of = lambda m: F.max(F.when(F.col("metric_type") == m, F.col("value")))
    keys = ("tenant_id", "session_id", "exercise_title", "set_number")
    return measures.groupBy(*keys).agg(of("strength_set_weight").alias("weight_kg"), of("strength_set_reps").alias("reps"), of("strength_set_volume").alias("volume_kg"), F.count("*").alias("points")).withColumn("has_weight", F.col("weight_kg").isNotNull())


def one_rep_max(weight: Column, reps: Column) -> Column:
    """Epley's estimate for one to ten repetitions; one is the weight itself."""
    return F.when(reps == 1, weight).when(reps.between(2, 10), weight * (1 + reps / 30))


def progression(sets: DataFrame) -> DataFrame:
    """The best set of each exercise and day, and how its estimate trends over the training days."""
    best = sets.withColumn("e1rm", one_rep_max(F.col("weight_kg"), F.col("reps"))).groupBy("tenant_id", "exercise_title", "at").agg(F.max("e1rm").alias("e1rm"), F.max("weight_kg").alias("weight_kg"), F.sum(F.col("weight_kg") * F.col("reps")).alias("volume"))
    i = F.row_number().over(Window.partitionBy("tenant_id", "exercise_title").orderBy("at")) - 1
    return best.where("e1rm IS NOT NULL").withColumn("i", i.cast("double")).groupBy("tenant_id", "exercise_title").agg(F.count("*").alias("days"), F.max("e1rm").alias("best"), F.max_by("e1rm", "at").alias("latest"), F.regr_slope("e1rm", "i").alias("slope"))


def muscle_share(sets: DataFrame) -> DataFrame:
    """What part of a tenant's volume and sets each muscle group has."""
    totals = sets.groupBy("tenant_id", "muscle_group").agg(F.sum(F.col("weight_kg") * F.col("reps")).alias("volume"), F.count("*").alias("sets"))
    whole = Window.partitionBy("tenant_id")
    return totals.withColumn("volume_share", F.col("volume") / F.sum("volume").over(whole)).withColumn("set_share", F.col("sets") / F.sum("sets").over(whole))


def within_windows(sessions: DataFrame, points: DataFrame, pad_seconds: int = 0) -> DataFrame:
    """Points of any source from each session's start to before its end. They meet by day, then by time."""
    pad = F.make_dt_interval(secs=F.lit(pad_seconds))
    padded = sessions.withColumn("_from", F.col("start") - pad).withColumn("_to", F.col("end") + pad)
    days = F.sequence(F.to_date("_from"), F.to_date("_to"))
    by_day = padded.withColumn("_day", F.explode(days))
    met = points.withColumn("_day", F.to_date("timestamp")).join(by_day, ["tenant_id", "_day"])
    return met.where((F.col("timestamp") >= F.col("_from")) & (F.col("timestamp") < F.col("_to"))).drop("_day", "_from", "_to")


#: Windows are answered in cells of so many microseconds, and cells go to Python together until they have so many rows.
CELL, TOGETHER = 7200 * 1_000_000, 1 << 18


def _ordered(values: np.ndarray) -> np.ndarray:
    """Doubles as longs of the same order, NaN above all. On the bits of these longs it gives the doubles' bits."""
    bits = values.view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def _range_least(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of keys[lo:hi] for each pair, none of which is empty, by tables of spans of powers of two, one at a time."""
    level, out = np.frexp((hi - lo).astype(np.float64))[1] - 1, np.empty(len(lo), np.int64)
    for k in range(int(level.max()) + 1):
        own = level == k
        out[own] = np.minimum(keys[lo[own]], keys[hi[own] - (1 << k)])
        keys = np.minimum(keys[: -(1 << k)], keys[1 << k :])
    return out


def _answers(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Count, least and greatest value of each metric in each window, of rows that hold whole cells one after the other."""
    rows = rows.combine_chunks()
    numbers = lambda c: rows[c].fill_null(0).to_numpy()
    codes = lambda c: pc.dictionary_encode(rows[c], null_encoding="encode").combine_chunks()
    tenant, cell, at, to = codes("tenant_id").indices.to_numpy(), numbers("_cell"), numbers("_at"), numbers("_to")
    # What meets in a cell begins less than two cells after its begin: four cells between them hold these apart.
    begins = np.concatenate([[False], (tenant[1:] != tenant[:-1]) | (cell[1:] != cell[:-1])])
    shift = (np.cumsum(begins) * 4 - cell) * CELL
    asks = np.flatnonzero(rows["_to"].is_valid().to_numpy())
    lows, highs, place = (at + shift)[asks], (to + shift)[asks], at + shift
    names = codes("metric_type")
    kinds, known = names.indices.to_numpy(), rows["value"].is_valid().to_numpy()
    values = numbers("value") + 0.0  # of two zeros one
    values[np.isnan(values)] = np.nan
    ordered = _ordered(values)
    points = np.ones(rows.num_rows, bool)
    points[asks] = False
    for k, name in enumerate(names.dictionary):
        own = np.flatnonzero(points & (kinds == k))
        own = own[np.argsort(place[own], kind="stable")]
        lo, hi = np.searchsorted(place[own], lows), np.searchsorted(place[own], highs)
        some = np.flatnonzero(hi > lo)
        if not len(some):
            continue
        lo, hi, there = lo[some], hi[some], known[own]
        least = _range_least(np.where(there, ordered[own], np.iinfo(np.int64).max), lo, hi)
        most = -1 - _range_least(-1 - np.where(there, ordered[own], np.iinfo(np.int64).min), lo, hi)
        unknown = least == np.iinfo(np.int64).max
        ends = [pa.array(_ordered(np.where(unknown, 0, x).view(np.float64)).view(np.float64), mask=unknown) for x in (least, most)]
        sessions = rows.select(["tenant_id", "session"]).take(pa.array(asks[some]))
        told = [*sessions.columns, pa.repeat(name, len(some)), pa.array((hi - lo).astype(np.int64)), *ends]
        yield from pa.table(told, ["tenant_id", "session", "metric_type", "n", "least", "most"]).combine_chunks().to_batches(10_000)


def _by_cells(together: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers from rows in the order of tenant and cell, many cells at once; the one that is open stays for later."""
    key = lambda b, i: (b["tenant_id"][i], b["_cell"][i])
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < together or key(held[0], 0) == key(batch, -1):
            continue
        rows = pa.Table.from_batches(held)
        tenant, cell = key(rows, -1)
        open_ = pc.and_(pc.equal(rows["tenant_id"], tenant), pc.equal(rows["_cell"], cell))
        closed = rows.num_rows - pc.sum(open_).as_py()
        yield from _answers(rows.slice(0, closed))
        held = rows.slice(closed).to_batches()
        count = rows.num_rows - closed
    if held:
        yield from _answers(pa.Table.from_batches(held))


def measured_within(sessions: DataFrame, points: DataFrame, pad_seconds: int = 0) -> DataFrame:
    """What ``within_windows`` finds, by session and metric: how many points (n), their least and their greatest value.

    No pair of a window and a point is made: these grow with the square of a dense table. A window longer than a cell
    is cut; each piece goes to the cell in which it begins, each point to its own cell and the one before. In a cell a
    piece is a range of a metric's points in the order of time, and its ends come from spans of powers of two. What is
    held at once is a cell, that is what a tenant has in four hours. Equal sessions of a tenant are one."""
    pad = F.make_dt_interval(secs=F.lit(pad_seconds))
    micros = lambda at: F.unix_micros(at.cast("timestamp"))
    cell = lambda at: F.expr(f"({at} - pmod({at}, {CELL})) div {CELL}")
    spans = sessions.select("tenant_id", "session", micros(F.col("start") - pad).alias("_from"), micros(F.col("end") + pad).alias("_end")).where("_from < _end")
    cut = spans.withColumn("_at", F.explode(F.sequence("_from", F.col("_end") - 1, F.lit(CELL))))
    pieces = cut.select("tenant_id", cell("_at").alias("_cell"), "_at", F.least(F.col("_at") + CELL, "_end").alias("_to"), "session", F.lit(None).cast("string").alias("metric_type"), F.lit(None).cast("double").alias("value"))
    timed = points.select("tenant_id", micros(F.col("timestamp")).alias("_at"), "metric_type", F.col("value").cast("double").alias("value")).where("_at IS NOT NULL")
    session = sessions.schema["session"].dataType
    twice = timed.withColumn("_own", cell("_at")).select("tenant_id", F.explode(F.array(F.col("_own"), F.col("_own") - 1)).alias("_cell"), "_at", F.lit(None).cast("long").alias("_to"), F.lit(None).cast(session).alias("session"), "metric_type", "value")
    rows = pieces.unionByName(twice).where("tenant_id IS NOT NULL").repartition("tenant_id", "_cell").sortWithinPartitions("tenant_id", "_cell")
    told = rows.mapInArrow(partial(_by_cells, TOGETHER), f"tenant_id {sessions.schema['tenant_id'].dataType.simpleString()}, session {session.simpleString()}, metric_type string, n long, least double, most double")
    return told.groupBy("tenant_id", "session", "metric_type").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))


def decimate(points: DataFrame, seconds: int, *keys: str, least: int = 3, most: int = 8) -> DataFrame:
    """Means and envelopes of buckets, for the ``most`` densest metrics of each key that have enough points.

    Points are aggregated once; what is densest is told from the buckets."""
    at = F.floor(F.unix_seconds(F.col("timestamp").cast("timestamp")) / seconds) * seconds
    buckets = points.groupBy("metric_type", *keys, at.alias("bucket_epoch")).agg(F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.count("*").alias("n"))
    counts = buckets.groupBy("metric_type", *keys).agg(F.sum("n").alias("_points")).where(F.col("_points") >= least)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_points").desc(), "metric_type"))
    densest = counts.withColumn("_rank", rank).where(F.col("_rank") <= most).select("metric_type", *keys)
    return buckets.join(densest, ["metric_type", *keys], "left_semi")


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Meters along a great circle."""
    a = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_METERS * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


#: Half axis in meters and flattening of the WGS84 ellipsoid.
AXIS, FLATTENING = 6_378_137.0, 1 / 298.257223563


def _vincenty(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray, rounds: int) -> np.ndarray:
    """Meters between places in degrees; NaN where the difference of longitudes doesn't settle."""
    shrink = 1 - FLATTENING
    u1, u2 = (np.arctan(shrink * np.tan(np.radians(lat))) for lat in (lat1, lat2))
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    apart = np.radians(np.mod(lon2 - lon1 + 180, 360.0) - 180)
    meters, open_, lam = np.full(len(lat1), np.nan), np.arange(len(lat1)), apart.copy()
    for _ in range(rounds):
        sin_lam, cos_lam = np.sin(lam), np.cos(lam)
        ss = np.sqrt((c2 * sin_lam) ** 2 + (c1 * s2 - s1 * c2 * cos_lam) ** 2)
        cs = s1 * s2 + c1 * c2 * cos_lam
        sigma = np.arctan2(ss, cs)
        sin_alpha = np.where(ss == 0, 0.0, c1 * c2 * sin_lam / np.where(ss == 0, 1.0, ss))
        cos2 = 1 - sin_alpha**2
        middle = np.where(cos2 < 1e-15, 0.0, cs - 2 * s1 * s2 / np.where(cos2 < 1e-15, 1.0, cos2))
        c = FLATTENING / 16 * cos2 * (4 + FLATTENING * (4 - 3 * cos2))
        new = apart + (1 - c) * FLATTENING * sin_alpha * (sigma + c * ss * (middle + c * cs * (2 * middle**2 - 1)))
        done = np.abs(new - lam) < 1e-12
        good = done & (np.abs(new) <= np.pi)
        q = (cos2 * (AXIS**2 - (AXIS * shrink) ** 2) / (AXIS * shrink) ** 2)[good]
        big_a = 1 + q / 16384 * (4096 + q * (q * (320 - 175 * q) - 768))
        big_b = q / 1024 * (256 + q * (q * (74 - 47 * q) - 128))
        ss, cs, middle = ss[good], cs[good], middle[good]
        turn = big_b * ss * (middle + big_b / 4 * (cs * (2 * middle**2 - 1) - big_b / 6 * middle * (4 * ss**2 - 3) * (4 * middle**2 - 3)))
        meters[open_[good]] = AXIS * shrink * big_a * (sigma[good] - turn)
        left = ~done
        if not left.any():
            break
        open_, lam, apart, s1, c1, s2, c2 = (x[left] for x in (open_, new, apart, s1, c1, s2, c2))
    return meters


def ellipsoid_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column, rounds: int = 16) -> Column:
    """Meters along a geodesic of WGS84, by Vincenty's inverse formula.

    The difference of longitudes on the auxiliary sphere is made better in up to ``rounds`` steps, on arrays of rows,
    which leave these where it stays the same. Near antipodes it doesn't settle: there the great circle stands in, off by half a per cent at most."""

    @F.arrow_udf("double")
    def settled(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        places = [x.to_numpy(zero_copy_only=False).astype(np.float64) for x in (a, b, c, d)]
        with np.errstate(invalid="ignore"):
            meters = _vincenty(*places, rounds)
        return pa.array(meters, mask=np.isnan(meters))

    there = lat1.isNotNull() & lon1.isNotNull() & lat2.isNotNull() & lon2.isNotNull()
    degrees = [c.cast("double") for c in (lat1, lon1, lat2, lon2)]
    return F.when(there, F.coalesce(settled(*degrees), haversine(*degrees)))


def track_length(fixes: DataFrame, *keys: str, distance: Callable[[Column, Column, Column, Column], Column] = haversine) -> DataFrame:
    """The length of each track (columns timestamp, point_id, latitude, longitude), on a sphere or, by
    ``ellipsoid_distance``, on the ellipsoid.

    Tracks are measured by day, so that a long one isn't sorted as a whole, and the steps between the last fix of a day
    and the first of the next one that has any are added."""
    day = Window.partitionBy(*keys, "_day").orderBy("timestamp", "point_id")
    dated = fixes.withColumn("_day", F.to_date("timestamp"))
    placed = dated.withColumns({"_lat": F.lag("latitude").over(day), "_lon": F.lag("longitude").over(day), "_begins": F.lag(F.lit(True)).over(day).isNull(), "_ends": F.lead(F.lit(True)).over(day).isNull()})
    step = distance(F.col("_lat"), F.col("_lon"), F.col("latitude"), F.col("longitude"))
    ends = [F.max(F.when(F.col(at), F.col(c))).alias(f"{at}_{c}") for at in ("_begins", "_ends") for c in ("latitude", "longitude")]
    days = placed.withColumn("_step", F.when(~F.col("_begins"), step)).groupBy(*keys, "_day").agg(F.count("*").alias("_fixes"), F.sum("_step").alias("_steps"), *ends)
    order = Window.partitionBy(*keys).orderBy("_day")
    met = days.withColumns({"_lat": F.lag("_ends_latitude").over(order), "_lon": F.lag("_ends_longitude").over(order)})
    bridge = distance(F.col("_lat"), F.col("_lon"), F.col("_begins_latitude"), F.col("_begins_longitude"))
    whole = met.withColumn("_bridge", bridge).groupBy(*keys)
    return whole.agg(F.sum("_fixes").alias("fixes"), F.coalesce(F.sum(F.coalesce("_steps", F.lit(0.0)) + F.coalesce("_bridge", F.lit(0.0))), F.lit(0.0)).alias("meters"))


def simplify_track(fixes: DataFrame, most: int, *keys: str) -> DataFrame:
    """The ends of each track and its fixes of the largest triangle with their neighbours."""
    order = Window.partitionBy(*keys).orderBy("timestamp", "point_id")
    lag = lambda c: F.lag(c).over(order)
    lead = lambda c: F.lead(c).over(order)
    area = F.abs((F.col("longitude") - lag("longitude")) * (lead("latitude") - lag("latitude")) - (lead("longitude") - lag("longitude")) * (F.col("latitude") - lag("latitude"))) / 2
    weighed = fixes.withColumn("_area", F.coalesce(F.round(area, 9), F.lit(float("inf"))))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_area").desc(), "timestamp", "point_id"))
    return weighed.withColumn("_n", rank).where(F.col("_n") <= most).drop("_n", "_area")


def meals(entries: DataFrame) -> DataFrame:
    """Energy of each meal: the last that the provider states, else the sum of its items. Unknown meals come last."""
    stated = F.max_by("stated", F.when(F.col("stated").isNotNull(), F.col("timestamp")))
    told = entries.groupBy("tenant_id", "day", "meal").agg(stated.alias("stated"), F.round(F.sum("item_energy"), 1).alias("derived"), F.count("item_energy").alias("items"))
    place = F.array_position(F.array(*[F.lit(m) for m in MEAL_ORDER]), F.lower("meal"))
    return told.withColumn("energy", F.coalesce("stated", "derived")).withColumn("place", F.when(place > 0, place).otherwise(F.lit(99)))
