"""The metric registry: unit, aggregation, cadence, resolution and retention of each metric."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values. Columns: metric, unit, aggregation, category, cadence, resolution, raw retention in days,
#: plausible range, precision, sources, aliases.
METRICS = """
steps | count | sum | activity | daily | minute | 90 | 0..200000 | 0 | apple_health | step_count, steps_count
distance | km | sum | activity | daily | minute | 90 | 0..500 | 2 | apple_health | distance_walking_running, walking_running_distance, distance_cycling, distance_swimming, distance_downhill_snow_sports
energy_active | kcal | sum | activity | daily | minute | 90 | 0..15000 | 0 | apple_health | active_energy, active_energy_burned
energy_resting | kcal | sum | activity | daily | minute | 90 | 0..6000 | 0 | apple_health | resting_energy, basal_energy_burned
energy_total | kcal | sum | activity | daily | raw | 90 | 0..20000 | 0 | whoop | cycle_kilojoule
exercise_duration | min | sum | activity | daily | raw | 90 | 0..1440 | 0 | apple_health | apple_exercise_time
stand_duration | min | sum | activity | daily | raw | 90 | 0..1440 | 0 | apple_health | apple_stand_time
flights_climbed | count | sum | activity | daily | raw | 90 | 0..1000 | 0 | apple_health |
physical_effort | MET | average | activity | event | raw | 90 | 0..30 | 1 | apple_health | physical_effort_mets
standing_events | count | sum | activity | daily | raw | 90 | 0..24 | 0 | apple_health | apple_stand_hour, stand_hours
daylight_duration | min | sum | activity | event | raw | 90 | 0..1440 | 0 | apple_health | time_in_daylight
running_power | W | average | activity | event | raw | 90 | 0..2000 | 0 | apple_health | running_power_watts
running_speed | km/h | average | activity | event | raw | 90 | 0..60 | 1 | apple_health | running_speed_kmh
running_stride_length | m | average | activity | event | raw | 90 | 0..5 | 2 | apple_health |
running_vertical_oscillation | mm | average | activity | event | raw | 90 | 0..500 | 1 | apple_health | running_vertical_oscillation_mm
running_ground_contact_time | ms | average | activity | event | raw | 90 | 0..2000 | 0 | apple_health | running_ground_contact_time_ms
walking_step_length | m | average | activity | event | raw | 90 | 0..3 | 2 | apple_health | walking_step_length_m
walking_speed | km/h | average | activity | event | raw | 90 | 0..30 | 1 | apple_health | walking_speed_kmh
walking_double_support | % | average | activity | event | raw | 90 | 0..100 | 1 | apple_health | walking_double_support_percentage
walking_asymmetry | % | average | activity | event | raw | 90 | 0..100 | 1 | apple_health | walking_asymmetry_percentage
walking_steadiness | % | last | activity | event | raw | 90 | 0..100 | 1 | apple_health | apple_walking_steadiness
stair_ascent_speed | km/h | average | activity | event | raw | 90 | 0..20 | 1 | apple_health | stair_ascent_speed_kmh
stair_descent_speed | km/h | average | activity | event | raw | 90 | 0..20 | 1 | apple_health | stair_descent_speed_kmh
six_minute_walk_distance | m | last | activity | event | raw | 90 | 0..1000 | 0 | apple_health | six_minute_walk_test_distance
swimming_strokes | count | sum | activity | event | raw | 90 | 0..100000 | 0 | apple_health | swimming_stroke_count
handwashing_events | count | sum | activity | event | raw | 90 | 0..200 | 0 | apple_health | handwashing_event
mindful_session_duration | min | sum | activity | event | raw | 90 | 0..1440 | 0 | apple_health | mindful_session
toothbrushing_events | count | sum | activity | event | raw | 90 | 0..20 | 0 | apple_health | toothbrushing_event
audio_exposure_events | count | sum | environment | event | raw | 90 | 0..200 | 0 | apple_health | audio_exposure_event, headphone_audio_exposure_event
audio_exposure_environmental | dB | average | environment | event | raw | 90 | 0..160 | 1 | apple_health | environmental_audio_exposure
audio_exposure_headphone | dB | average | environment | event | raw | 90 | 0..160 | 1 | apple_health | headphone_audio_exposure
audio_exposure_reduction | dB | average | environment | event | raw | 90 | 0..160 | 1 | apple_health | environmental_sound_reduction
whoop_strain | index | max | activity | daily | raw | 90 | 0..21 | 1 | whoop | strain
blood_pressure_systolic | mmHg | average | heart | event | raw | 90 | 50..260 | 0 | apple_health | systolic
blood_pressure_diastolic | mmHg | average | heart | event | raw | 90 | 30..180 | 0 | apple_health | diastolic
heart_rate | bpm | average | heart | continuous | second | 90 | 20..250 | 0 | apple_health |
heart_rate_average | bpm | average | heart | daily | raw | 90 | 20..200 | 0 | whoop | cycle_average_heart_rate
heart_rate_max | bpm | max | heart | daily | raw | 90 | 20..250 | 0 | whoop | max_heart_rate
heart_rate_resting | bpm | average | heart | daily | raw | 90 | 25..120 | 0 | apple_health, whoop | resting_heart_rate, resting_hr, resting_heart_rate_bpm
heart_rate_walking_average | bpm | average | heart | daily | raw | 90 | 40..200 | 0 | apple_health | walking_heart_rate_average
heart_rate_recovery | bpm | average | heart | event | raw | 90 | 0..200 | 0 | apple_health | heart_rate_recovery_one_minute
hrv_rmssd | ms | average | heart | daily | raw | 90 | 1..300 | 1 | whoop | hrv_rmssd_milli
hrv_sdnn | ms | average | heart | daily | raw | 90 | 1..300 | 1 | apple_health | heart_rate_variability_sdnn, hrv
blood_oxygen | % | average | heart | daily | raw | 90 | 50..100 | 1 | apple_health, whoop | spo2_percentage, spo2, oxygen_saturation
respiratory_rate | br/min | average | heart | daily | minute | 90 | 4..60 | 1 | apple_health, whoop |
sleep_duration | min | sum | sleep | daily | raw | 90 | 0..1440 | 0 | apple_health, whoop | sleep_analysis, sleep, sleep_duration_hours, sleep_asleep_duration
sleep_duration_deep | min | sum | sleep | daily | raw | 90 | 0..1440 | 0 | apple_health, whoop | sleep_deep_duration
sleep_duration_rem | min | sum | sleep | daily | raw | 90 | 0..1440 | 0 | apple_health, whoop | sleep_rem_duration
sleep_duration_light | min | sum | sleep | daily | raw | 90 | 0..1440 | 0 | apple_health, whoop | sleep_core_duration, sleep_light_duration
sleep_duration_awake | min | sum | sleep | daily | raw | 90 | 0..1440 | 0 | apple_health, whoop | sleep_awake_duration
sleep_duration_in_bed | min | sum | sleep | daily | raw | 90 | 0..1440 | 0 | apple_health, whoop | sleep_inbed_duration, sleep_in_bed_duration
sleep_efficiency | % | average | sleep | daily | raw | 90 | 0..100 | 1 | whoop | sleep_efficiency_percentage
whoop_sleep_need | min | average | sleep | daily | raw | 90 | 0..1440 | 0 | whoop | sleep_need_minutes
whoop_sleep_debt | min | average | sleep | daily | raw | 90 | 0..1440 | 0 | whoop | sleep_debt_minutes
whoop_sleep_consistency | % | average | sleep | daily | raw | 90 | 0..100 | 1 | whoop | sleep_consistency_percentage
sleep_nap_count | count | sum | sleep | daily | raw | 90 | 0..50 | 0 | whoop | naps
whoop_sleep_performance | % | average | sleep | daily | raw | 90 | 0..100 | 1 | whoop | sleep_performance_percentage, whoop_sleep_performance_percent
whoop_recovery_score | % | average | sleep | daily | raw | 90 | 0..100 | 0 | whoop | recovery_score
oura_sleep_score | index | average | sleep | daily | raw | 90 | 0..100 | 0 | oura | sleep_score
oura_readiness_score | index | average | sleep | daily | raw | 90 | 0..100 | 0 | oura | readiness_score
oura_activity_score | index | average | activity | daily | raw | 90 | 0..100 | 0 | oura | activity_score
body_weight | kg | last | body | event | raw | 90 | 20..400 | 1 | apple_health | body_mass, weight
body_fat | % | last | body | event | raw | 90 | 1..70 | 1 | apple_health | body_fat_percentage
body_height | m | last | body | event | raw | 90 | 0.5..2.7 | 2 | apple_health | height
body_mass_index | index | last | body | event | raw | 90 | 5..100 | 1 | apple_health | bmi
lean_body_mass | kg | last | body | event | raw | 90 | 1..300 | 1 | apple_health | lean_body_mass_kg
vo2_max | mL/kg/min | last | body | event | raw | 90 | 10..95 | 1 | apple_health |
skin_temperature | °C | average | body | daily | raw | 90 | 20..45 | 1 | whoop | skin_temp_celsius
nutrition_energy | kcal | sum | nutrition | daily | raw | 90 | 0..20000 | 0 | yazio, apple_health | calories, yazio_calories, calories_consumed, dietary_energy_consumed, nutrition_calories_kcal
nutrition_protein | g | sum | nutrition | daily | raw | 90 | 0..1000 | 0 | yazio, apple_health | protein, yazio_protein, nutrition_protein_g, dietary_protein
nutrition_carbohydrates | g | sum | nutrition | daily | raw | 90 | 0..2000 | 0 | yazio, apple_health | carbohydrates, carbs, yazio_carbs, nutrition_carbs_g, dietary_carbohydrates
nutrition_fat | g | sum | nutrition | daily | raw | 90 | 0..1000 | 0 | yazio, apple_health | fat, yazio_fat, nutrition_fat_g, dietary_fat_total
nutrition_fiber | g | sum | nutrition | daily | raw | 90 | 0..500 | 0 | yazio, apple_health | fiber, yazio_fiber, nutrition_fiber_g, dietary_fiber
nutrition_sugar | g | sum | nutrition | daily | raw | 90 | 0..2000 | 1 | apple_health | dietary_sugar
nutrition_sodium | mg | sum | nutrition | daily | raw | 90 | 0..100000 | 0 | apple_health | dietary_sodium
nutrition_fat_saturated | g | sum | nutrition | daily | raw | 90 | 0..1000 | 1 | apple_health | dietary_fat_saturated
nutrition_fat_monounsaturated | g | sum | nutrition | daily | raw | 90 | 0..1000 | 1 | apple_health | dietary_fat_monounsaturated
nutrition_fat_polyunsaturated | g | sum | nutrition | daily | raw | 90 | 0..1000 | 1 | apple_health | dietary_fat_polyunsaturated
nutrition_potassium | mg | sum | nutrition | daily | raw | 90 | 0..100000 | 0 | apple_health | dietary_potassium
nutrition_cholesterol | mg | sum | nutrition | daily | raw | 90 | 0..20000 | 0 | apple_health | dietary_cholesterol
nutrition_calcium | mg | sum | nutrition | daily | raw | 90 | 0..100000 | 0 | apple_health | dietary_calcium
nutrition_vitamin_c_intake | mg | sum | nutrition | daily | raw | 90 | 0..10000 | 0 | apple_health | dietary_vitamin_c
nutrition_iron | mg | sum | nutrition | daily | raw | 90 | 0..10000 | 1 | apple_health | dietary_iron
nutrition_caffeine | mg | sum | nutrition | daily | raw | 90 | 0..10000 | 0 | apple_health | dietary_caffeine
water_intake | mL | sum | nutrition | daily | raw | 90 | 0..100000 | 0 | apple_health | dietary_water, water_consumed
nutrition_meal_energy | kcal | sum | nutrition | event | raw | 90 | 0..20000 | 0 | yazio |
nutrition_item_energy | kcal | sum | nutrition | event | raw | 90 | 0..20000 | 0 | yazio | consumed_item_calories
nutrition_item_amount | g | sum | nutrition | event | raw | 90 | 0..100000 | 0 | yazio | consumed_product
nutrition_recipe_portions | count | sum | nutrition | event | raw | 90 | 0..100 | 1 | yazio | consumed_recipe_portion
workout_duration | min | sum | workout | event | raw | never | 0..1440 | 0 | apple_health, whoop | whoop_workout_duration_minutes
workout_distance | km | sum | workout | event | raw | never | 0..500 | 2 | apple_health, whoop | workout_distance_meter
workout_energy | kcal | sum | workout | event | raw | never | 0..15000 | 0 | apple_health, whoop | workout_active_energy, workout_kilojoule
workout_energy_resting | kcal | sum | workout | event | raw | never | 0..5000 | 0 | apple_health | workout_basal_energy_burned
workout_heart_rate_average | bpm | average | workout | event | raw | never | 40..230 | 0 | apple_health, whoop | workout_avg_heart_rate, workout_average_heart_rate
workout_heart_rate | bpm | average | workout | continuous | second | 365 | 20..250 | 0 | apple_health |
workout_heart_rate_max | bpm | max | workout | event | raw | never | 40..240 | 0 | apple_health, whoop | workout_max_heart_rate
workout_heart_rate_zone_1 | % | average | workout | event | raw | never | 0..100 | 1 | whoop | heart_rate_zone_1
workout_heart_rate_zone_2 | % | average | workout | event | raw | never | 0..100 | 1 | whoop | heart_rate_zone_2
workout_heart_rate_zone_3 | % | average | workout | event | raw | never | 0..100 | 1 | whoop | heart_rate_zone_3
workout_heart_rate_zone_4 | % | average | workout | event | raw | never | 0..100 | 1 | whoop | heart_rate_zone_4
workout_heart_rate_zone_5 | % | average | workout | event | raw | never | 0..100 | 1 | whoop | heart_rate_zone_5
workout_steps | count | sum | workout | event | raw | never | 0..200000 | 0 | apple_health |
workout_speed_average | km/h | average | workout | event | raw | never | 0..120 | 1 | apple_health |
workout_speed_max | km/h | max | workout | event | raw | never | 0..200 | 1 | apple_health |
workout_cadence | spm | average | workout | event | raw | never | 0..300 | 0 | apple_health |
workout_cycling_cadence | rpm | average | workout | event | raw | never | 0..250 | 0 | apple_health |
workout_cycling_power | W | average | workout | event | raw | never | 0..2000 | 0 | apple_health |
workout_elevation_gain | m | sum | workout | event | raw | never | 0..15000 | 0 | apple_health, whoop |
workout_elevation_loss | m | sum | workout | event | raw | never | 0..15000 | 0 | apple_health |
workout_lap_length | m | last | workout | event | raw | never | 0..10000 | 1 | apple_health |
workout_swim_cadence | spm | average | workout | event | raw | never | 0..200 | 0 | apple_health |
workout_swimming_strokes | count | sum | workout | event | raw | never | 0..100000 | 0 | apple_health |
workout_intensity | MET | average | workout | event | raw | never | 0..30 | 1 | apple_health |
whoop_workout_strain | index | max | workout | event | raw | never | 0..21 | 1 | whoop | workout_strain
strength_set_weight | kg | max | strength | event | raw | never | 0..1000 | 1 | streak | workout_set_weight_kg
strength_set_reps | count | sum | strength | event | raw | never | 0..1000 | 0 | streak | workout_set_reps
strength_set_volume | kg | sum | strength | event | raw | never | 0..100000 | 1 | streak | workout_set_volume
strength_set_heart_rate_max | bpm | max | strength | event | raw | never | 40..240 | 0 | streak | workout_set_heart_rate_max
strength_session_volume | kg | sum | strength | event | raw | never | 0..1000000 | 0 | streak | workout_total_volume
strength_session_sets | count | sum | strength | event | raw | never | 0..500 | 0 | streak | workout_total_sets
location_point | count | sum | location | event | raw | never | 0..1 | 0 | dawarich, apple_health |
location_latitude | ° | last | location | event | raw | never | -90..90 | 6 | dawarich |
location_longitude | ° | last | location | event | raw | never | -180..180 | 6 | dawarich |
calendar_event_count | count | sum | calendar | daily | raw | 90 | 0..200 | 0 | calendar |
calendar_busy_duration | min | sum | calendar | daily | raw | 90 | 0..1440 | 0 | calendar | calendar_busy_minutes
calendar_meeting_duration | min | sum | calendar | event | raw | 90 | 0..1440 | 0 | calendar | calendar_meeting_duration_minutes
code_commits | count | sum | developer | daily | raw | 90 | 0..2000 | 0 | github |
code_lines_added | count | sum | developer | daily | raw | 90 | 0..– | 0 | github |
code_lines_removed | count | sum | developer | daily | raw | 90 | 0..– | 0 | github |
code_repositories_touched | count | max | developer | daily | raw | 90 | 0..200 | 0 | github |
code_pull_requests_opened | count | sum | developer | daily | raw | 90 | 0..200 | 0 | github |
code_pull_requests_merged | count | sum | developer | daily | raw | 90 | 0..200 | 0 | github |
code_reviews_submitted | count | sum | developer | daily | raw | 90 | 0..500 | 0 | github |
code_issues_opened | count | sum | developer | daily | raw | 90 | 0..500 | 0 | github |
code_contribution_streak | count | last | developer | daily | raw | 90 | 0..– | 0 | github |
code_followers | count | last | developer | daily | raw | 90 | 0..– | 0 | github |
code_stars_received | count | last | developer | daily | raw | 90 | 0..– | 0 | github |
weather_temperature | °C | average | environment | continuous | minute | 90 | -70..60 | 1 | weather | weather_temperature_c
weather_temperature_apparent | °C | average | environment | continuous | minute | 90 | -80..70 | 1 | weather | weather_apparent_temperature_c
weather_humidity | % | average | environment | continuous | minute | 90 | 0..100 | 0 | weather | weather_humidity_pct
weather_precipitation | mm | sum | environment | continuous | minute | 90 | 0..500 | 1 | weather | weather_precipitation_mm
weather_pressure | hPa | average | environment | continuous | minute | 90 | 800..1100 | 0 | weather | weather_pressure_hpa
weather_wind_speed | km/h | average | environment | continuous | minute | 90 | 0..500 | 1 | weather | weather_wind_speed_kmh
weather_cloud_cover | % | average | environment | continuous | minute | 90 | 0..100 | 0 | weather | weather_cloud_cover_pct
weather_uv_index | index | max | environment | continuous | minute | 90 | 0..20 | 1 | weather |
"""

#: From, to, factor.
UNIT_FACTORS = """
kJ kcal 1/4.184, kcal kJ 4.184, m km 0.001, km m 1000, cm m 0.01, m cm 100, s min 1/60, min s 60, h min 60, min h 1/60,
ms s 0.001, s ms 1000, g kg 0.001, kg g 1000, mi km 1.609344, km mi 1/1.609344, mi m 1609.344, m mi 1/1609.344,
yd km 0.0009144, km yd 1/0.0009144, yd m 0.9144, m yd 1/0.9144, lb kg 0.45359237, kg lb 1/0.45359237,
mph km/h 1.609344, km/h mph 1/1.609344, m/s km/h 3.6, km/h m/s 1/3.6, ft m 0.3048, m ft 1/0.3048, cm mm 10, mm cm 0.1,
mm m 0.001, m mm 1000, count/min br/min 1, br/min count/min 1, count/min spm 1, spm count/min 1, count/min bpm 1, bpm count/min 1,
count index 1, index count 1
"""

#: Names with these beginnings are legal without an entry.
NAMESPACES = ("home_assistant_", "apple_health_", "github_", "custom_")


@dataclass(frozen=True)
class Metric:
    metric_type: str
    unit: str
    aggregation: str
    category: str
    cadence: str
    resolution: str
    retention_days: int | None
    least: float | None
    most: float | None
    precision: int
    sources: list[str]
    aliases: list[str]


def _bound(text: str) -> float | None:
    return None if text in ("", "–") else float(text)


@cache
def metrics() -> dict[str, Metric]:
    found = {}
    for line in METRICS.strip().splitlines():
        name, unit, agg, category, cadence, resolution, days, limits, precision, sources, aliases = (c.strip() for c in f"{line} ".split("|"))
        least, most = limits.split("..")
        found[name] = Metric(name, unit, agg, category, cadence, resolution, None if days == "never" else int(days), _bound(least), _bound(most), int(precision), sources.split(", "), [a for a in aliases.split(", ") if a])
    return found


@cache
def unit_factors() -> dict[tuple[str, str], float]:
    found = {}
    for entry in UNIT_FACTORS.replace("\n", " ").split(","):
        a, b, factor = entry.split()
        top, _, bottom = factor.partition("/")
        found[a, b] = float(top) / float(bottom or 1)
    return found


SCHEMA = "metric_type string, unit string, aggregation string, category string, cadence string, resolution string, retention_days int, least double, most double, precision int, sources array<string>, aliases array<string>"


def registry(spark: SparkSession) -> DataFrame:
    """The catalogue as a table of 145 rows."""
    return spark.createDataFrame([tuple(m.__dict__.values()) for m in metrics().values()], SCHEMA)


def aliases(spark: SparkSession) -> DataFrame:
    return registry(spark).select(F.explode("aliases").alias("alias"), F.col("metric_type").alias("canonical"))


def with_definition(points: DataFrame, columns: tuple[str, ...] = ("aggregation", "cadence", "unit")) -> DataFrame:
    """Points with the definition of their metric. An unknown one is an average of events without a unit."""
    definitions = F.broadcast(registry(points.sparkSession).select("metric_type", *columns))  # 145 rows
    synthetic = {"aggregation": "average", "cadence": "event", "unit": "", "category": "custom", "resolution": "raw"}
    joined = points.join(definitions, "metric_type", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(synthetic[c])) for c in columns if c in synthetic})


def canonical(points: DataFrame, raw: str = "metric_type") -> DataFrame:
    """Add ``canonical`` (null if unknown): the stripped name if it is catalogued, what it is an alias of,
    or itself in a namespace."""
    spark = points.sparkSession
    name = F.trim(F.col(raw))
    known = registry(spark).select(F.col("metric_type").alias("_known"))
    out = points.join(F.broadcast(known), name == F.col("_known"), "left").join(F.broadcast(aliases(spark).withColumnRenamed("canonical", "_of")), name == F.col("alias"), "left")
    dynamic = F.when(in_namespace(name), name)
    return out.withColumn("canonical", F.coalesce("_known", "_of", dynamic)).drop("_known", "_of", "alias")


def in_namespace(name: Column) -> Column:
    found = F.lit(False)
    for prefix in NAMESPACES:
        found = found | (name.startswith(prefix) & (F.length(name) > len(prefix)))
    return found


def converted(rows: DataFrame, value: str, source: str, target: str, out: str = "converted") -> DataFrame:
    """``value`` in the target unit; null where no factor is known. Equal units need none."""
    spark = rows.sparkSession
    table = spark.createDataFrame([(a, b, f) for (a, b), f in unit_factors().items()], "_from string, _to string, _factor double")
    joined = rows.join(F.broadcast(table), (F.col(source) == F.col("_from")) & (F.col(target) == F.col("_to")), "left")
    factor = F.when(F.col(source) == F.col(target), F.lit(1.0)).otherwise(F.col("_factor"))
    return joined.withColumn(out, F.col(value) * factor).drop("_from", "_to", "_factor")
