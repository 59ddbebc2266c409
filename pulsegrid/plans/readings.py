"""Measurements and check-ins over the events table: readings of a user on a day, some of them at rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.plans.tables import table

READINGS_SQL = """
SELECT event_id AS id, user_id, ts AS started_at, event_type = 'click' AS at_rest,
       CASE event_id % 4 WHEN 0 THEN 'camera' WHEN 1 THEN 'ble-hr' WHEN 2 THEN 'import-e4' ELSE 'manual' END AS source,
       CASE event_id % 3 WHEN 0 THEN 'good' WHEN 1 THEN 'fair' ELSE 'poor' END AS quality,
       CASE WHEN event_id % 10 <> 0 THEN 60 + value / 4 END AS hr_mean, CASE WHEN event_id % 7 <> 0 THEN 30 + event_id % 23 END AS rmssd,
       CASE WHEN event_id % 7 <> 0 THEN 40 + event_id % 29 END AS sdnn,
       CASE WHEN event_id % 4 = 2 THEN 0.5e0 + event_id % 17 / 10e0 END AS eda_tonic, CASE WHEN event_id % 4 = 2 THEN event_id % 13 / 100e0 - 0.05e0 END AS eda_slope,
       CASE WHEN event_id % 4 = 2 THEN event_id % 9 END AS scr_count, CASE WHEN event_id % 4 = 2 THEN event_id % 8 / 50e0 END AS scr_amp,
       CASE WHEN event_id % 4 = 2 THEN 32 + event_id % 31 / 10e0 END AS temp_mean, CASE WHEN event_id % 4 = 2 THEN event_id % 15 / 100e0 - 0.07e0 END AS temp_slope
FROM events"""


def readings(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    pick = lambda n, values: F.element_at(F.array(*[F.lit(v) for v in values]), (e % n + 1).cast("int"))
    band = lambda c: F.when(e % 4 == 2, c.cast("double"))
    beat = lambda c: F.when(e % 7 != 0, c.cast("double"))
    return table(spark, sf, "events").select(
        e.alias("id"), "user_id", F.col("ts").alias("started_at"), (F.col("event_type") == "click").alias("at_rest"),
        pick(4, ["camera", "ble-hr", "import-e4", "manual"]).alias("source"), pick(3, ["good", "fair", "poor"]).alias("quality"),
        F.when(e % 10 != 0, 60 + F.col("value") / 4).alias("hr_mean"), beat(30 + e % 23).alias("rmssd"), beat(40 + e % 29).alias("sdnn"),
        band(0.5 + e % 17 / 10.0).alias("eda_tonic"), band(e % 13 / 100.0 - 0.05).alias("eda_slope"), band(e % 9).alias("scr_count"), band(e % 8 / 50.0).alias("scr_amp"),
        band(32 + e % 31 / 10.0).alias("temp_mean"), band(e % 15 / 100.0 - 0.07).alias("temp_slope"))


def rest_readings(spark: SparkSession, sf: str) -> DataFrame:
    """Readings that may enter a baseline: at rest, not poor, with a heart rate. Untrusted variability is blanked."""
    from pulsegrid.operators.score import hrv_trusted

    r = readings(spark, sf).filter((F.col("quality") != "poor") & F.col("hr_mean").isNotNull() & F.col("at_rest"))
    ok = hrv_trusted()
    return r.withColumns({"rmssd": F.when(ok, F.col("rmssd")), "sdnn": F.when(ok, F.col("sdnn"))})


def scored_checkins(spark: SparkSession, sf: str) -> DataFrame:
    """Every reading scored against its user's baseline, with the calibration kept beside it."""
    from pulsegrid import constants as K
    from pulsegrid.operators import calibrate as C
    from pulsegrid.operators import score as S

    rest = rest_readings(spark, sf)
    stats = C.baselines(rest, "user_id", K.MODEL_FEATURES)
    scored = S.score_readings(readings(spark, sf), stats, S.baseline_carries(rest, "user_id"))
    return scored.drop("n").join(stats, "user_id", "left")
