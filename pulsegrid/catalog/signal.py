"""Signal windows over the sample view."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from pulsegrid.catalog import query
from pulsegrid.catalog.beat import r6
from pulsegrid.operators import pulse as P
from pulsegrid.operators import signals as S
from pulsegrid.operators import windows as W
from pulsegrid.plans import tables as T

WIN_SQL = f"""
SELECT *, unnest(range(greatest(CAST(floor((idx - 240) / 60e0) AS BIGINT) + 1, 0), CAST(floor(idx / 60e0) AS BIGINT) + 1)) * 60 AS win FROM ({T.SAMPLES_SQL}) s"""


@query("signal_temperature", f"""
SELECT subject, win, round(avg(temp), 6) AS temp_mean, round(regr_slope(temp, (idx - win) / 240e0), 6) AS temp_slope FROM ({WIN_SQL}) w GROUP BY ALL HAVING count(*) = 240""")
def _(spark, sf):
    w = S.window_arrays(T.samples(spark, sf), ["subject"], "idx", ["temp"], fs=4)
    return S.temp_features(w).select("subject", "win", *r6("temp_mean", "temp_slope"))


@query("signal_motion", f"""
SELECT subject, win, round(stddev_pop(sqrt(ax * ax + ay * ay + az * az) / 64e0), 6) AS acc_std FROM ({WIN_SQL}) w GROUP BY ALL""")
def _(spark, sf):
    w = W.assign_windows(T.samples(spark, sf), "idx", window_ms=240, stride_ms=60, name="win")
    return S.motion_features(w, ["subject", "win"]).select("subject", "win", *r6("acc_std"))


@query("signal_local_maxima", f"""
SELECT subject, idx FROM (SELECT *, lag(eda) OVER w AS a, lead(eda) OVER w AS b FROM ({T.SAMPLES_SQL}) s WINDOW w AS (PARTITION BY subject ORDER BY idx)) x WHERE eda > a AND eda >= b""")
def _(spark, sf):
    return S.local_maxima(T.samples(spark, sf), ["subject"], "idx", "eda").filter("is_peak").select("subject", "idx")


MEAN_W, SLOPE_W = S.tonic_weights()


def dot_sql(weights):
    return f"sum(eda * ([{', '.join(f'{float(w)!r}e0' if 'e' not in repr(float(w)) else repr(float(w)) for w in weights)}])[idx - win + 1])"


@query("signal_tonic_level", f"""
SELECT subject, win, round({dot_sql(MEAN_W)}, 6) AS eda_tonic, round({dot_sql(SLOPE_W)}, 6) AS eda_slope FROM ({WIN_SQL}) w GROUP BY subject, win HAVING count(*) = 240""")
def _(spark, sf):
    w = S.window_arrays(T.samples(spark, sf), ["subject"], "idx", ["eda"], fs=4)
    return S.tonic_features(w).select("subject", "win", *r6("eda_tonic", "eda_slope"))


@query("signal_skin_conductance")
def _(spark, sf):
    w = S.window_arrays(T.samples(spark, sf), ["subject"], "idx", ["eda"], fs=4)
    return S.eda_features(w).select("subject", "win", *r6("eda_tonic", "eda_slope", "scr_count", "scr_amp"))


def pulse_wave(spark, sf):
    """The samples as a 64 Hz pulse wave: a beat of about one second, its height from the data."""
    phase = F.col("idx") / 64.0 * F.lit(2 * math.pi) * 1.1
    return T.samples(spark, sf).withColumn("bvp", (F.col("temp") - 32) * F.sin(phase) + F.col("eda") * 0.01)


@query("signal_pulse_beats")
def _(spark, sf):
    w = S.window_arrays(pulse_wave(spark, sf), ["subject"], "idx", ["bvp"], fs=64, window_s=8, stride_s=2)
    return S.pulse_beats(w).select("subject", "win", F.size("beat_s").alias("n_beats"))


@query("signal_pulse_features")
def _(spark, sf):
    w = S.window_arrays(pulse_wave(spark, sf), ["subject"], "idx", ["bvp"], fs=64, window_s=8, stride_s=2)
    return S.pulse_features(w, ["subject", "win"]).select("subject", "win", "n_beats", *r6("hr_mean", "beat_coverage"), "hr_valid")


@query("signal_ecg_peaks")
def _(spark, sf):
    e = pulse_wave(spark, sf).withColumn("ecg", F.pow(F.sin(F.col("idx") / 70.0 * math.pi), 16) * F.col("temp") - F.col("eda") * 0.01)
    return S.ecg_r_peaks(e, ["subject"], "idx", "ecg", fs=70, block_s=5)


@query("signal_simple_beats")
def _(spark, sf):
    w = S.window_arrays(pulse_wave(spark, sf), ["subject"], "idx", ["bvp"], fs=64, window_s=8, stride_s=2)
    return S.simple_beats(w, "bvp", 64, above_mean=True).select("subject", "win", F.size("beat_idx").alias("n"))


def frames(spark, sf):
    """The samples as 60 Hz colour frames of a fingertip, one reading per subject and ten seconds."""
    s = T.samples(spark, sf)
    reading = F.concat_ws("-", F.col("subject"), F.floor(F.col("idx") / F.lit(600.0)))
    beat = F.sin(F.col("idx") / 60.0 * F.lit(2 * math.pi) * 1.2)
    return s.select(
        reading.alias("reading"), (F.col("idx") * 1000 / 60.0).alias("t_ms"), (180 + beat * 2 + F.col("temp") * 0.1).alias("r"),
        (60 + beat * 0.5 + F.col("ax") * 0.01).alias("g"), (40 + F.col("ay") * 0.02).alias("b"))


@query("signal_pulse_reading")
def _(spark, sf):
    f = frames(spark, sf)
    reading = F.concat_ws("-", F.col("subject"), F.floor(F.col("idx") / F.lit(600.0)))
    m = T.samples(spark, sf).select(reading.alias("reading"), (F.col("idx") * 1000 / 60.0).alias("t_ms"), (F.col("az") / 200.0).alias("a"))
    readings = f.select("reading").distinct().withColumn("torch", F.crc32("reading") % 2 == 0)
    return P.measure(f, readings, m, duration_s=10).select("reading", *r6("hr_mean", "rmssd", "snr_db", "motion_frac"), "quality", "why")


@query("signal_optical_shares", f"""
SELECT subject AS reading, round(avg(CASE WHEN value > 80 THEN 1e0 ELSE 0e0 END), 6) AS saturated, round(avg(CASE WHEN value < 20 THEN 1e0 ELSE 0e0 END), 6) AS dark,
 round(avg(CASE WHEN value > 1.4e0 * g AND value > 1.4e0 * b THEN 1e0 ELSE 0e0 END), 6) AS covered, count(*) AS n_samples
FROM (SELECT user_id % 15 AS subject, value, event_id % 40 AS g, event_id % 30 AS b FROM events) s GROUP BY subject""")
def _(spark, sf):
    e = T.table(spark, sf, "events").select((F.col("user_id") % 15).alias("reading"), F.when(F.col("value") > 80, 255.0).otherwise(F.col("value")).alias("r"),
                                            (F.col("event_id") % 40).alias("g"), (F.col("event_id") % 30).alias("b"))
    return P.optical_shares(e).select("reading", *r6("saturated", "dark", "covered"), "n_samples")
