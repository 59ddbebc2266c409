"""Activity event views over the events table, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators.ordered import Ordered
from pulsegrid.plans.tables import millis, table

PASSAGE = "the cat sat on the mat near the old town bridge"

# events of a user in order, with a position and a compressed clock (about one event a second)
BASE_SQL = """
SELECT user_id AS run, event_id AS e, event_type AS kind0, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
       CAST(floor((epoch_us(ts) // 1000) / 30000e0) AS BIGINT) AS t0 FROM events"""


def base(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").select(
        F.col("user_id").alias("run"), F.col("event_id").alias("e"), F.col("event_type").alias("kind0"), F.col("value").alias("v"),
        "ts", F.floor(millis("ts") / 30000.0).alias("t0"))
    return Ordered(ev, ["run"], ["ts", "e"]).number("seq").rows.drop("ts")


# -- typing -------------------------------------------------------------------------------------------

KEYS_SQL = f"""
SELECT run, seq, t0 AS t_ms, CASE kind0 WHEN 'click' THEN 'down' WHEN 'view' THEN 'up' ELSE 'input' END AS kind, e % 2 AS key,
       CASE WHEN kind0 NOT IN ('click', 'view') THEN CASE WHEN e % 4 = 0 THEN replace(substr('{PASSAGE}', 1, CAST(e % 33 AS INT)), 'a', 'x')
            ELSE substr('{PASSAGE}', 1, CAST(e % 33 AS INT)) END END AS value FROM ({BASE_SQL}) b"""


def typing(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    b = base(spark, sf)
    text = F.substring(F.lit(PASSAGE), F.lit(1), (F.col("e") % 33).cast("int"))
    value = F.when(F.col("e") % 4 == 0, F.regexp_replace(text, "a", "x")).otherwise(text)
    kind = F.when(F.col("kind0") == "click", "down").when(F.col("kind0") == "view", "up").otherwise("input")
    ev = b.select("run", "seq", F.col("t0").alias("t_ms"), kind.alias("kind"), (F.col("e") % 2).alias("key"),
                  F.when(kind == "input", value).alias("value"))
    return ev, ev.select("run").distinct().withColumn("passage", F.lit(PASSAGE))


# -- tracking -----------------------------------------------------------------------------------------

TRACK_SQL = f"""
SELECT run, seq * 50 AS t_ms, tx + ((e * 13) % 17 - 8) / 100e0 AS px, ty + ((e * 7) % 15 - 7) / 100e0 AS py, tx, ty FROM (
 SELECT run, seq, e, ((e * 37) % 101) / 100e0 AS tx, ((e * 29) % 97) / 100e0 AS ty FROM ({BASE_SQL}) b) c"""


def tracking(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("e")
    d = base(spark, sf).select("run", "seq", "e", (e * 37 % 101 / 100.0).alias("tx"), (e * 29 % 97 / 100.0).alias("ty"))
    return d.select("run", (F.col("seq") * 50).alias("t_ms"), (F.col("tx") + (e * 13 % 17 - 8) / 100.0).alias("px"),
                    (F.col("ty") + (e * 7 % 15 - 7) / 100.0).alias("py"), "tx", "ty")


# -- taps ---------------------------------------------------------------------------------------------

# a path of five points from the start past the target, at fifths of the way
TAPS_SQL = f"""
SELECT run, seq AS trial, tx, ty, r, 0.5e0 AS sx, 0.5e0 AS sy, t0 AS shown, pointer, t0 + 700 + e % 300 AS tap_t,
       tx + ((e % 11) - 5) / 100e0 AS tap_x, ty + ((e % 7) - 3) / 100e0 AS tap_y, e % 5 AS reach FROM (
 SELECT run, seq, e, t0, (e * 37 % 41) / 100e0 + 0.55e0 AS tx, (e * 29 % 43) / 100e0 AS ty, 0.03e0 + (e % 3) * 0.02e0 AS r,
        CASE WHEN e % 6 = 0 THEN 'touch' ELSE 'mouse' END AS pointer FROM ({BASE_SQL}) b) c"""
TAP_PATH_SQL = f"""
SELECT run, trial, k, shown + 90 * k + 10 AS t, sx + (tx - sx) * f AS x, sy + (ty - sy) * f AS y FROM (
 SELECT *, CASE k WHEN 0 THEN 0e0 WHEN 1 THEN 0.4e0 WHEN 2 THEN 0.9e0 WHEN 3 THEN 1 + reach / 20e0 ELSE 1e0 END AS f
 FROM ({TAPS_SQL}) t, (VALUES (0), (1), (2), (3), (4)) v(k)) p"""


def taps(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("e")
    d = base(spark, sf).select(
        "run", F.col("seq").alias("trial"), (e * 37 % 41 / 100.0 + 0.55).alias("tx"), (e * 29 % 43 / 100.0).alias("ty"),
        (e % 3 * 0.02 + 0.03).alias("r"), F.col("t0").alias("shown_ms"), F.when(e % 6 == 0, "touch").otherwise("mouse").alias("pointer"),
        "e", (e % 5).alias("reach"))
    f = [F.lit(0.0), F.lit(0.4), F.lit(0.9), 1 + F.col("reach") / 20.0, F.lit(1.0)]
    path = F.array(*[F.struct((F.col("shown_ms") + 90 * k + 10).alias("t"), (0.5 + (F.col("tx") - 0.5) * f[k]).alias("x"),
                              (0.5 + (F.col("ty") - 0.5) * f[k]).alias("y")) for k in range(5)])
    tap = F.struct((F.col("shown_ms") + 700 + e % 300).alias("t"), (F.col("tx") + (e % 11 - 5) / 100.0).alias("x"),
                   (F.col("ty") + (e % 7 - 3) / 100.0).alias("y"))
    return d.select("run", "trial", F.struct(F.col("tx").alias("x"), F.col("ty").alias("y"), "r").alias("target"),
                    F.struct(F.lit(0.5).alias("x"), F.lit(0.5).alias("y")).alias("start"), "shown_ms", path.alias("path"),
                    tap.alias("tap"), "pointer")


# -- words and arithmetic -----------------------------------------------------------------------------

WORDS_SQL = f"""
SELECT run, seq, 'red' AS ink, e % 2 = 0 AS congruent, CASE WHEN e % 11 = 0 THEN NULL ELSE 300 + CAST(floor(v * 10) AS BIGINT) END AS rt_ms,
       CASE WHEN e % 11 = 0 THEN NULL WHEN e % 7 = 0 THEN 'blue' ELSE 'red' END AS answer FROM ({BASE_SQL}) b"""


def words(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("e")
    return base(spark, sf).select(
        "run", "seq", F.lit("red").alias("ink"), (e % 2 == 0).alias("congruent"),
        F.when(e % 11 != 0, 300 + F.floor(F.col("v") * 10)).alias("rt_ms"),
        F.when(e % 11 != 0, F.when(e % 7 == 0, "blue").otherwise("red")).alias("answer"))


SUMS_SQL = f"""
SELECT run, seq, e % 7 NOT IN (0, 3, 5) AS correct, 500 + CAST(floor(v * 20) AS BIGINT) AS rt_ms, e % 13 = 0 AS timed_out, run % 2 = 0 AS stopped_early
FROM ({BASE_SQL}) b"""


def sums(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("e")
    return base(spark, sf).select(
        "run", "seq", (~(e % 7).isin(0, 3, 5)).alias("correct"), (500 + F.floor(F.col("v") * 20)).alias("rt_ms"),
        (e % 13 == 0).alias("timed_out"), (F.col("run") % 2 == 0).alias("stopped_early"))


# -- body ---------------------------------------------------------------------------------------------

# a user's beats as one paced run after another, stopped after 50 of 60 seconds; time counts from the start of the run
BREATH_SQL = f"""
SELECT user_id * 1000000 + t // 50000 AS run, t % 50000 AS t_ms, rr_ms, hr FROM (
 SELECT run AS user_id, CAST(sum(rr) OVER (PARTITION BY run ORDER BY seq) AS BIGINT) AS t, CASE WHEN e % 9 = 0 THEN NULL ELSE rr END AS rr_ms, 60 + e % 20 AS hr FROM (
  SELECT run, seq, e, 700 + CAST(floor(v * 3) AS BIGINT) AS rr FROM ({BASE_SQL}) b) c) d"""


def breathing(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e, part = F.col("e"), F.floor(F.col("t_ms") / F.lit(50000.0))
    d = base(spark, sf).withColumn("rr", 700 + F.floor(F.col("v") * 3))
    beats = (Ordered(d, ["run"], ["seq"]).running({"t_ms": ("sum", F.col("rr"))}).rows
             .select((F.col("run") * 1000000 + part).alias("run"), "t_ms", F.when(e % 9 != 0, F.col("rr")).alias("rr_ms"), (60 + e % 20).alias("hr")))
    runs = beats.select("run").distinct().select(
        "run", (F.col("run") % 1000000 * 50000).alias("started_ms"), F.lit(60).alias("duration_s"), F.lit(50).alias("completed_s"))
    return beats, runs


MOTION_SQL = f"SELECT run, seq * 25 AS t_ms, (e * 7 % 31 - 15) / 10e0 AS x, (e * 11 % 29 - 14) / 10e0 AS y, (e * 5 % 23 - 11) / 10e0 AS z, seq FROM ({BASE_SQL}) b"


def motion(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("e")
    return base(spark, sf).select(
        "run", (F.col("seq") * 25).alias("t_ms"), ((e * 7 % 31 - 15) / 10.0).alias("x"), ((e * 11 % 29 - 14) / 10.0).alias("y"),
        ((e * 5 % 23 - 11) / 10.0).alias("z"))


RHYTHM_SQL = f"""
SELECT run, CASE kind0 WHEN 'click' THEN 'beat' WHEN 'view' THEN 'paced' ELSE 'free' END AS kind, seq,
       seq * 300 + e % 200 AS t_ms FROM ({BASE_SQL}) b"""


def rhythm(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("kind0") == "click", "beat").when(F.col("kind0") == "view", "paced").otherwise("free")
    return base(spark, sf).select("run", kind.alias("kind"), "seq", (F.col("seq") * 300 + F.col("e") % 200).alias("t_ms"))


# -- runs with metric maps ----------------------------------------------------------------------------

RUNS_SQL = """
SELECT user_id % 40 AS user_id, event_id AS run, CAST(ts AS DATE) AS session, ts, 'typing' AS activity, event_type <> 'signup' AS completed,
       CASE event_type WHEN 'click' THEN 'rest' WHEN 'view' THEN 'rest' WHEN 'error' THEN 'challenge' WHEN 'purchase' THEN 'challenge' ELSE 'recovery' END AS phase,
       40 + event_id % 17 AS wpm, 80 + value AS hold, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 4 END AS corr FROM events"""


def runs(spark: SparkSession, sf: str) -> DataFrame:
    e, k = F.col("event_id"), F.col("event_type")
    phase = F.when(k.isin("click", "view"), "rest").when(k.isin("error", "purchase"), "challenge").otherwise("recovery")
    metrics = F.map_from_entries(F.filter(F.array(
        F.struct(F.lit("wpm").alias("k"), (40 + e % 17).cast("double").alias("v")),
        F.struct(F.lit("holdMeanMs").alias("k"), (80 + F.col("value")).alias("v")),
        F.struct(F.lit("corrections").alias("k"), F.when(e % 5 != 0, e % 4).cast("double").alias("v"))), lambda m: m["v"].isNotNull()))
    return table(spark, sf, "events").select(
        (F.col("user_id") % 40).alias("user_id"), e.alias("run"), F.to_date("ts").alias("session"), millis("ts").alias("started_ms"),
        F.lit("typing").alias("activity"), (k != "signup").alias("completed"), phase.alias("phase"), metrics.alias("metrics"))
