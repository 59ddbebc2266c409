"""Domain views over the driver's tables: the same rows in Spark and, as SQL text, in the checking engine.

Running sums and row numbers over an owner use `Ordered` on the Spark side, because one owner may hold a
large share of the events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators.ordered import Ordered


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def millis(ts: str):
    return F.unix_millis(F.col(ts).cast("timestamp"))


# -- beats --------------------------------------------------------------------------------------------

BEATS_SQL = """
SELECT subject, seq, rr_ms, t_ms, 1 + CAST(floor(t_ms / 90000e0) AS BIGINT) % 3 AS cond FROM (
 SELECT subject, seq, rr_ms, CAST(sum(rr_ms) OVER (PARTITION BY subject ORDER BY seq
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS t_ms FROM (
  SELECT user_id % 15 AS subject,
         row_number() OVER (PARTITION BY user_id % 15 ORDER BY ts, event_id) AS seq,
         CASE WHEN event_id % 37 = 0 THEN 250
              ELSE 700 + CAST(floor(round(value * 100) / 50e0) AS BIGINT) END AS rr_ms
  FROM events) x) y
"""


def beats(spark: SparkSession, sf: str, subjects: int = 15) -> DataFrame:
    """subject, seq, rr_ms, t_ms, cond: all events as consecutive beat intervals of some subjects."""
    rr = F.when(F.col("event_id") % 37 == 0, 250).otherwise(
        700 + F.floor(F.round(F.col("value") * 100) / 50.0)).cast("long")
    ev = table(spark, sf, "events").select(
        (F.col("user_id") % subjects).alias("subject"), "ts", "event_id", rr.alias("rr_ms"))
    rows = Ordered(ev, ["subject"], ["ts", "event_id"]).number("seq").running({"t_ms": ("sum", F.col("rr_ms"))})
    return rows.rows.select("subject", "seq", "rr_ms", "t_ms",
                            (1 + F.floor(F.col("t_ms") / 90000.0) % 3).alias("cond"))


# -- 4 Hz samples -------------------------------------------------------------------------------------

SAMPLES_SQL = """
SELECT user_id % 15 AS subject,
       row_number() OVER (PARTITION BY user_id % 15 ORDER BY ts, event_id) - 1 AS idx,
       value / 50e0 AS eda, 33 + ((event_id * 7) % 1000) / 1000e0 AS temp,
       event_id % 61 AS ax, event_id % 53 AS ay, event_id % 67 AS az, event_type
FROM events
"""


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """subject, idx (4 Hz), eda, temp, ax, ay, az: events as uniform samples."""
    e = F.col("event_id")
    ev = table(spark, sf, "events").select(
        (F.col("user_id") % 15).alias("subject"), "ts", "event_id", (F.col("value") / 50.0).alias("eda"),
        (33 + (e * 7 % 1000) / 1000.0).alias("temp"), (e % 61).alias("ax"), (e % 53).alias("ay"),
        (e % 67).alias("az"), "event_type")
    return (Ordered(ev, ["subject"], ["ts", "event_id"]).number("_n").rows
            .withColumn("idx", F.col("_n") - 1).drop("_n", "ts", "event_id"))


# -- check-ins ----------------------------------------------------------------------------------------

CHECKINS_SQL = """
SELECT event_id AS id, user_id, ts AS created_at,
       CASE WHEN event_type = 'signup' THEN NULL
            ELSE CAST(CAST(round(value * 100) AS BIGINT) % 201 - 100 AS DOUBLE) / 100 END AS fused,
       1 + event_id % 5 AS feeling, event_type AS tag
FROM events
"""


def checkins(spark: SparkSession, sf: str) -> DataFrame:
    cents = F.round(F.col("value") * 100).cast("long")
    fused = F.when(F.col("event_type") == "signup", None).otherwise((cents % 201 - 100).cast("double") / 100)
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), "user_id", F.col("ts").alias("created_at"), fused.alias("fused"),
        (1 + F.col("event_id") % 5).alias("feeling"), F.col("event_type").alias("tag"))


# -- records ------------------------------------------------------------------------------------------

RECORDS_SQL = """
SELECT o_custkey % 50 AS user_id, o_orderkey % 400 AS id,
       row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderdate, o_orderkey) AS seq,
       o_orderstatus = 'F' AS deleted, CAST(floor(o_totalprice) AS BIGINT) % 65536 AS bytes,
       o_orderdate AS edited_at
FROM orders
"""


def record_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Change log of 50 users' records: user_id, id, seq, deleted, bytes, edited_at."""
    o = table(spark, sf, "orders").select(
        (F.col("o_custkey") % 50).alias("user_id"), (F.col("o_orderkey") % 400).alias("id"), "o_orderkey",
        (F.col("o_orderstatus") == "F").alias("deleted"),
        (F.floor(F.col("o_totalprice")).cast("long") % 65536).alias("bytes"), F.col("o_orderdate").alias("edited_at"))
    return Ordered(o, ["user_id"], ["edited_at", "o_orderkey"]).number("seq").rows.drop("o_orderkey")


RECORD_TABLE_SQL = f"""
SELECT user_id, id, max(seq) AS seq, max_by(deleted, seq) AS deleted,
       CASE WHEN max_by(deleted, seq) THEN 0 ELSE max_by(bytes, seq) END AS bytes,
       max_by(edited_at, seq) AS edited_at, count(*) AS version
FROM ({RECORDS_SQL}) r GROUP BY user_id, id
"""


def record_table(spark: SparkSession, sf: str) -> DataFrame:
    """Current state: the newest change of every (user, id)."""
    return record_changes(spark, sf).groupBy("user_id", "id").agg(
        F.max("seq").alias("seq"), F.max_by("deleted", "seq").alias("deleted"),
        F.when(F.max_by("deleted", "seq"), 0).otherwise(F.max_by("bytes", "seq")).alias("bytes"),
        F.max_by("edited_at", "seq").alias("edited_at"), F.count("*").alias("version"))


# -- scored rows --------------------------------------------------------------------------------------

SCORED_SQL = """
SELECT event_id AS id, user_id % 15 AS owner, CASE WHEN event_type IN ('error', 'purchase') THEN 1 ELSE 0 END AS y,
       floor(value * 20 / (value + 35e0)) / 20e0 AS p, 1 + event_id % 3 AS cond, event_id % 7 <> 0 AS valid,
       value, value + ((event_id % 21) - 10) / 2e0 AS ref
FROM events
"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Scored rows of 15 owners: label y, probability p (coarse, so there are ties), condition, validity and a
    device / reference pair."""
    e, v = F.col("event_id"), F.col("value")
    return table(spark, sf, "events").select(
        e.alias("id"), (F.col("user_id") % 15).alias("owner"),
        F.when(F.col("event_type").isin("error", "purchase"), 1).otherwise(0).alias("y"),
        (F.floor(v * 20 / (v + 35.0)) / 20.0).alias("p"), (1 + e % 3).alias("cond"), (e % 7 != 0).alias("valid"),
        v.alias("value"), (v + ((e % 21) - 10) / 2.0).alias("ref"))
