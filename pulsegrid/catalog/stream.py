"""Streams over the events table: the whole table runs through as one available-now stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.catalog import query
from pulsegrid.catalog.beat import features_sql
from pulsegrid.plans import tables as T
from pulsegrid.session import new_folder
from pulsegrid.streaming import live as L
from pulsegrid.streaming import replay as P
from pulsegrid.streaming import versioned as V

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def events(spark, sf):
    s = spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", "events*.parquet").parquet(sf)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


# windows are compared once they are closed: the watermark has passed their end
CLOSED = "(SELECT max(ts) - INTERVAL 20 MINUTE FROM events)"


@query("stream_hourly_counts", f"""
SELECT event_type, date_trunc('hour', ts) AS win_start, count(*) AS n, round(avg(value), 6) AS value FROM events GROUP BY event_type, date_trunc('hour', ts) HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= {CLOSED}""")
def _(spark, sf):
    w = L.tumbling(events(spark, sf), ["event_type"], "ts", "1 hour", [F.count("*").alias("n"), F.avg("value").alias("value")])
    out = L.run_once(w, new_folder(spark, "hourly"))
    return out.select("event_type", F.col("win_start").cast("timestamp_ntz").alias("win_start"), "n", F.round("value", 6).alias("value"))


SLIDING_SQL = """
SELECT user_id % 15 AS owner, epoch_us(ts) AS t_us, event_id, 700 + value AS rr_ms,
       unnest(range(CAST(floor((epoch_us(ts) - 3600000000) / 900000000e0) AS BIGINT) + 1, CAST(floor(epoch_us(ts) / 900000000e0) AS BIGINT) + 1)) * 900000000 AS s FROM events"""


@query("stream_sliding_windows", f"""
SELECT owner, make_timestamp(s) AS win_start, n_beats AS n, n_clean, round(rejected, 6) AS rejected, round(hr_mean, 6) AS hr_mean
FROM ({features_sql(SLIDING_SQL, 'owner, s', 't_us', 'owner, s, t_us', '3600')}) f WHERE make_timestamp(s) + INTERVAL 1 HOUR <= {CLOSED}""")
def _(spark, sf):
    b = events(spark, sf).select((F.col("user_id") % 15).alias("owner"), "ts", (700 + F.col("value")).alias("rr_ms"))
    out = L.run_once(L.stream_windows(b, window_s=3600, stride_s=900), new_folder(spark, "sliding"))
    return out.select("owner", F.col("win_start").cast("timestamp_ntz").alias("win_start"), F.col("n_beats").alias("n"), "n_clean",
                      *[F.round(c, 6).alias(c) for c in ("rejected", "hr_mean")])


@query("stream_latest_changes", "SELECT user_id, max(event_id) AS id, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def _(spark, sf):
    # the feed comes in four files, so the table is merged in four batches
    folder = new_folder(spark, "changes")
    feed = T.table(spark, sf, "events").select("user_id", F.col("event_id").alias("seq"), "event_type")
    feed.repartitionByRange(4, "seq").write.parquet(f"{folder}/feed")
    stream = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/feed")
    V.merge_changes(stream, f"{folder}/table", f"{folder}/checkpoint", key=["user_id"], buckets=16).awaitTermination()
    return V.read_table(spark, f"{folder}/table", feed.schema, ["user_id"], "seq").select("user_id", F.col("seq").alias("id"), "event_type")


FRAMES_SQL = f"""
SELECT concat_ws('-', subject, CAST(floor(idx / 600e0) AS BIGINT)) AS reading, idx * 1000 / 60e0 AS t_ms, 180 + sin(idx / 60e0 * 2 * pi() * 1.2e0) * 2 + temp * 0.1e0 AS r
FROM ({T.SAMPLES_SQL}) s"""


@query("stream_display_trace", f"""
WITH RECURSIVE f AS (SELECT reading, t_ms, r, row_number() OVER (PARTITION BY reading ORDER BY t_ms) AS i FROM ({FRAMES_SQL}) x),
z AS (
  SELECT reading, i, t_ms, -r AS slow, 0e0 AS fast FROM f WHERE i = 1
  UNION ALL
  SELECT reading, i, t_ms, s1, f0 + (x - s1 - f0) * (1 - exp(-dt / 0.07e0)) FROM (
    SELECT *, s0 + (x - s0) * (1 - exp(-dt / 1.2e0)) AS s1 FROM (
      SELECT f.reading, f.i, f.t_ms, -f.r AS x, least(0.2e0, (f.t_ms - z.t_ms) / 1000) AS dt,
             CASE WHEN abs(-f.r - z.slow) > 25 THEN -f.r ELSE z.slow END AS s0, CASE WHEN abs(-f.r - z.slow) > 25 THEN 0e0 ELSE z.fast END AS f0
      FROM z JOIN f ON f.reading = z.reading AND f.i = z.i + 1) a) b)
SELECT reading, round(t_ms, 3) AS t_ms, round(fast, 4) + 0e0 AS v FROM z""")
def _(spark, sf):
    from pulsegrid.catalog.signal import frames

    return L.trace(frames(spark, sf)).select("reading", F.round("t_ms", 3).alias("t_ms"), (F.round("v", 4) + F.lit(0.0)).alias("v"))


# packets of 15 devices: a month of events in twelve minutes
PACKETS_SQL = """
SELECT user_id % 15 AS device, epoch_us(ts) // 3600000 AS t_ms, CASE WHEN event_id % 9 <> 0 THEN 700 + value END AS rr_ms,
       CASE WHEN event_id % 17 = 0 THEN NULL ELSE event_id % 13 <> 0 END AS contact, CASE WHEN event_id % 10 = 0 THEN 100 - (event_id // 500) % 60 END AS battery,
       event_type, event_id, value FROM events"""
LATER = 10 ** 9     # a row so many milliseconds after the last one closes what is open


def packets(spark, sf):
    """The packets as a stream, and one row of device -1 that moves the watermark past all of them."""
    last = T.table(spark, sf, "events").agg(F.max("event_id").alias("id"), F.max("ts").alias("ts")).select("id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms")).first()
    e = F.col("event_id")
    t = F.floor(F.unix_millis("ts") / 3600)
    row = [(F.col("user_id") % 15).alias("device"), t.alias("t_ms"), F.when(e % 9 != 0, 700 + F.col("value")).alias("rr_ms"), F.when(e % 17 != 0, e % 13 != 0).alias("contact"),
           F.when(e % 10 == 0, 100 - F.floor(e / 500) % 60).alias("battery"), F.col("event_type").alias("event_type"), e.alias("event_id"), F.col("value").alias("value")]
    end = [F.lit(-1).cast("long").alias("device"), F.lit((last["ms"] or 0) // 3600 + LATER).cast("long").alias("t_ms")] + row[2:]
    both = F.array(F.struct(*row), F.when(e == last["id"], F.struct(*end)))
    return events(spark, sf).select(F.inline(F.filter(both, lambda r: r.isNotNull())))


def played(spark, stream, name):
    with P.with_rocks(spark):
        return L.run_once(stream, new_folder(spark, name))


RETRIES_SQL = "(VALUES (4000, 'retry', 1), (5000, 'retry', 2), (7000, 'retry', 3), (11000, 'retry', 4), (19000, 'retry', 5), (35000, 'gone', 5)) v(after, event, attempt)"


@query("stream_connection_gaps", f"""
WITH g AS (SELECT device, t_ms, lead(t_ms) OVER (PARTITION BY device ORDER BY t_ms) AS next FROM ({PACKETS_SQL}) p),
m AS (SELECT device, t_ms, next, t_ms + after AS due, event, attempt FROM g, {RETRIES_SQL} WHERE next IS NULL OR t_ms + after < next)
SELECT device, due AS t_ms, event, attempt FROM m UNION ALL SELECT device, next, 'back', max(attempt) FROM m WHERE next IS NOT NULL GROUP BY device, t_ms, next""")
def _(spark, sf):
    return played(spark, P.connection_gaps(packets(spark, sf)), "gaps")


@query("stream_device_state", f"""
WITH s AS (SELECT device, t_ms, contact, bool_or(rr_ms IS NOT NULL) OVER w AS has_rr, last_value(battery IGNORE NULLS) OVER w AS battery,
                  row_number() OVER (PARTITION BY device ORDER BY t_ms, rr_ms NULLS FIRST, contact NULLS FIRST, battery NULLS FIRST) AS i
           FROM ({PACKETS_SQL}) p WINDOW w AS (PARTITION BY device ORDER BY t_ms, rr_ms NULLS FIRST, contact NULLS FIRST, battery NULLS FIRST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, lag(contact) OVER o AS c, lag(has_rr) OVER o AS h, lag(battery) OVER o AS b FROM s WINDOW o AS (PARTITION BY device ORDER BY i))
SELECT device, t_ms, contact, has_rr, battery FROM l WHERE i = 1 OR contact IS DISTINCT FROM c OR has_rr IS DISTINCT FROM h OR battery IS DISTINCT FROM b""")
def _(spark, sf):
    return played(spark, P.device_state(packets(spark, sf)), "devices")


QUALITY_FEATURES_SQL = features_sql(f"""
SELECT a.device, a.i, b.i AS j, b.rr_ms FROM numbered a JOIN numbered b ON b.device = a.device AND b.i <= a.i AND b.t_ms > a.t_ms - 20000
WHERE b.rr_ms IS NOT NULL AND b.contact IS DISTINCT FROM FALSE""", "device, i", "j", "device, i, j", "20")


@query("stream_signal_quality", f"""
WITH numbered AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY t_ms, rr_ms NULLS FIRST, contact NULLS FIRST) AS i FROM ({PACKETS_SQL}) p),
f AS ({QUALITY_FEATURES_SQL}),
q AS (SELECT device, i, t_ms, CASE WHEN contact = FALSE THEN 'poor' WHEN n_beats IS NULL THEN 'fair' WHEN n_clean < 3 THEN 'poor' WHEN coverage >= 0.9e0 AND rejected <= 0.05e0 THEN 'good'
      WHEN coverage >= 0.6e0 AND rejected <= 0.2e0 THEN 'fair' ELSE 'poor' END AS quality, lead(t_ms) OVER (PARTITION BY device ORDER BY i) AS next FROM numbered LEFT JOIN f USING (device, i)),
e AS (SELECT device, i, t_ms, quality FROM q UNION ALL SELECT device, i + 0.5, t_ms + 4000, 'poor' FROM q WHERE next IS NULL OR next - t_ms > 4000),
c AS (SELECT *, lag(quality) OVER (PARTITION BY device ORDER BY i) AS before FROM e)
SELECT device, t_ms, quality FROM c WHERE quality IS DISTINCT FROM before""")
def _(spark, sf):
    return played(spark, P.live_quality(packets(spark, sf)), "quality")


KINDS = {"click": "beats", "view": "frames", "error": "acceleration", "purchase": "samples", "signup": "keystrokes"}


@query("stream_retention", f"""
WITH k AS (SELECT device, t_ms, event_id, CASE event_type {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in KINDS.items())} END AS kind FROM ({PACKETS_SQL}) p),
n AS (SELECT *, row_number() OVER (PARTITION BY device, kind ORDER BY t_ms) AS i FROM k),
t AS (SELECT a.device, a.t_ms, a.kind, a.i, count(*) AS n_kept, min(b.t_ms) AS oldest_ms FROM n a JOIN n b ON b.device = a.device AND b.kind = a.kind AND b.i <= a.i
      AND CASE a.kind WHEN 'beats' THEN b.t_ms >= a.t_ms - 1200000 WHEN 'frames' THEN b.t_ms >= a.t_ms - 90000 WHEN 'acceleration' THEN b.t_ms >= a.t_ms - 300000
          WHEN 'samples' THEN b.i > a.i - 15 ELSE b.i > a.i - 10 END GROUP BY ALL)
SELECT device, t_ms, kind, n_kept, oldest_ms FROM t""")
def _(spark, sf):
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), F.col("event_type"))
    return played(spark, P.retained(packets(spark, sf).withColumn("kind", kind)), "retained")


# looks every half second at the beats of the last four; two devices in three report a beat a little later every other time
LOOKS_SQL = f"""
SELECT device AS reading, t_ms + CASE WHEN device % 3 > 0 AND look % 2 = 0 THEN device ELSE 0 END AS t_ms, look * 500 AS now_ms FROM (
 SELECT device, t_ms, unnest(range(t_ms // 500 + 1, t_ms // 500 + 9)) AS look FROM ({PACKETS_SQL}) p) x"""


@query("stream_shown_beats", f"""
WITH RECURSIVE o AS (SELECT reading, t_ms, row_number() OVER (PARTITION BY reading ORDER BY now_ms, t_ms) AS i FROM ({LOOKS_SQL}) l WHERE t_ms <= now_ms - 350),
m AS (SELECT reading, peak, min(i) AS i FROM (SELECT reading, i, max(t_ms) OVER (PARTITION BY reading ORDER BY i) AS peak FROM o) x GROUP BY reading, peak),
b AS (SELECT reading, x, t_ms, min(peak) OVER w AS next, min(i) OVER w AS i FROM (
      SELECT reading, peak AS x, NULL AS t_ms, peak, i FROM m UNION ALL SELECT DISTINCT reading, t_ms + 250, t_ms, NULL, NULL FROM o) u
      WINDOW w AS (PARTITION BY reading ORDER BY x DESC, t_ms NULLS LAST ROWS UNBOUNDED PRECEDING)),
s AS MATERIALIZED (SELECT reading, t_ms, next, i FROM b WHERE t_ms IS NOT NULL AND next IS NOT NULL),
r AS (SELECT reading, i, t_ms, CAST(NULL AS BIGINT) AS gap FROM o WHERE i = 1
      UNION ALL SELECT s.reading, s.i, s.next, s.next - r.t_ms FROM r JOIN s ON s.reading = r.reading AND s.t_ms = r.t_ms),
v AS (SELECT reading, i, t_ms, CASE WHEN gap BETWEEN 300 AND 2000 THEN CAST(gap AS DOUBLE) END AS rr, count(CASE WHEN gap BETWEEN 300 AND 2000 THEN 1 END) OVER (PARTITION BY reading ORDER BY i) AS k FROM r),
h AS (SELECT reading, k, 60000 / rr AS hr FROM v WHERE rr IS NOT NULL),
g AS (SELECT a.reading, a.k, list(b.hr ORDER BY b.hr) AS l FROM h a JOIN h b ON b.reading = a.reading AND b.k <= a.k AND b.k > a.k - 5 GROUP BY ALL)
SELECT reading, CAST(t_ms AS DOUBLE) AS t_ms, rr AS rr_ms, round(l[len(l) // 2 + 1], 6) AS hr FROM v JOIN g USING (reading, k)""")
def _(spark, sf):
    p = packets(spark, sf)
    first = F.floor(F.col("t_ms") / 500) + 1
    looks = p.select(F.col("device").alias("reading"), "t_ms", F.explode(F.sequence(first, first + 7)).alias("look"))
    later = F.when((F.col("reading") % 3 > 0) & (F.col("look") % 2 == 0), F.col("reading")).otherwise(0)
    d = looks.select("reading", (F.col("t_ms") + later).alias("t_ms"), (F.col("look") * 500).alias("now_ms"))
    return played(spark, P.held_back_beats(d), "shown").select("reading", "t_ms", "rr_ms", F.round("hr", 6).alias("hr"))


STEPS = "CASE event_type WHEN 'click' THEN 'rest' WHEN 'view' THEN 'rest' WHEN 'error' THEN 'challenge' WHEN 'purchase' THEN 'recovery' WHEN 'signup' THEN 'end' END"


@query("stream_phase_intervals", f"""
WITH e AS (SELECT device, t_ms, event_id, CASE WHEN event_id % 31 = 0 THEN 'stop' ELSE {STEPS} END AS phase FROM ({PACKETS_SQL}) p),
c AS (SELECT *, lag(phase) OVER (PARTITION BY device ORDER BY t_ms, phase) AS before FROM e),
n AS (SELECT device, phase, t_ms AS start_ms, lead(t_ms) OVER o AS end_ms, lead(phase) OVER o = 'stop' AS aborted FROM c WHERE phase IS DISTINCT FROM before WINDOW o AS (PARTITION BY device ORDER BY t_ms, phase))
SELECT device, phase, start_ms, end_ms, aborted FROM n WHERE end_ms IS NOT NULL AND phase NOT IN ('stop', 'end')""")
def _(spark, sf):
    phase = F.when(F.col("event_id") % 31 == 0, "stop").otherwise(F.expr(STEPS))
    return played(spark, P.phase_intervals(packets(spark, sf).withColumn("phase", phase), "device"), "phases")


READINGS_SQL = f"""
SELECT s.device, s.t_ms AS start_ms, b.t_ms, b.rr_ms FROM ({PACKETS_SQL}) s JOIN ({PACKETS_SQL}) b ON b.device = s.device AND b.t_ms >= s.t_ms AND b.t_ms < s.t_ms + 60000
WHERE s.event_type = 'signup' AND b.event_type <> 'signup' AND b.rr_ms IS NOT NULL"""


@query("stream_readings", f"""
SELECT device, start_ms, round(hr_mean, 6) AS hr_mean, round(rmssd, 6) AS rmssd, round(sdnn, 6) AS sdnn, n_beats, n_clean, round(coverage, 6) AS coverage, round(rejected, 6) AS rejected
FROM ({features_sql(READINGS_SQL, 'device, start_ms', 't_ms, rr_ms', 'device, start_ms, t_ms', '60')}) f""")
def _(spark, sf):
    at = F.timestamp_millis("t_ms")
    # both streams have the row that comes last
    starts = packets(spark, sf).filter("event_type = 'signup' OR device = -1").select("device", at.alias("start_ts"))
    beats = packets(spark, sf).filter("(event_type <> 'signup' AND rr_ms IS NOT NULL) OR device = -1").select("device", at.alias("ts"), "rr_ms")
    out = L.run_once(L.readings(beats, starts, "device"), new_folder(spark, "readings"))
    return out.select("device", F.unix_millis("start_ts").alias("start_ms"), *[F.round(c, 6).alias(c) for c in ("hr_mean", "rmssd", "sdnn")], "n_beats", "n_clean",
                      *[F.round(c, 6).alias(c) for c in ("coverage", "rejected")])
