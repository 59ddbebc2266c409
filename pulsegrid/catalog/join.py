"""As-of, interpolating, interval and index joins; count windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.catalog import query
from pulsegrid.catalog.beat import r6, sql6
from pulsegrid.operators import joins as J
from pulsegrid.operators import windows as W
from pulsegrid.operators.ordered import Ordered
from pulsegrid.plans import tables as T

# clicks look for the error report of the same user nearest in time
ASOF_SQL = """
WITH l AS (SELECT user_id, event_id, (epoch_us(ts) // 1000) AS t FROM events WHERE event_type = 'click'),
r AS (SELECT user_id, event_id AS state_id, (epoch_us(ts) // 1000) AS state_t, value FROM events WHERE event_type = 'error'),
m AS (SELECT l.user_id, l.event_id, l.t, r.state_t, r.value, l.t - r.state_t AS gap,
             row_number() OVER (PARTITION BY l.user_id, l.event_id ORDER BY abs(l.t - r.state_t), r.state_t, state_id) AS k
      FROM l LEFT JOIN r ON r.user_id = l.user_id)
SELECT user_id, event_id, t, {cols} FROM m WHERE k = 1
"""


def _sides(spark, sf):
    e = T.table(spark, sf, "events").withColumn("t", T.millis("ts"))
    left = e.filter("event_type = 'click'").select("user_id", "event_id", "t")
    right = e.filter("event_type = 'error'").select(
        "user_id", F.col("event_id").alias("state_id"), F.col("t").alias("state_t"), "value")
    return left, J.earliest_of_time(right, ["user_id"], "state_t", "state_id", ["value"])


@query("join_asof_nearest", ASOF_SQL.format(cols="state_t, value, gap"))
def _(spark, sf):
    left, right = _sides(spark, sf)
    return J.asof_nearest(left, right, ["user_id"], t="t", left_id="event_id", right_t="state_t",
                          right_id="state_id", values=["value"])


@query("join_asof_tolerance", ASOF_SQL.format(cols=", ".join(
    f"CASE WHEN abs(gap) < 3600000 THEN {c} END AS {c}" for c in ("state_t", "value", "gap"))))
def _(spark, sf):
    left, right = _sides(spark, sf)
    return J.asof_nearest(left, right, ["user_id"], t="t", left_id="event_id", right_t="state_t",
                          right_id="state_id", values=["value"], tolerance=3_600_000)


@query("join_interpolate", f"""
WITH b AS ({T.BEATS_SQL}), g AS (
 SELECT subject, t0 + unnest(range(0, CAST(floor((t1 - t0) / 1000e0 * 2e0) AS BIGINT) + 1)) * 500 AS t
 FROM (SELECT subject, min(t_ms) AS t0, max(t_ms) AS t1 FROM b GROUP BY subject) e),
bb AS (SELECT *, t_ms - lag(t_ms) OVER (PARTITION BY subject ORDER BY t_ms) AS back FROM b),
p AS (SELECT g.subject, g.t, a.t_ms AS ta, a.rr_ms AS va, a.back FROM g ASOF JOIN bb a ON a.subject = g.subject AND g.t >= a.t_ms),
n AS (SELECT p.*, c.t_ms AS tb, c.rr_ms AS vb FROM p ASOF LEFT JOIN b c ON c.subject = p.subject AND p.t < c.t_ms)
SELECT subject, CAST(t AS DOUBLE) AS t, round(CASE WHEN tb IS NULL THEN va ELSE va + (vb - va) * ((t - ta) / CAST(tb - ta AS DOUBLE)) END, 6)
       AS rr_ms, coalesce(tb - ta, back) <= 900 AS valid FROM n""")
def _(spark, sf):
    b = T.beats(spark, sf)
    grid = J.uniform_grid(b, ["subject"], "t_ms", 2.0, "t").select("subject", "t")
    out = J.interpolate_at(grid, b, ["subject"], t="t", sample_t="t_ms", values=["rr_ms"], max_gap=900)
    return out.select("subject", "t", *r6("rr_ms"), "valid")


@query("join_label_at_rate", f"""
WITH s AS ({T.SAMPLES_SQL}), l AS (SELECT subject, idx AS label_idx, ax % 4 AS label FROM s),
e AS (SELECT subject, max(label_idx) AS last FROM l GROUP BY subject)
SELECT x.subject, x.idx, l.label_idx, l.label FROM (
 SELECT s.subject, s.idx, least(CAST(floor((s.idx + 0.5e0) / 4e0 * 7e0) AS BIGINT), e.last) AS li
 FROM s JOIN e USING (subject)) x LEFT JOIN l ON l.subject = x.subject AND l.label_idx = x.li""")
def _(spark, sf):
    s = T.samples(spark, sf)
    labels = s.select("subject", F.col("idx").alias("label_idx"), (F.col("ax") % 4).alias("label"))
    return W.label_at_rate(s.select("subject", "idx"), labels, ["subject"], idx="idx", fs=4, label_fs=7,
                           label_idx="label_idx", label="label")


@query("join_label_over_span", f"""
SELECT subject, target_idx, label, round(label_frac, 6) AS label_frac FROM (
 SELECT subject, target_idx, label, n / CAST(sum(n) OVER (PARTITION BY subject, target_idx) AS DOUBLE) AS label_frac,
        row_number() OVER (PARTITION BY subject, target_idx ORDER BY n DESC, label) AS k FROM (
  SELECT subject, CAST(floor(idx / 28e0 * 4e0) AS BIGINT) AS target_idx, ax % 4 AS label, count(*) AS n
  FROM ({T.SAMPLES_SQL}) s GROUP BY ALL) c) r WHERE k = 1""")
def _(spark, sf):
    s = T.samples(spark, sf).withColumn("label", F.col("ax") % 4)
    return W.label_over_span(s, ["subject"], idx="idx", fs=4, label_fs=28, label="label").select(
        "subject", "target_idx", "label", *r6("label_frac"))


@query("join_interval_bucketed", f"""
WITH b AS ({T.BEATS_SQL})
SELECT b.subject, b.t_ms, s.t_ms AS start_ms, b.rr_ms FROM b JOIN b s
  ON s.subject = b.subject AND s.rr_ms < 300 AND b.t_ms >= s.t_ms AND b.t_ms < s.t_ms + 12000""")
def _(spark, sf):
    b = T.beats(spark, sf)
    spans = b.filter("rr_ms < 300").select("subject", F.col("t_ms").alias("start_ms"),
                                            (F.col("t_ms") + 12000).alias("end_ms"))
    return J.bucketed_interval(b, spans, ["subject"], t="t_ms", start="start_ms", end="end_ms",
                               bucket=12000).select("subject", "t_ms", "start_ms", "rr_ms")


@query("join_near_samples", f"""
WITH b AS ({T.BEATS_SQL})
SELECT x.subject, x.t_ms, count(*) AS n_near, round(stddev_samp(s.rr_ms), 6) AS sd_near
FROM b x JOIN b s ON s.subject = x.subject AND s.t_ms BETWEEN x.t_ms - 2000 AND x.t_ms + 2000
WHERE TRUE GROUP BY x.subject, x.t_ms""")
def _(spark, sf):
    b = T.beats(spark, sf)
    return J.near_stats(b, b, ["subject"], t="t_ms", sample_t="t_ms", value="rr_ms",
                        span=2000).select("subject", "t_ms", "n_near", *r6("sd_near"))


@query("window_by_count", f"""
WITH s AS (SELECT subject, idx, temp, 20 AS k, 5 AS st, count(*) OVER (PARTITION BY subject) AS n FROM ({T.SAMPLES_SQL}) x),
w AS (SELECT *, unnest(range(greatest(CAST(floor((idx - k) / 5e0) AS BIGINT) + 1, 0), CAST(floor(idx / 5e0) AS BIGINT) + 1)) AS win FROM s)
SELECT subject, win, count(*) AS n, round(avg(temp), 6) AS temp FROM w WHERE win * 5 < n - 20 GROUP BY subject, win""")
def _(spark, sf):
    w = W.count_windows(T.samples(spark, sf).select("subject", "idx", "temp"), ["subject"], ["idx"], size=20, step=5)
    return w.groupBy("subject", "win").agg(F.count("*").alias("n"), F.round(F.avg("temp"), 6).alias("temp"))


@query("window_moving_average", f"""
SELECT subject, idx, round(avg(eda) OVER w, 6) AS trend, round(eda - avg(eda) OVER w, 6) AS high_pass,
       round(sqrt(avg(eda * eda) OVER w), 6) AS rolling_rms,
       max(CASE WHEN eda > 2 THEN 1 ELSE 0 END) OVER w AS mask
FROM ({T.SAMPLES_SQL}) s WINDOW w AS (PARTITION BY subject ORDER BY idx ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)""")
def _(spark, sf):
    from pulsegrid.operators.signals import moving_average

    return moving_average(T.samples(spark, sf), ["subject"], "idx", "eda", half=4, mask=F.col("eda") > 2).select(
        "subject", "idx", *r6("trend", "high_pass", "rolling_rms"), "mask")


@query("window_gaps", """
SELECT user_id, event_id, (epoch_us(ts) // 1000) - lag((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events""")
def _(spark, sf):
    e = T.table(spark, sf, "events").select("user_id", "event_id", T.millis("ts").alias("t"))
    return Ordered(e, ["user_id"], ["t", "event_id"]).around(
        1, 0, lambda w: {"gap": F.col("t") - F.lag("t").over(w)}).rows.select("user_id", "event_id", "gap")


@query("window_standardised", f"""
SELECT subject, idx, round((temp - avg(temp) OVER w) / nullif(stddev_pop(temp) OVER w, 0), 6) AS z_temp
FROM ({T.SAMPLES_SQL}) s WINDOW w AS (PARTITION BY subject)""")
def _(spark, sf):
    return W.standardise(T.samples(spark, sf), ["subject"], ["temp"]).select("subject", "idx", *r6("z_temp"))


@query("join_daily_full_outer", """
WITH a AS (SELECT user_id, CAST(ts AS DATE) AS day, floor(avg(value) * 10 + 0.5e0) / 10e0 AS resting_hr FROM events
           WHERE event_type = 'click' GROUP BY ALL),
b AS (SELECT user_id, CAST(ts AS DATE) AS day, floor(avg(value) * 10 + 0.5e0) / 10e0 AS hrv FROM events
      WHERE event_type = 'view' GROUP BY ALL)
SELECT user_id, day, resting_hr, hrv FROM a FULL JOIN b USING (user_id, day)""")
def _(spark, sf):
    from pulsegrid.sources.exports import daily_context

    e = T.table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    rest = e.filter("event_type = 'click'").select("user_id", "day", "value")
    hrv = e.filter("event_type = 'view'").select("user_id", "day", "value")
    return daily_context(rest, hrv, ["user_id"], "day", "value").select("user_id", "day", "resting_hr", "hrv")
