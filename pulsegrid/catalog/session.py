"""Sessions over the beat view: every subject's beats cut into sessions of 600 s, each with phases of 180 s rest, 240 s
challenge and 180 s recovery. Time counts from the start of the session."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.catalog import query
from pulsegrid.catalog.activity import up
from pulsegrid.catalog.beat import CLEAN_SQL, features_sql, r6
from pulsegrid.operators import models as M
from pulsegrid.operators import sessions as S
from pulsegrid.plans import activity_tables as A
from pulsegrid.plans import tables as T

BEATS_SQL = f"""
SELECT session, seq, t_ms, CASE WHEN seq % 9 = 0 THEN NULL WHEN t_ms >= 180000 AND t_ms < 420000 THEN rr_ms * 4 // 5 ELSE rr_ms END AS rr_ms, 60 + seq % 20 AS hr
FROM (SELECT subject * 1000000 + t_ms // 600000 AS session, seq, t_ms % 600000 AS t_ms, rr_ms FROM ({T.BEATS_SQL}) b) s"""
PHASES_SQL = f"""
SELECT session, phase, a AS start_ms, b AS end_ms FROM (SELECT DISTINCT session FROM ({BEATS_SQL}) b) s,
 (VALUES ('rest', 0, 180000), ('challenge', 180000, 420000), ('recovery', 420000, 600000)) v(phase, a, b)"""
SERIES_SQL = f"""
SELECT session, CAST(floor(t_ms / 5000e0) AS BIGINT) * 5 + 2.5e0 AS t, {up('avg(h)')} AS hr FROM (
 SELECT *, CASE WHEN rr_ms > 0 THEN 60000e0 / rr_ms ELSE hr END AS h FROM ({BEATS_SQL}) b) x WHERE h > 30 AND h < 220 GROUP BY session, CAST(floor(t_ms / 5000e0) AS BIGINT)"""


def session_beats(spark, sf):
    t = F.col("t_ms")
    rr = F.when(F.col("seq") % 9 == 0, None).when((t >= 180000) & (t < 420000), F.floor(F.col("rr_ms") * 4 / F.lit(5))).otherwise(F.col("rr_ms"))
    session = F.col("subject") * 1000000 + F.floor(t / F.lit(600000.0))
    b = T.beats(spark, sf).select(session.alias("session"), "seq", (t % 600000).alias("t_ms"), "rr_ms")
    return b.select("session", "seq", "t_ms", rr.cast("long").alias("rr_ms"), (60 + F.col("seq") % 20).alias("hr"))


def phases(spark, sf):
    cells = F.array(*[F.struct(F.lit(p).alias("phase"), F.lit(a).alias("start_ms"), F.lit(b).alias("end_ms"))
                      for p, a, b in (("rest", 0, 180000), ("challenge", 180000, 420000), ("recovery", 420000, 600000))])
    return session_beats(spark, sf).select("session").distinct().select("session", F.inline(cells))


def starts(spark, sf):
    return S.phase_table(phases(spark, sf)).select("session", "t0")


@query("session_hr_series", SERIES_SQL)
def _(spark, sf):
    return S.hr_series(session_beats(spark, sf), starts(spark, sf))


PLACED_SQL = """
SELECT session, t_ms, rr_ms, unnest(range(greatest(CAST(floor((t_ms - {o} - 60000) / 15000e0) AS BIGINT) + 1, 0), CAST(floor((t_ms - {o}) / 15000e0) AS BIGINT) + 1)) * 15000 + {o} AS win_start FROM ({src}) b"""


@query("session_rmssd_series", f"""
SELECT f.session, {up('(win_start + 60000) / 1000e0', 0)} AS t, {up('rmssd')} AS rmssd FROM (
 {features_sql(PLACED_SQL.format(o=0, src=f'SELECT * FROM ({BEATS_SQL}) q WHERE rr_ms IS NOT NULL'), 'session, win_start', 't_ms', 'session, win_start, t_ms', '60')}) f
JOIN (SELECT session, max(t_ms) AS e FROM ({BEATS_SQL}) b WHERE rr_ms IS NOT NULL GROUP BY session) e USING (session) WHERE win_start + 60000 <= e AND rmssd IS NOT NULL""")
def _(spark, sf):
    return S.rmssd_series(session_beats(spark, sf), starts(spark, sf))


SUMMARY_SQL = f"""
WITH s AS ({SERIES_SQL}), a AS (SELECT session, floor(avg(CAST(round(hr * 10) AS BIGINT)) FILTER (WHERE t >= 60 AND t < 180) + 0.5e0) / 10e0 AS rest_hr, floor(avg(CAST(round(hr * 10) AS BIGINT)) FILTER (WHERE t >= 180 AND t < 420) + 0.5e0) / 10e0 AS challenge_hr,
 floor(avg(CAST(round(hr * 10) AS BIGINT)) FILTER (WHERE t >= 540 AND t < 600) + 0.5e0) / 10e0 AS recovery_end_hr FROM s GROUP BY session),
b AS (SELECT *, {up('challenge_hr - rest_hr')} AS hr_rise FROM a),
r AS (SELECT session, t, avg(hr) OVER (PARTITION BY session ORDER BY CAST(t * 1000 AS BIGINT) RANGE BETWEEN 14999 PRECEDING AND CURRENT ROW) AS roll FROM s WHERE t >= 410 AND t < 600),
h AS (SELECT session, {up('min(t) - 420', 0)} AS half FROM r JOIN b USING (session) WHERE hr_rise >= 3 AND t >= 420 AND roll <= rest_hr + hr_rise / 2 GROUP BY session)
"""


@query("session_summary_numbers", SUMMARY_SQL + f"""
SELECT u.session, rest_hr, challenge_hr, hr_rise, half AS recovery_half_time_s, recovery_end_hr
FROM (SELECT DISTINCT session FROM ({BEATS_SQL}) b) u LEFT JOIN b USING (session) LEFT JOIN h USING (session)""")
def _(spark, sf):
    return S.summary_numbers(S.hr_series(session_beats(spark, sf), starts(spark, sf)), phases(spark, sf))


@query("session_rest_readings", f"""
WITH b AS (SELECT * FROM ({BEATS_SQL}) b WHERE t_ms >= 60000 AND t_ms < 180000), n AS (SELECT session FROM b GROUP BY session HAVING count(rr_ms) >= 30),
f AS ({features_sql(PLACED_SQL.format(o=60000, src=f'SELECT * FROM ({BEATS_SQL}) q WHERE rr_ms IS NOT NULL AND t_ms >= 60000 AND t_ms < 180000'), 'session, win_start', 't_ms', 'session, win_start, t_ms', '60')})
SELECT session, win_start, round(hr_mean, 6) AS hr_mean, round(rmssd, 6) AS rmssd, round(sdnn, 6) AS sdnn FROM f
WHERE session IN (SELECT session FROM n) AND hr_mean IS NOT NULL AND win_start + 60000 <= 180000
UNION ALL SELECT session, win_start, round(avg(CASE WHEN hr BETWEEN 30 AND 220 THEN hr END), 6), NULL, NULL
FROM ({PLACED_SQL.format(o=60000, src='SELECT session, t_ms, rr_ms FROM b')}) p JOIN b USING (session, t_ms) WHERE session NOT IN (SELECT session FROM n) AND win_start + 60000 <= 180000
GROUP BY session, win_start HAVING count(*) >= 20""")
def _(spark, sf):
    return S.rest_readings(session_beats(spark, sf), phases(spark, sf)).select("session", "win_start", *r6("hr_mean", "rmssd", "sdnn"))


@query("session_smoothed_hr", f"""
SELECT session, t_ms, round(avg(h) OVER (PARTITION BY session ORDER BY t_ms RANGE BETWEEN 4999 PRECEDING AND CURRENT ROW), 6) AS hr_smooth
FROM (SELECT *, CASE WHEN rr_ms > 0 THEN 60000e0 / rr_ms ELSE hr END AS h FROM ({BEATS_SQL}) b) x""")
def _(spark, sf):
    return S.smoothed_hr(session_beats(spark, sf)).select("session", "t_ms", *r6("hr_smooth"))


@query("session_live_hr", f"""
SELECT session, t_ms, round(list_sort(list(60000e0 / rr_ms) OVER w)[len(list(rr_ms) OVER w) // 2 + 1], 6) AS live_hr
FROM ({BEATS_SQL}) b WHERE rr_ms IS NOT NULL WINDOW w AS (PARTITION BY session ORDER BY t_ms ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def _(spark, sf):
    return S.recent_median_hr(session_beats(spark, sf), ["session"]).select("session", "t_ms", *r6("live_hr"))


@query("session_assembled_phases", f"""
WITH s AS (SELECT session, seq, t_ms, CASE (seq // 40) % 3 WHEN 0 THEN 'rest' WHEN 1 THEN 'challenge' ELSE 'recovery' END AS phase, 'step' || seq % 7 AS kind FROM ({BEATS_SQL}) b),
n AS (SELECT s.*, coalesce(lead(t_ms) OVER (PARTITION BY session ORDER BY seq), 900000) AS e FROM s)
SELECT session, phase, min(t_ms) AS start_ms, max(e) AS end_ms, count(*) AS n_steps, min_by(kind, seq) AS first_kind FROM n GROUP BY session, phase""")
def _(spark, sf):
    b = session_beats(spark, sf)
    k = F.floor(F.col("seq") / F.lit(40)) % 3
    steps = b.select("session", "seq", F.col("t_ms").alias("start_ms"), F.when(k == 0, "rest").when(k == 1, "challenge").otherwise("recovery").alias("phase"),
                     F.concat(F.lit("step"), (F.col("seq") % 7).cast("string")).alias("kind"))
    stops = starts(spark, sf).select("session", F.lit(900000).cast("long").alias("stop_ms"))
    return S.assemble_phases(steps, stops)


@query("session_points_in_phases", f"""
SELECT b.session, phase, count(*) AS n, round(avg(hr), 6) AS hr FROM ({BEATS_SQL}) b JOIN ({PHASES_SQL}) p ON p.session = b.session AND t_ms >= start_ms AND t_ms < end_ms GROUP BY ALL""")
def _(spark, sf):
    from pulsegrid.operators.joins import in_interval

    d = in_interval(session_beats(spark, sf), phases(spark, sf), ["session"], t="t_ms", start="start_ms", end="end_ms")
    return d.groupBy("session", "phase").agg(F.count("*").alias("n"), F.round(F.avg("hr"), 6).alias("hr"))


@query("session_labelled_runs", f"SELECT user_id, run, CASE WHEN phase = 'challenge' THEN 1 ELSE 0 END AS y FROM ({A.RUNS_SQL}) r WHERE completed AND phase IN ('rest', 'challenge')")
def _(spark, sf):
    return S.labelled_runs(A.runs(spark, sf)).select("user_id", "run", "y")


PROBE_SQL = f"""
WITH p AS (SELECT user_id AS session, phase, ts, run, wpm, hold, corr, event FROM (SELECT *, 1 AS event FROM ({A.RUNS_SQL}) r) x),
a AS (SELECT session, arg_min(wpm, (ts, run)) AS w, arg_min(hold, (ts, run)) AS h, arg_min(coalesce(corr, -1), (ts, run)) AS c FROM p WHERE phase = 'rest' GROUP BY session),
b AS (SELECT session, arg_min(wpm, (ts, run)) AS w, arg_min(hold, (ts, run)) AS h, arg_min(coalesce(corr, -1), (ts, run)) AS c FROM p WHERE phase = 'challenge' GROUP BY session),
d AS (SELECT session, 0 AS rk, 'typing speed' AS l, (b.w - a.w) / CAST(abs(a.w) AS DOUBLE) AS rel FROM a JOIN b USING (session)
 UNION ALL SELECT session, 1, 'key hold', (b.h - a.h) / abs(a.h) FROM a JOIN b USING (session)
 UNION ALL SELECT session, 3, 'corrections', CASE WHEN a.c > 0 AND b.c >= 0 THEN (b.c - a.c) / CAST(a.c AS DOUBLE) END FROM a JOIN b USING (session)),
g AS (SELECT session, list(l || ' ' || CAST(CAST(floor(abs(rel) * 100 + 0.5e0) AS BIGINT) AS VARCHAR) || '% ' || CASE WHEN rel > 0 THEN 'higher' ELSE 'lower' END ORDER BY abs(rel) DESC, rk) FILTER (WHERE abs(rel) >= 0.1e0) AS w FROM d GROUP BY session)
SELECT session, CASE WHEN w IS NULL THEN 'Your typing was about the same under challenge as at rest.' ELSE 'Under challenge, your typing changed: ' || array_to_string(w[1:2], ', ') || ' than at rest.' END AS probe_text FROM g"""


@query("session_probe_change", PROBE_SQL)
def _(spark, sf):
    r = A.runs(spark, sf).withColumnRenamed("session", "day").withColumnRenamed("user_id", "session")
    r = r.withColumn("started_ms", F.struct("started_ms", "run"))
    return S.probe_changes(r)


@query("session_summary_text", SUMMARY_SQL + f"""
, i AS (SELECT DISTINCT session, CASE WHEN session % 4 = 0 THEN NULL ELSE 'Strap' END AS device, session % 5 = 0 AS aborted FROM ({BEATS_SQL}) b),
x AS (SELECT i.*, CASE WHEN session % 4 = 0 THEN NULL ELSE rest_hr END AS rest_hr, CASE WHEN session % 4 = 0 THEN NULL ELSE challenge_hr END AS challenge_hr, CASE WHEN session % 4 = 0 THEN NULL ELSE hr_rise END AS hr_rise, half, recovery_end_hr FROM i LEFT JOIN b USING (session) LEFT JOIN h USING (session))
SELECT session, concat_ws(' ',
 CASE WHEN hr_rise IS NULL AND device IS NULL THEN 'No heart-rate device was connected, so only the activities were measured.' WHEN hr_rise IS NULL THEN 'Too few beats came through from ' || device || ' to compare the phases.'
  WHEN hr_rise >= 3 THEN 'Your heart rate rose ' || CAST(floor(hr_rise + 0.5e0) AS BIGINT) || ' bpm during the challenge, from ' || CAST(floor(rest_hr + 0.5e0) AS BIGINT) || ' at rest to ' || CAST(floor(challenge_hr + 0.5e0) AS BIGINT) || '.'
  WHEN hr_rise <= -3 THEN 'Your heart rate was ' || CAST(floor(-hr_rise + 0.5e0) AS BIGINT) || ' bpm lower during the challenge than at rest (' || CAST(floor(challenge_hr + 0.5e0) AS BIGINT) || ' against ' || CAST(floor(rest_hr + 0.5e0) AS BIGINT) || ').'
  ELSE 'Your heart rate barely changed during the challenge (' || CAST(floor(rest_hr + 0.5e0) AS BIGINT) || ' at rest, ' || CAST(floor(challenge_hr + 0.5e0) AS BIGINT) || ' during).' END,
 CASE WHEN hr_rise IS NOT NULL AND half IS NOT NULL THEN 'It came halfway back down ' || CAST(half AS BIGINT) || ' seconds into paced breathing.'
  WHEN hr_rise >= 3 AND recovery_end_hr IS NOT NULL THEN 'By the end of paced breathing it was ' || CAST(floor(recovery_end_hr + 0.5e0) AS BIGINT) || ', ' || CASE WHEN recovery_end_hr - rest_hr > 3 THEN 'still above' ELSE 'back near' END || ' your resting level.' END,
 CASE WHEN aborted THEN 'You stopped during the recovery. That is fine; the parts you did are kept.' END) AS summary FROM x""")
def _(spark, sf):
    n = S.summary_numbers(S.hr_series(session_beats(spark, sf), starts(spark, sf)), phases(spark, sf))
    hide = F.col("session") % 4 == 0
    n = n.withColumns({c: F.when(~hide, F.col(c)) for c in ("rest_hr", "challenge_hr", "hr_rise")})
    info = starts(spark, sf).select("session", F.when(~hide, "Strap").alias("device"), (F.col("session") % 5 == 0).alias("aborted"), F.lit("recovery").alias("last_phase"))
    probes = info.select("session", F.lit(None).cast("string").alias("probe_text"))
    return S.summary_text(n, probes, info)


@query("session_shown_range", f"""
WITH b AS (SELECT session, t_ms, hr FROM ({BEATS_SQL}) b), q AS (SELECT session, list_sort(list(hr))[CAST(floor((count(*) - 1) * 0.03e0) AS BIGINT) + 1] AS lo, list_sort(list(hr))[CAST(floor((count(*) - 1) * 0.97e0) AS BIGINT) + 1] AS hi FROM b GROUP BY session)
SELECT session, t_ms, CAST(least(greatest(hr, lo), hi) AS DOUBLE) AS hr_shown FROM b JOIN q USING (session)""")
def _(spark, sf):
    return S.clip_to_percentiles(session_beats(spark, sf).select("session", "t_ms", "hr"), ["session"], "hr").select("session", "t_ms", "hr_shown")
