"""Activity metrics and change against calm runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.catalog import query
from pulsegrid.operators import activities as A
from pulsegrid.plans import activity_tables as T


def up(x: str, d: int = 1) -> str:
    """Half up to d decimals."""
    return f"floor(({x}) * {10 ** d}e0 + 0.5e0) / {10 ** d}e0"


@query("activity_typing", f"""
WITH ev AS ({T.KEYS_SQL}),
k AS (SELECT *, lag(kind) OVER (PARTITION BY run, key ORDER BY seq) AS prev FROM ev WHERE kind IN ('down', 'up')),
f AS (SELECT *, kind = 'down' AND coalesce(prev, 'up') = 'up' AS fresh FROM k),
h AS (SELECT *, CASE WHEN kind = 'up' AND prev = 'down' THEN t_ms - last_value(CASE WHEN fresh THEN t_ms END IGNORE NULLS) OVER (PARTITION BY run, key ORDER BY seq) END AS hold,
      CASE WHEN fresh THEN t_ms - last_value(CASE WHEN kind = 'up' THEN t_ms END IGNORE NULLS) OVER (PARTITION BY run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS flight FROM f),
ka AS (SELECT run, avg(hold) FILTER (WHERE hold < 1500) AS hm, stddev_samp(hold) FILTER (WHERE hold < 1500) AS hs,
       avg(flight) FILTER (WHERE flight >= 0 AND flight < 2000) AS fm, stddev_samp(flight) FILTER (WHERE flight >= 0 AND flight < 2000) AS fs FROM h GROUP BY run),
i AS (SELECT *, coalesce(lag(length(value)) OVER (PARTITION BY run ORDER BY seq), 0) AS pl FROM ev WHERE kind = 'input'),
n AS (SELECT *, greatest(length(value) - pl, 0) AS nn, len(list_filter(range(pl + 1, length(value) + 1), lambda j: substr(value, j, 1) <> substr('{T.PASSAGE}', j, 1))) AS wrong FROM i),
g AS (SELECT *, CASE WHEN nn > 0 THEN t_ms - last_value(CASE WHEN nn > 0 THEN t_ms END IGNORE NULLS) OVER (PARTITION BY run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS gap FROM n),
a AS (SELECT run, sum(nn) AS typed, sum(wrong) AS bad, count_if(length(value) < pl) AS corrections, count_if(gap > 2000) AS pauses,
      avg(gap) FILTER (WHERE gap > 0 AND gap <= 2000) AS im, stddev_samp(gap) FILTER (WHERE gap > 0 AND gap <= 2000) AS iss, median(gap) FILTER (WHERE gap > 0 AND gap <= 2000) AS imed,
      (max_by(t_ms, seq) - min_by(t_ms, seq)) / 60000e0 AS mins, max_by(value, seq) AS v FROM g GROUP BY run),
o AS (SELECT *, CASE WHEN starts_with('{T.PASSAGE}', v) THEN length(v) ELSE list_min(list_filter(range(1, length(v) + 1), lambda j: substr(v, j, 1) <> substr('{T.PASSAGE}', j, 1))) - 1 END AS ok FROM a)
SELECT run, CASE WHEN mins > 0 THEN {up('ok / 5e0 / mins')} END AS wpm, {up('hm')} AS hold_mean_ms, {up('hs')} AS hold_sd_ms, {up('fm')} AS flight_mean_ms, {up('fs')} AS flight_sd_ms,
       {up('im')} AS inter_key_mean_ms, {up('iss')} AS inter_key_sd_ms, {up('iss / im', 3)} AS inter_key_cv, {up('imed')} AS inter_key_median_ms,
       {up('bad / CAST(nullif(typed, 0) AS DOUBLE)', 3)} AS error_rate, corrections, pauses, typed AS chars_typed, {up(f"ok / CAST(length('{T.PASSAGE}') AS DOUBLE)", 3)} AS progress
FROM o LEFT JOIN ka USING (run)""")
def _(spark, sf):
    return A.typing_metrics(*T.typing(spark, sf))


@query("activity_tracking", f"""
WITH s AS ({T.TRACK_SQL}), x AS (SELECT * FROM s JOIN (SELECT run, min(t_ms) + 1000 AS t0 FROM s GROUP BY run) m USING (run) WHERE t_ms >= t0),
e AS (SELECT *, sqrt((px - tx) * (px - tx) + (py - ty) * (py - ty)) AS err, CASE WHEN px - tx > 0.04e0 THEN 1 WHEN px - tx < -0.04e0 THEN -1 END AS sx,
      CASE WHEN py - ty > 0.04e0 THEN 1 WHEN py - ty < -0.04e0 THEN -1 END AS sy FROM x),
l AS (SELECT *, last_value(sx IGNORE NULLS) OVER w AS lx, last_value(sy IGNORE NULLS) OVER w AS ly FROM e WINDOW w AS (PARTITION BY run ORDER BY t_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a AS (SELECT run, count(*) AS n, avg(err) AS m, avg(err * err) AS m2, avg(CASE WHEN err <= 0.04e0 THEN 1e0 ELSE 0e0 END) AS onn,
      count_if(sx <> lx) + count_if(sy <> ly) AS flips, (max(t_ms) - min(t_ms)) / 60000e0 AS mins FROM l GROUP BY run HAVING count(*) >= 10),
g AS (SELECT run, t0 + unnest(range(0, CAST(floor((t1 - t0) / 20e0) AS BIGINT) + 1)) * 20 AS t FROM (SELECT run, min(t_ms) AS t0, max(t_ms) AS t1 FROM x GROUP BY run) z),
p1 AS (SELECT g.run, g.t, c.t_ms AS ta, c.px AS xa, c.py AS ya FROM g ASOF JOIN x c ON c.run = g.run AND g.t >= c.t_ms),
p2 AS (SELECT p1.*, c.t_ms AS tb, c.px AS xb, c.py AS yb FROM p1 ASOF JOIN x c ON c.run = p1.run AND p1.t <= c.t_ms),
p AS (SELECT run, t, CASE WHEN tb = ta THEN xa ELSE xa + (xb - xa) * ((t - ta) / CAST(tb - ta AS DOUBLE)) END AS x, CASE WHEN tb = ta THEN ya ELSE ya + (yb - ya) * ((t - ta) / CAST(tb - ta AS DOUBLE)) END AS y FROM p2),
sm AS (SELECT run, t, avg(x) OVER w AS x, avg(y) OVER w AS y FROM p WINDOW w AS (PARTITION BY run ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
j AS (SELECT run, sqrt(pow((x - 3 * lag(x, 1) OVER o + 3 * lag(x, 2) OVER o - lag(x, 3) OVER o) * 125000, 2) + pow((y - 3 * lag(y, 1) OVER o + 3 * lag(y, 2) OVER o - lag(y, 3) OVER o) * 125000, 2)) AS jk
      FROM sm WINDOW o AS (PARTITION BY run ORDER BY t)),
md AS (SELECT run, median(jk) AS jerk FROM j GROUP BY run)
SELECT run, {up('m * 100', 2)} AS mean_error_pct, {up('sqrt(m2) * 100', 2)} AS rms_error_pct, {up('onn * 100')} AS on_target_pct, {up('jerk')} AS jerk,
       CASE WHEN mins > 0 THEN {up('flips / mins')} END AS over_corrections_per_min FROM a LEFT JOIN md USING (run)""")
def _(spark, sf):
    return A.tracking_metrics(T.tracking(spark, sf))


@query("activity_taps", f"""
WITH t AS ({T.TAPS_SQL}), p AS (SELECT p.*, t.tx, t.ty, t.r, t.sx, t.sy, t.shown, t.tap_t, sqrt(pow(p.x - tx, 2) + pow(p.y - ty, 2)) <= r AS inside,
  sqrt(pow(p.x - sx, 2) + pow(p.y - sy, 2)) > 0.01e0 AS moved, sqrt(pow(tx - sx, 2) + pow(ty - sy, 2)) AS d,
  ((p.x - sx) * (tx - sx) + (p.y - sy) * (ty - sy)) / sqrt(pow(tx - sx, 2) + pow(ty - sy, 2)) AS along
  FROM ({T.TAP_PATH_SQL}) p JOIN t ON t.run = p.run AND t.trial = p.trial WHERE t.pointer <> 'touch'),
q AS (SELECT *, inside AND NOT coalesce(lag(inside) OVER (PARTITION BY run, trial ORDER BY k), FALSE) AS entry FROM p),
m AS (SELECT run, trial, min(t) FILTER (WHERE moved) AS st, max_by(inside, k) AS ends, max(t) FILTER (WHERE entry) AS ent, max(along) AS al, max(d) AS d, max(r) AS r FROM q GROUP BY run, trial),
x AS (SELECT t.run, t.trial, sqrt(pow(tap_x - tx, 2) + pow(tap_y - ty, 2)) AS miss, t.r, tap_t - shown AS total, m.trial IS NOT NULL AS haspath, st - shown AS reaction, tap_t - st AS mt,
  CASE WHEN st IS NOT NULL AND ends THEN tap_t - ent END AS dwell, CASE WHEN st IS NOT NULL AND al > d + m.r THEN 1 ELSE 0 END AS ov,
  CASE WHEN st IS NOT NULL AND tap_t - st > 0 THEN log2(d / (2 * m.r) + 1) / ((tap_t - st) / 1000e0) END AS bits FROM t LEFT JOIN m ON m.run = t.run AND m.trial = t.trial)
SELECT run, count(*) AS trials, {up('avg(CASE WHEN miss <= r THEN 1e0 ELSE 0e0 END) * 100')} AS accuracy_pct, {up('median(total)')} AS time_to_tap_ms, {up('stddev_samp(total)')} AS time_to_tap_sd_ms,
 {up('avg(miss / r)', 2)} AS error_radii, {up('median(reaction)')} AS reaction_ms, {up('median(mt)')} AS movement_ms, {up('median(dwell)')} AS hesitation_ms,
 {up('sum(ov) / CAST(nullif(count_if(haspath), 0) AS DOUBLE) * 100')} AS overshoot_pct, {up('avg(bits)', 2)} AS throughput_bits FROM x GROUP BY run""")
def _(spark, sf):
    return A.tap_metrics(T.taps(spark, sf))


@query("activity_words", f"""
WITH w AS ({T.WORDS_SQL}), a AS (SELECT run, count(*) AS trials, median(rt_ms) FILTER (WHERE congruent AND answer = ink) AS c, median(rt_ms) FILTER (WHERE NOT congruent AND answer = ink) AS i,
 avg(CASE WHEN answer IS NULL THEN NULL WHEN answer <> ink THEN 1e0 ELSE 0e0 END) AS er, count_if(NOT congruent AND answer <> ink) AS incongruent_errors, count_if(answer IS NULL) AS missed FROM w GROUP BY run)
SELECT run, trials, {up('c')} AS rt_congruent_ms, {up('i')} AS rt_incongruent_ms, {up('i - c')} AS interference_ms, {up('er', 3)} AS error_rate, incongruent_errors, missed FROM a""")
def _(spark, sf):
    return A.word_metrics(T.words(spark, sf))


@query("activity_arithmetic", f"""
WITH RECURSIVE s AS ({T.SUMS_SQL}), walk AS (
 SELECT run, seq, correct, rt_ms, timed_out, stopped_early, 2 AS level FROM s WHERE seq = 1
 UNION ALL SELECT s.run, s.seq, s.correct, s.rt_ms, s.timed_out, s.stopped_early, least(10, greatest(1, w.level + CASE WHEN w.correct THEN 1 ELSE -1 END))
 FROM walk w JOIN s ON s.run = w.run AND s.seq = w.seq + 1)
SELECT run, count(*) AS problems, {up('avg(CASE WHEN correct THEN 1e0 ELSE 0e0 END)', 3)} AS accuracy, {up('avg(rt_ms) FILTER (WHERE correct)')} AS mean_rt_ms, {up('avg(level)', 2)} AS mean_level,
 least(10, greatest(1, max_by(level, seq) + CASE WHEN max_by(correct, seq) THEN 1 ELSE -1 END)) AS final_level, count_if(timed_out) AS timeouts, max(CASE WHEN stopped_early THEN 1 ELSE 0 END) AS stopped_early
FROM walk GROUP BY run""")
def _(spark, sf):
    return A.arithmetic_metrics(T.sums(spark, sf))


BREATH = f"""
WITH b AS (SELECT *, t_ms / 1000e0 AS s, CASE WHEN rr_ms > 0 THEN 60000e0 / rr_ms ELSE hr END AS h, 50 AS done FROM ({T.BREATH_SQL}) z),
i AS (SELECT * FROM b WHERE t_ms <= done * 1000), v AS (SELECT * FROM i WHERE h > 30 AND h < 220),
w AS (SELECT run, CAST(floor(s / 10e0) AS BIGINT) AS breath, max(h) - min(h) AS swing FROM v WHERE (floor(s / 10e0) + 1) * 10 <= done GROUP BY ALL HAVING count(*) >= 4)"""


@query("activity_breathing", BREATH + f""",
n AS (SELECT run, count(*) AS n FROM i GROUP BY run), e AS (SELECT run, avg(h) FILTER (WHERE s < 30) AS a, avg(h) FILTER (WHERE s > done - 30) AS b FROM v GROUP BY run), r AS (SELECT run, avg(swing) AS rsa FROM w GROUP BY run)
SELECT u.run, 5 AS breaths, {up('50 / 60e0 * 100', 0)} AS completed_pct, CASE WHEN n >= 5 THEN {up('a')} END AS hr_start,
 CASE WHEN n >= 5 THEN {up('b')} END AS hr_end, CASE WHEN n >= 5 THEN {up('b - a')} END AS hr_change, CASE WHEN n >= 5 THEN {up('rsa')} END AS rsa_bpm
FROM (SELECT DISTINCT run FROM b) u LEFT JOIN n USING (run) LEFT JOIN e USING (run) LEFT JOIN r USING (run)""")
def _(spark, sf):
    return A.breathing_metrics(*T.breathing(spark, sf))


@query("activity_last_breath", BREATH + " SELECT run, round(max_by(swing, breath), 6) AS swing FROM w GROUP BY run")
def _(spark, sf):
    return A.last_swing(*T.breathing(spark, sf)).select("run", F.round("swing", 6).alias("swing"))


@query("activity_tremor", f"""
WITH s AS ({T.MOTION_SQL}), r AS (SELECT run, count(*) AS n, (count(*) - 1) / ((max(t_ms) - min(t_ms)) / 1000e0) AS fs FROM s GROUP BY run HAVING count(*) >= 32),
h AS (SELECT s.*, n, fs, greatest(1, CAST(floor(fs * 0.25e0 + 0.5e0) AS BIGINT)) AS half FROM s JOIN r USING (run)),
m AS (SELECT h.run, h.seq, h.fs, h.x - avg(q.x) AS x, h.y - avg(q.y) AS y, h.z - avg(q.z) AS z FROM h JOIN s q ON q.run = h.run AND q.seq BETWEEN h.seq - half AND h.seq + half GROUP BY h.run, h.seq, h.fs, h.x, h.y, h.z),
d AS (SELECT *, sqrt(x * x + y * y + z * z) AS mag, x + y + z AS sig FROM m),
p AS (SELECT run, f, pow(sum(sig * cos(2 * pi() * f * (seq - 1) / fs)), 2) + pow(sum(sig * sin(2 * pi() * f * (seq - 1) / fs)), 2) AS p FROM d, (SELECT 2 + unnest(range(0, 53)) * 0.25e0 AS f) fr WHERE f <= fs / 2 - 0.5e0 GROUP BY run, f),
sp AS (SELECT run, max_by(f, p) AS peak, sum(CASE WHEN f BETWEEN 8 AND 12 THEN p ELSE 0 END) / sum(p) AS band FROM p GROUP BY run),
a AS (SELECT run, sqrt(avg(mag * mag)) AS rms, list_sort(list(mag))[CAST(floor(count(*) * 0.95e0) AS BIGINT) + 1] AS p95, max(fs) AS fs FROM d GROUP BY run)
SELECT run, {up('rms', 3)} AS rms, {up('p95', 3)} AS p95, {up('peak', 2)} AS peak_hz, {up('band', 3)} AS band_share, {up('fs', 0)} AS sample_hz FROM a LEFT JOIN sp USING (run)""")
def _(spark, sf):
    return A.tremor_metrics(T.motion(spark, sf))


@query("activity_rhythm", f"""
WITH t AS ({T.RHYTHM_SQL}), n AS (SELECT p.run, p.seq, p.t_ms - b.t_ms AS gap, row_number() OVER (PARTITION BY p.run, p.seq ORDER BY abs(p.t_ms - b.t_ms), b.t_ms) AS k
 FROM t p LEFT JOIN t b ON b.run = p.run AND b.kind = 'beat' WHERE p.kind = 'paced'),
s AS (SELECT run, count(*) AS c, avg(gap) FILTER (WHERE abs(gap) < 375) AS am, stddev_samp(gap) FILTER (WHERE abs(gap) < 375) AS asd FROM n WHERE k = 1 GROUP BY run),
f AS (SELECT run, seq, t_ms - lag(t_ms) OVER (PARTITION BY run ORDER BY seq) AS iv FROM t WHERE kind = 'free'),
g AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY seq) AS k FROM f WHERE iv > 300 AND iv < 1650),
a AS (SELECT run, avg(iv) AS m, stddev_samp(iv) AS sd, count(*) AS n, regr_slope(iv, k) AS sl, median(iv) AS md FROM g GROUP BY run),
fc AS (SELECT run, count(*) AS c FROM f GROUP BY run)
SELECT u.run, coalesce(s.c, 0) AS paced_taps, {up('am')} AS async_mean_ms, {up('asd')} AS async_sd_ms, coalesce(fc.c, 0) AS free_taps, {up('m')} AS interval_mean_ms, {up('md')} AS interval_median_ms,
 {up('sd / m', 3)} AS interval_cv, CASE WHEN n >= 3 THEN {up('sl', 2)} END AS drift_ms_per_tap, {up('(m - 750) / 750e0 * 100')} AS tempo_error_pct
FROM (SELECT DISTINCT run FROM t) u LEFT JOIN s USING (run) LEFT JOIN a USING (run) LEFT JOIN fc USING (run)""")
def _(spark, sf):
    return A.rhythm_metrics(T.rhythm(spark, sf))


LONG_SQL = " UNION ALL ".join(
    f"SELECT user_id, run, activity, completed, phase, '{k}' AS key, CAST({c} AS DOUBLE) AS v FROM ({T.RUNS_SQL}) r WHERE {c} IS NOT NULL"
    for k, c in (("wpm", "wpm"), ("holdMeanMs", "hold"), ("corrections", "corr")))
CALM_SQL = f"""
WITH l AS ({LONG_SQL}), b AS (SELECT user_id, activity, key, avg(v) AS m, stddev_samp(v) AS s FROM l WHERE phase = 'rest' AND completed GROUP BY ALL HAVING count(*) >= 2),
z AS (SELECT l.user_id, l.run, l.activity, l.key, {up('(v - m) / greatest(coalesce(s, 0), abs(m) * 0.1e0, 1e-6)', 2)} AS z FROM l JOIN b USING (user_id, activity, key) WHERE l.phase = 'challenge')"""


def _z(spark, sf):
    runs = T.runs(spark, sf)
    calm = A.calm_runs(runs.filter("phase = 'none'").drop("phase"), runs)
    return A.vs_calm(runs.filter("phase = 'challenge'"), calm)


@query("activity_vs_calm", CALM_SQL + " SELECT user_id, run, activity, key, z FROM z")
def _(spark, sf):
    return _z(spark, sf)


@query("activity_change_words", CALM_SQL + """
SELECT run, key, CASE WHEN abs(z) < 1 THEN 'About your usual' WHEN abs(z) < 2 THEN 'Slightly ' || w || ' than usual' ELSE upper(w[1]) || w[2:] || ' than usual' END AS words
FROM (SELECT *, CASE key WHEN 'wpm' THEN CASE WHEN z > 0 THEN 'faster' ELSE 'slower' END WHEN 'holdMeanMs' THEN CASE WHEN z > 0 THEN 'longer holds' ELSE 'shorter holds' END
 ELSE CASE WHEN z > 0 THEN 'more corrections' ELSE 'fewer corrections' END END AS w FROM z) y""")
def _(spark, sf):
    return A.change_words(_z(spark, sf)).select("run", "key", "words")


@query("activity_change_summary", CALM_SQL + """
SELECT run, coalesce(array_to_string(list(w ORDER BY abs(z) DESC, rk) FILTER (WHERE abs(z) >= 1 AND k <= 2), ', '), 'about usual') AS change
FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY abs(z) DESC, rk) AS k FROM (SELECT *, CASE key WHEN 'wpm' THEN 0 WHEN 'holdMeanMs' THEN 1 ELSE 3 END AS rk, CASE key WHEN 'wpm' THEN CASE WHEN z > 0 THEN 'faster' ELSE 'slower' END WHEN 'holdMeanMs' THEN CASE WHEN z > 0 THEN 'longer holds' ELSE 'shorter holds' END
 ELSE CASE WHEN z > 0 THEN 'more corrections' ELSE 'fewer corrections' END END AS w FROM z) y) x GROUP BY run""")
def _(spark, sf):
    return A.change_summary(_z(spark, sf)).select("run", "change")


@query("activity_metric_map", f"""
SELECT run, (CASE WHEN rc IS NULL THEN 0 ELSE 1 END) + (CASE WHEN ri IS NULL THEN 0 ELSE 1 END) + (CASE WHEN rc IS NULL OR ri IS NULL THEN 0 ELSE 1 END) + (CASE WHEN er IS NULL THEN 0 ELSE 1 END) + 3 AS n_metrics,
       rc AS rt_congruent FROM (SELECT run, {up('median(rt_ms) FILTER (WHERE congruent AND answer = ink)')} AS rc, median(rt_ms) FILTER (WHERE NOT congruent AND answer = ink) AS ri,
       avg(CASE WHEN answer IS NULL THEN NULL ELSE 1 END) AS er FROM ({T.WORDS_SQL}) w GROUP BY run) m""")
def _(spark, sf):
    m = A.metric_map(A.word_metrics(T.words(spark, sf)), ["run"])
    return m.select("run", F.size("metrics").alias("n_metrics"), F.expr("try_element_at(metrics, 'rtCongruentMs')").alias("rt_congruent"))
