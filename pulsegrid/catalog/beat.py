"""Beat series, windows, calibration and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid import constants as K
from pulsegrid.catalog import query
from pulsegrid.functions.scalar import LOGIT_LIMIT
from pulsegrid.operators import beats as B
from pulsegrid.operators import calibrate as C
from pulsegrid.operators import score as S
from pulsegrid.operators import windows as W
from pulsegrid.plans import tables as T
from pulsegrid.plans.flows import beat_scores, beat_window_features


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def sql6(*names):
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


CLEAN_SQL = f"""
SELECT *, ok_range AND (n_near < 2 OR abs(rr_ms - med) <= 0.2e0 * med) AS kept FROM (
 SELECT *, median(rr_ms) OVER w AS med, count(*) OVER w AS n_near FROM (
  SELECT {{cols}}, rr_ms, rr_ms BETWEEN 300 AND 2000 AS ok_range FROM ({{src}}) s) a
 WINDOW w AS (PARTITION BY {{key}}, ok_range ORDER BY {{order}} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING
              EXCLUDE CURRENT ROW)) b
"""

PLACED_SQL = f"""
SELECT subject, t_ms, rr_ms, unnest(range(greatest(CAST(floor((t_ms - 60000) / 15000e0) AS BIGINT) + 1, 0),
       CAST(floor(t_ms / 15000e0) AS BIGINT) + 1)) * 15000 AS win_start FROM ({T.BEATS_SQL}) b
"""


def features_sql(src: str, key: str, order: str, cols: str, duration_s: str) -> str:
    clean = CLEAN_SQL.format(src=src, key=key, order=order, cols=cols)
    return f"""
SELECT {key}, CASE WHEN cov >= 0.4e0 THEN 60000e0 / m END AS hr_mean,
       CASE WHEN cov >= 0.6e0 AND np >= 10 THEN sqrt(msd) END AS rmssd,
       CASE WHEN cov >= 0.6e0 AND np >= 10 THEN s END AS sdnn, n_beats, n_clean, cov AS coverage,
       (n_beats - n_clean) / CAST(n_beats AS DOUBLE) AS rejected, cov >= 0.4e0 AS hr_valid,
       cov >= 0.6e0 AND np >= 10 AS hrv_valid
FROM (SELECT *, CASE WHEN n_clean < 3 THEN 0e0
                ELSE least(n_clean / ({duration_s} * 1000e0 / med_c), 1.5e0) END AS cov FROM (
 SELECT {key}, count(*) AS n_beats, count(c) AS n_clean, avg(c) AS m, stddev_samp(c) AS s, count(dd) AS np,
        avg(CAST(dd AS DOUBLE) * dd) AS msd, median(c) AS med_c, sum(rr_ms) / 1000e0 AS sum_s FROM (
  SELECT *, CASE WHEN kept THEN CAST(rr_ms AS DOUBLE) END AS c,
         CASE WHEN kept AND lag(kept) OVER o THEN rr_ms - lag(rr_ms) OVER o END AS dd
  FROM ({clean}) k WINDOW o AS (PARTITION BY {key} ORDER BY {order})) d GROUP BY {key}) f) g
"""


WINDOW_FEATURES_SQL = f"""
SELECT f.* FROM ({features_sql(PLACED_SQL, 'subject, win_start', 't_ms', 'subject, win_start, t_ms', '60')}) f
JOIN (SELECT subject, max(t_ms) AS t_end FROM ({T.BEATS_SQL}) b GROUP BY subject) e USING (subject)
WHERE win_start + 60000 <= t_end
"""

SERIES_FEATURES_SQL = features_sql(T.BEATS_SQL, "subject", "t_ms", "subject, t_ms", "sum_s")


@query("beat_times", T.BEATS_SQL)
def _(spark, sf):
    return T.beats(spark, sf)


@query("beat_clean_live", f"SELECT subject, seq, rr_ms, kept FROM ("
       f"{CLEAN_SQL.format(src=T.BEATS_SQL, key='subject', order='seq', cols='subject, seq')}) c")
def _(spark, sf):
    return B.clean_rr(T.beats(spark, sf), ["subject"], ["seq"]).select("subject", "seq", "rr_ms", "kept")


@query("beat_window_features", f"""
SELECT subject, win_start, {sql6('hr_mean', 'rmssd', 'sdnn')}, n_beats, n_clean, {sql6('coverage', 'rejected')},
       hr_valid, hrv_valid FROM ({WINDOW_FEATURES_SQL}) f""")
def _(spark, sf):
    return beat_window_features(T.beats(spark, sf)).select(
        "subject", "win_start", *r6("hr_mean", "rmssd", "sdnn"), "n_beats", "n_clean",
        *r6("coverage", "rejected"), "hr_valid", "hrv_valid")


@query("beat_quality", f"""
SELECT subject, win_start,
 CASE WHEN n_clean < 3 THEN 'poor' WHEN coverage >= 0.9e0 AND rejected <= 0.05e0 THEN 'good'
      WHEN coverage >= 0.6e0 AND rejected <= 0.2e0 THEN 'fair' ELSE 'poor' END AS quality,
 CASE WHEN n_clean < 3 THEN 'Too few clean beats' WHEN coverage >= 0.9e0 AND rejected <= 0.05e0 THEN NULL
      WHEN coverage >= 0.6e0 AND rejected <= 0.2e0 THEN
        CASE WHEN rejected > 0.05e0 THEN share ELSE 'Some beats were missed' END
      WHEN coverage < 0.6e0 THEN 'Many beats were missed' ELSE share END AS why
FROM (SELECT *, CAST(CAST(floor(rejected * 100 + 0.5e0) AS BIGINT) AS VARCHAR)
      || '% of beats looked wrong and were left out' AS share FROM ({WINDOW_FEATURES_SQL}) f) g""")
def _(spark, sf):
    return B.beat_quality(beat_window_features(T.beats(spark, sf))).select("subject", "win_start", "quality", "why")


@query("beat_series_features", f"""
SELECT subject, {sql6('hr_mean', 'rmssd', 'sdnn')}, n_beats, n_clean, {sql6('coverage', 'rejected')},
       hr_valid, hrv_valid FROM ({SERIES_FEATURES_SQL}) f""")
def _(spark, sf):
    return B.beat_features(T.beats(spark, sf), ["subject"], ["t_ms"], duration_s=None, bounded=False).select(
        "subject", *r6("hr_mean", "rmssd", "sdnn"), "n_beats", "n_clean", *r6("coverage", "rejected"),
        "hr_valid", "hrv_valid")


@query("beat_features_ungated", f"""
SELECT subject, CASE WHEN n >= 10 THEN round(60000e0 / m, 6) END AS hr_mean,
       CASE WHEN n >= 10 THEN round(sqrt(msd), 6) END AS rmssd, CASE WHEN n >= 10 THEN round(s, 6) END AS sdnn,
       CASE WHEN n >= 10 THEN n END AS n, CASE WHEN n >= 10 THEN n_beats - n END AS dropped
FROM (SELECT subject, count(*) AS n_beats, count(c) AS n, avg(c) AS m, stddev_samp(c) AS s,
             avg(CAST(dd AS DOUBLE) * dd) AS msd FROM (
  SELECT *, CASE WHEN kept THEN CAST(rr_ms AS DOUBLE) END AS c,
         CASE WHEN kept AND lag(kept) OVER o THEN rr_ms - lag(rr_ms) OVER o END AS dd
  FROM ({CLEAN_SQL.format(src=T.BEATS_SQL, key='subject', order='seq', cols='subject, seq')}) k
  WINDOW o AS (PARTITION BY subject ORDER BY seq)) d GROUP BY subject) f""")
def _(spark, sf):
    return B.beat_features(T.beats(spark, sf), ["subject"], ["seq"], bounded=False, gated=False).select(
        "subject", *r6("hr_mean", "rmssd", "sdnn"), "n", "dropped")


RESTING_SQL = f"""
SELECT subject, floor(avg(hr_mean) * 10 + 0.5e0) / 10e0 AS resting_hr FROM (
 SELECT subject, hr_mean, row_number() OVER (PARTITION BY subject ORDER BY hr_mean) AS k,
        count(*) OVER (PARTITION BY subject) AS n
 FROM ({WINDOW_FEATURES_SQL}) f WHERE hr_mean BETWEEN 30 AND 220) r
WHERE k <= greatest(1, n // 4) GROUP BY subject"""


@query("beat_resting_hr", f"""
SELECT s.subject, coalesce(r.resting_hr, floor(s.hr_mean * 10 + 0.5e0) / 10e0) AS resting_hr
FROM ({SERIES_FEATURES_SQL}) s LEFT JOIN ({RESTING_SQL}) r USING (subject)""")
def _(spark, sf):
    return B.resting_hr_from_beats(T.beats(spark, sf), ["subject"])


@query("beat_device_hr_trailing", f"""
SELECT subject, t_ms, CASE WHEN count(*) OVER w >= 5 THEN round(60000e0 / avg(rr_ms) OVER w, 6) END AS device_hr
FROM ({T.BEATS_SQL}) b WINDOW w AS (PARTITION BY subject ORDER BY t_ms RANGE BETWEEN 9999 PRECEDING AND CURRENT ROW)""")
def _(spark, sf):
    return B.rolling_rr_hr(T.beats(spark, sf), ["subject"], "t_ms", "rr_ms").select(
        "subject", "t_ms", *r6("device_hr"))


@query("beat_break_markers", f"""
SELECT subject, t_ms, CASE WHEN nbad = 0 THEN t_ms - pt END AS rr_ms FROM (
 SELECT b.subject, b.t_ms, b.pt, (SELECT count(*) FROM bad x WHERE x.subject = b.subject AND x.t_ms BETWEEN b.pt AND b.t_ms)
        AS nbad FROM (SELECT subject, t_ms, lag(t_ms) OVER (PARTITION BY subject ORDER BY t_ms) AS pt FROM bt) b
 WHERE pt IS NOT NULL) z""".join([f"WITH bt AS ({T.BEATS_SQL}), bad AS (SELECT subject, t_ms + 100 AS t_ms FROM bt "
                                  "WHERE rr_ms < 300) ", ""]))
def _(spark, sf):
    b = T.beats(spark, sf)
    bad = b.filter("rr_ms < 300").select("subject", (F.col("t_ms") + 100).alias("t_ms"), F.lit(True).alias("bad"))
    return B.break_markers(b.select("subject", "t_ms"), bad, ["subject"])


# -- training rules -----------------------------------------------------------------------------------

# the fold of the training rule as a recursive walk over each window's intervals
TRAIN_SQL = f"""
WITH RECURSIVE w AS (
 SELECT subject, win_start, t_ms, rr_ms / 1000e0 AS x,
        row_number() OVER (PARTITION BY subject, win_start ORDER BY t_ms) AS i FROM ({PLACED_SQL}) p),
g AS (SELECT subject, win_start, count(*) AS n,
             median(x) FILTER (WHERE x BETWEEN 0.33e0 AND 1.5e0) AS med,
             count(*) FILTER (WHERE x BETWEEN 0.33e0 AND 1.5e0) AS n_ok FROM w GROUP BY subject, win_start),
v AS (SELECT w.*, g.n, g.n_ok, abs(x - med) AS dev,
             x BETWEEN 0.33e0 AND 1.5e0 AND (n_ok < 3 OR abs(x - med) <= 0.3e0 * med) AS ok
      FROM w JOIN g USING (subject, win_start)),
walk AS (
 SELECT subject, win_start, i, x, dev, n_ok, ok AS cur, CAST(NULL AS BOOLEAN) AS prev_final FROM v WHERE i = 1
 UNION ALL
 SELECT v.subject, v.win_start, v.i, v.x, v.dev, v.n_ok,
        v.ok AND NOT (v.n_ok >= 3 AND v.ok AND k.cur AND abs(v.x - k.x) > 0.25e0 * k.x AND v.dev >= k.dev),
        k.cur AND NOT (v.n_ok >= 3 AND v.ok AND k.cur AND abs(v.x - k.x) > 0.25e0 * k.x AND v.dev < k.dev)
 FROM walk k JOIN v ON v.subject = k.subject AND v.win_start = k.win_start AND v.i = k.i + 1),
flags AS (
 SELECT subject, win_start, i, x, coalesce(lead(prev_final) OVER (PARTITION BY subject, win_start ORDER BY i), cur)
        AS clean FROM walk),
d AS (SELECT *, CASE WHEN clean AND lag(clean) OVER o THEN x - lag(x) OVER o END AS dd,
             CASE WHEN clean THEN x END AS c FROM flags WINDOW o AS (PARTITION BY subject, win_start ORDER BY i)),
f AS (SELECT subject, win_start, count(c) AS n, avg(c) AS m, stddev_samp(c) AS s, count(dd) AS np,
             avg(dd * dd) AS msd, avg(CASE WHEN abs(dd) > 0.05e0 THEN 1e0 WHEN dd IS NOT NULL THEN 0e0 END) AS big,
             CASE WHEN count(c) >= 3 THEN count(c) * median(c) / 60e0 ELSE 0 END AS cov FROM d GROUP BY subject, win_start)
SELECT subject, win_start, CASE WHEN cov >= 0.4e0 THEN round(60e0 / m, 6) END AS hr_mean,
       CASE WHEN cov >= 0.6e0 AND np >= 10 THEN round(sqrt(msd) * 1000, 6) END AS rmssd,
       CASE WHEN cov >= 0.6e0 AND np >= 10 THEN round(s * 1000, 6) END AS sdnn,
       CASE WHEN cov >= 0.6e0 AND np >= 10 THEN round(big * 100, 6) END AS pnn50,
       CASE WHEN n >= 3 THEN n ELSE 0 END AS n_beats, round(cov, 6) AS beat_coverage,
       cov >= 0.4e0 AS hr_valid, cov >= 0.6e0 AND np >= 10 AS hrv_valid
FROM f
"""


@query("beat_training_features", TRAIN_SQL)
def _(spark, sf):
    placed = W.assign_windows(T.beats(spark, sf), "t_ms")
    placed = placed.select("subject", "win_start", "t_ms", (F.col("rr_ms") / 1000.0).alias("ibi_s"))
    return B.training_features(placed, ["subject", "win_start"], "t_ms").select(
        "subject", "win_start", *r6("hr_mean", "rmssd", "sdnn", "pnn50"), "n_beats", *r6("beat_coverage"),
        "hr_valid", "hrv_valid")


# -- windows and labels -------------------------------------------------------------------------------

LABELS_SQL = f"""
SELECT subject, win_start, cond AS label, round(n / CAST(total AS DOUBLE), 6) AS label_frac FROM (
 SELECT subject, win_start, cond, n, sum(n) OVER (PARTITION BY subject, win_start) AS total,
        row_number() OVER (PARTITION BY subject, win_start ORDER BY n DESC, cond) AS k FROM (
  SELECT subject, win_start, 1 + CAST(floor(t_ms / 90000e0) AS BIGINT) % 3 AS cond, count(*) AS n
  FROM ({PLACED_SQL}) p GROUP BY ALL) c) r
WHERE k = 1 AND n / CAST(total AS DOUBLE) >= 0.8e0"""


@query("window_majority_label", LABELS_SQL)
def _(spark, sf):
    placed = W.assign_windows(T.beats(spark, sf), "t_ms")
    return W.majority_label(placed, ["subject", "win_start"], "cond").select(
        "subject", "win_start", "label", *r6("label_frac"))


@query("window_scored_runs", f"""
SELECT subject, run, min(win_start) AS run_start, max(win_start) AS run_end, count(*) AS n FROM (
 SELECT *, sum(new) OVER (PARTITION BY subject ORDER BY win_start) AS run FROM (
  SELECT *, CASE WHEN win_start - lag(win_start) OVER (PARTITION BY subject ORDER BY win_start) <= 15000
                 THEN 0 ELSE 1 END AS new FROM ({WINDOW_FEATURES_SQL}) f WHERE hr_mean > 73.5) a) b
GROUP BY subject, run""")
def _(spark, sf):
    wins = beat_window_features(T.beats(spark, sf)).filter("hr_mean > 73.5").select("subject", "win_start")
    return W.runs_of_rows(wins, ["subject"], "win_start", step=15000)


# -- calibration and scores ---------------------------------------------------------------------------

LABELLED_SQL = f"""
SELECT f.*, l.label FROM ({WINDOW_FEATURES_SQL}) f JOIN ({LABELS_SQL}) l USING (subject, win_start)"""

REF_SQL = f"""
SELECT x.*, coalesce(label = 1 AND win_start + 60000 <= t0 + 300000, FALSE) AS is_ref
FROM ({LABELLED_SQL}) x LEFT JOIN (SELECT subject, min(win_start) FILTER (WHERE label = 1) AS t0
 FROM ({LABELLED_SQL}) y GROUP BY subject) z USING (subject)"""

STATS_SQL = " UNION ALL ".join(f"""
SELECT subject, '{f}' AS feature, avg({f}) FILTER (WHERE is_ref) AS mean,
       CASE WHEN count({f}) FILTER (WHERE is_ref) > 0
            THEN greatest(coalesce(stddev_samp({f}) FILTER (WHERE is_ref), 0), {K.SD_FLOOR[f]}e0) END AS sd
FROM ref GROUP BY subject""" for f in ("hr_mean", "rmssd", "sdnn"))


@query("calibration_stats", f"WITH ref AS ({REF_SQL}) SELECT subject, feature, {sql6('mean', 'sd')} FROM ({STATS_SQL}) s")
def _(spark, sf):
    feats = ["hr_mean", "rmssd", "sdnn"]
    stats = C.owner_stats(beat_scores(spark, sf, stage="reference"), ["subject"], feats, F.col("is_ref"))
    return C.stats_long(stats, ["subject"], feats).select("subject", "feature", *r6("mean", "sd"))


@query("calibration_reference_windows", f"SELECT subject, win_start, is_ref FROM ({REF_SQL}) r")
def _(spark, sf):
    return beat_scores(spark, sf, stage="reference").select("subject", "win_start", "is_ref")


def z_sql(f):
    return f"({f} - m_{f}) / s_{f}"


SCORES_SQL = f"""
WITH ref AS ({REF_SQL}), st AS ({STATS_SQL}),
wide AS (SELECT subject, {', '.join(
    f"max(mean) FILTER (WHERE feature = '{f}') AS m_{f}, max(sd) FILTER (WHERE feature = '{f}') AS s_{f}"
    for f in ('hr_mean', 'rmssd', 'sdnn'))} FROM st GROUP BY subject),
z AS (SELECT ref.subject, win_start, is_ref, {z_sql('hr_mean')} AS z_hr, {z_sql('rmssd')} AS z_rm, {z_sql('sdnn')} AS z_sd
      FROM ref LEFT JOIN wide USING (subject)),
l AS (SELECT *, {K.MODEL_INTERCEPT['hr']!r}e0 + {K.MODEL_COEF['hr_mean']!r}e0 * z_hr AS logit_hr,
             {K.MODEL_INTERCEPT['hrv']!r}e0 + {K.MODEL_COEF['rmssd']!r}e0 * z_rm
             + {K.MODEL_COEF['sdnn']!r}e0 * z_sd AS logit_hrv FROM z WHERE NOT is_ref),
f AS (SELECT *, CASE WHEN logit_hr IS NULL AND logit_hrv IS NULL THEN NULL ELSE
   (coalesce(least(greatest(logit_hr, -{LOGIT_LIMIT!r}e0), {LOGIT_LIMIT!r}e0) * CASE WHEN logit_hr IS NULL THEN NULL ELSE 1 END, 0)
  + coalesce(least(greatest(logit_hrv, -{LOGIT_LIMIT!r}e0), {LOGIT_LIMIT!r}e0) * CASE WHEN logit_hrv IS NULL THEN NULL ELSE 1 END, 0))
  / (CASE WHEN logit_hr IS NULL THEN 0 ELSE 1 END + CASE WHEN logit_hrv IS NULL THEN 0 ELSE 1 END) END AS fl FROM l)
SELECT subject, win_start, round(2 / (1 + exp(-logit_hr)) - 1, 6) AS score_hr,
       round(2 / (1 + exp(-logit_hrv)) - 1, 6) AS score_hrv, round(2 / (1 + exp(-fl)) - 1, 6) AS fused FROM f
"""


@query("scored_windows", SCORES_SQL)
def _(spark, sf):
    return beat_scores(spark, sf).select("subject", "win_start", *r6("score_hr", "score_hrv", "fused"))


@query("scored_contributions", f"""
WITH ref AS ({REF_SQL}), st AS ({STATS_SQL})
SELECT r.subject, r.win_start, s.feature, round((v.value - s.mean) / s.sd, 6) AS z, c.coef,
       round((v.value - s.mean) / s.sd * c.coef, 6) AS contribution
FROM ref r JOIN (SELECT subject, win_start, 'rmssd' AS feature, rmssd AS value FROM ref
                 UNION ALL SELECT subject, win_start, 'sdnn', sdnn FROM ref
                 UNION ALL SELECT subject, win_start, 'hr_mean', hr_mean FROM ref) v USING (subject, win_start)
JOIN st s ON s.subject = r.subject AND s.feature = v.feature
JOIN (VALUES ('hr_mean', {K.MODEL_COEF['hr_mean']!r}e0), ('rmssd', {K.MODEL_COEF['rmssd']!r}e0),
             ('sdnn', {K.MODEL_COEF['sdnn']!r}e0)) c(feature, coef) ON c.feature = v.feature
WHERE NOT r.is_ref AND v.value IS NOT NULL AND s.sd IS NOT NULL""")
def _(spark, sf):
    df = beat_scores(spark, sf)
    cells = F.concat(F.when(F.col("logit_hr").isNotNull(), S.contributions("hr")).otherwise(F.array()),
                     F.when(F.col("logit_hrv").isNotNull(), S.contributions("hrv")).otherwise(F.array()))
    return df.select("subject", "win_start", F.inline(cells)).select(
        "subject", "win_start", "feature", *r6("z"), "coef", F.round("value", 6).alias("contribution"))
