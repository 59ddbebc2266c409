"""Older scoring rules over events and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.catalog import query
from pulsegrid.catalog.beat import r6
from pulsegrid.operators import legacy as L
from pulsegrid.plans import activity_tables as A
from pulsegrid.plans import tables as T


def _parts(spark, sf):
    b = A.base(spark, sf)
    keys = b.filter("kind0 = 'click'").select("run", "seq", F.col("t0").alias("press_ms"), (F.col("t0") + 80 + F.col("e") % 50).alias("release_ms"))
    moves = b.filter("kind0 = 'view'").select("run", F.col("t0").alias("t_ms"), F.col("v").alias("speed"))
    labels = b.filter("kind0 = 'error'").select("run", F.col("seq").alias("label_id"), F.col("t0").alias("label_ms"), (F.col("e") % 2).alias("stress"))
    return keys, moves, labels


@query("legacy_typing_mouse_windows", f"""
WITH b AS ({A.BASE_SQL}), k AS (SELECT run, seq, t0 AS p, t0 + 80 + e % 50 AS r FROM b WHERE kind0 = 'click'), m AS (SELECT run, t0 AS t, v FROM b WHERE kind0 = 'view'),
l AS (SELECT run, seq AS id, t0 AS t, e % 2 AS stress FROM b WHERE kind0 = 'error'),
e AS (SELECT run, greatest(k0, m0) AS t0, CAST(floor((least(k1, m1) - greatest(k0, m0)) / 10000e0) AS BIGINT) AS last FROM (SELECT run, min(p) AS k0, max(p) AS k1 FROM k GROUP BY run) x JOIN (SELECT run, min(t) AS m0, max(t) AS m1 FROM m GROUP BY run) y USING (run)),
pk AS (SELECT run, CAST(floor((p - t0) / 10000e0) AS BIGINT) AS win, p, r, seq FROM k JOIN e USING (run) WHERE p >= t0 AND floor((p - t0) / 10000e0) < last),
g AS (SELECT *, (p - lag(p) OVER (PARTITION BY run, win ORDER BY p, seq)) / 1000e0 AS gap FROM pk),
ka AS (SELECT run, win, avg(gap) AS avg_iki, stddev_samp(gap) AS std_iki, avg((r - p) / 1000e0) AS avg_hold FROM g GROUP BY run, win HAVING count(*) >= 2),
ma AS (SELECT run, CAST(floor((t - t0) / 10000e0) AS BIGINT) AS win, avg(v) AS avg_speed, stddev_samp(v) AS std_speed FROM m JOIN e USING (run) WHERE t >= t0 AND floor((t - t0) / 10000e0) < last GROUP BY ALL HAVING count(*) >= 2),
w AS (SELECT run, win, t0 + win * 10000 AS win_ms, avg_iki, std_iki, avg_hold, avg_speed, std_speed FROM ka JOIN ma USING (run, win) JOIN e USING (run)),
n AS (SELECT w.*, l.stress, row_number() OVER (PARTITION BY w.run, w.win ORDER BY abs(w.win_ms - l.t), l.t, l.id) AS q FROM w LEFT JOIN l ON l.run = w.run)
SELECT run, win, win_ms, round(avg_iki, 6) AS avg_iki, round(std_iki, 6) AS std_iki, round(avg_hold, 6) AS avg_hold, round(avg_speed, 6) AS avg_speed, round(std_speed, 6) AS std_speed, stress FROM n WHERE q = 1""")
def _(spark, sf):
    return L.typing_mouse_windows(*_parts(spark, sf), ["run"], window_ms=10_000).select(
        "run", "win", "win_ms", *r6("avg_iki", "std_iki", "avg_hold", "avg_speed", "std_speed"), "stress")


@query("legacy_oxygen_windows", f"""
WITH s AS (SELECT subject, idx, CASE WHEN idx % 97 = 0 THEN NULL ELSE 90 + ax % 10 END AS x, count(*) OVER (PARTITION BY subject) AS n FROM ({T.SAMPLES_SQL}) q),
w AS (SELECT *, unnest(range(greatest(CAST(floor((idx - 60) / 30e0) AS BIGINT) + 1, 0), CAST(floor(idx / 30e0) AS BIGINT) + 1)) AS win FROM s)
SELECT subject, win, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd, round(avg(CASE WHEN x IS NULL THEN NULL WHEN x < 94 THEN 1e0 ELSE 0e0 END), 6) AS dip_share,
 CASE WHEN avg(x) < 94 THEN 1 ELSE 0 END AS label FROM w WHERE win * 30 < n - 60 GROUP BY subject, win HAVING count(x) = 60""")
def _(spark, sf):
    s = T.samples(spark, sf).select("subject", "idx", F.when(F.col("idx") % 97 != 0, 90 + F.col("ax") % 10).cast("double").alias("x"))
    return L.oxygen_windows(s, ["subject"], ["idx"], "x").select("subject", "win", *r6("mean", "sd", "dip_share"), "label")


@query("legacy_rmssd_windows", f"""
WITH b AS (SELECT subject, seq - 1 AS pos, rr_ms / 1000e0 AS ibi, t_ms, count(*) OVER (PARTITION BY subject) AS n FROM ({T.BEATS_SQL}) q),
d AS (SELECT *, ibi - lag(ibi) OVER (PARTITION BY subject ORDER BY pos) AS dd FROM b),
w AS (SELECT *, unnest(range(greatest(CAST(floor((pos - 20) / 5e0) AS BIGINT) + 1, 0), CAST(floor(pos / 5e0) AS BIGINT) + 1)) AS win FROM d)
SELECT subject, win, round(sqrt(avg(dd * dd) FILTER (WHERE pos > win * 5)), 6) AS rmssd, max(t_ms) FILTER (WHERE pos = win * 5 + 10) AS center FROM w WHERE win * 5 < n - 20 GROUP BY subject, win""")
def _(spark, sf):
    b = T.beats(spark, sf).withColumn("ibi", F.col("rr_ms") / 1000.0)
    return L.rmssd_windows(b, ["subject"], ["seq"], "ibi", "t_ms").select("subject", "win", *r6("rmssd"), "center")


@query("legacy_rounded_labels", f"""
WITH s AS (SELECT subject, idx, ax % 2 AS y, count(*) OVER (PARTITION BY subject) AS n FROM ({T.SAMPLES_SQL}) q),
w AS (SELECT *, unnest(range(greatest(CAST(floor((idx - 10) / 5e0) AS BIGINT) + 1, 0), CAST(floor(idx / 5e0) AS BIGINT) + 1)) AS win FROM s)
SELECT subject, win, CAST(round_even(avg(y), 0) AS INTEGER) AS label FROM w WHERE win * 5 < n - 10 GROUP BY subject, win""")
def _(spark, sf):
    from pulsegrid.operators.windows import count_windows

    w = count_windows(T.samples(spark, sf).select("subject", "idx", (F.col("ax") % 2).alias("y")), ["subject"], ["idx"], size=10, step=5)
    return L.window_label_rounded(w, ["subject", "win"], "y")


@query("legacy_tanh_scores", f"""
WITH s AS ({T.SCORED_SQL}), m AS (SELECT owner, avg(value) FILTER (WHERE id % 5 <> 0) AS m, stddev_pop(value) FILTER (WHERE id % 5 <> 0) AS sd FROM s GROUP BY owner),
z AS (SELECT s.*, (value - m) / sd AS z FROM s JOIN m USING (owner)), l AS (SELECT owner, regr_slope(p, z) AS a, regr_intercept(p, z) AS b FROM z WHERE id % 5 <> 0 GROUP BY owner),
q AS (SELECT owner, 2 / quantile_cont(abs(a * z + b - 0.5e0), 0.95) AS sc FROM z JOIN l USING (owner) WHERE id % 5 <> 0 GROUP BY owner)
SELECT id, round(z, 6) AS z, round(a * z + b, 6) AS logit, round(tanh(sc * (a * z + b - 0.5e0)), 6) AS score FROM z JOIN l USING (owner) JOIN q USING (owner)""")
def _(spark, sf):
    s = T.scored(spark, sf).withColumn("train", F.col("id") % 5 != 0)
    return L.tanh_scores(s, ["owner"], "value", "p", "train").select("id", *r6("z", "logit", "score"))


FACE_SQL = f"""SELECT subject, idx, idx * 400 AS t_ms, ax % 5 = 0 AS closed, 8 + ay % 5 AS eye_open, 18 + az % 7 AS brow_gap, CASE ax % 4 WHEN 0 THEN 'angry' WHEN 1 THEN 'sad' ELSE 'neutral' END AS emotion FROM ({T.SAMPLES_SQL}) s"""
BLINK_SQL = f"""
WITH f AS ({FACE_SQL}), b AS (SELECT *, CASE WHEN closed AND NOT coalesce(lag(closed) OVER (PARTITION BY subject ORDER BY idx), FALSE) THEN 1 ELSE 0 END AS blink FROM f),
r AS (SELECT *, sum(blink) OVER (PARTITION BY subject ORDER BY t_ms RANGE BETWEEN 29999 PRECEDING AND CURRENT ROW) * 2 AS blink_rate FROM b)"""


def _faces(spark, sf):
    s = T.samples(spark, sf)
    e = F.col("ax") % 4
    return s.select("subject", "idx", (F.col("idx") * 400).alias("t_ms"), (F.col("ax") % 5 == 0).alias("closed"), (8 + F.col("ay") % 5).alias("eye_open"),
                    (18 + F.col("az") % 7).alias("brow_gap"), F.when(e == 0, "angry").when(e == 1, "sad").otherwise("neutral").alias("emotion"))


@query("legacy_blink_rate", BLINK_SQL + " SELECT subject, idx, blink, CAST(blink_rate AS BIGINT) AS blink_rate FROM r")
def _(spark, sf):
    return L.blink_rate(_faces(spark, sf), ["subject"], "t_ms", "closed").select("subject", "idx", "blink", "blink_rate")


FACE_SCORE_SQL = BLINK_SQL + """,
s AS (SELECT *, 0.35e0 * (12 - eye_open) / 12e0 + 0.35e0 * (24 - brow_gap) / 24e0 + 0.15e0 * greatest(0, (blink_rate - 15) / 15e0) + 0.15e0 * CASE WHEN emotion IN ('angry', 'sad') THEN 1 ELSE 0 END AS stress_score FROM r)"""


def _face_scores(spark, sf):
    f = L.blink_rate(_faces(spark, sf), ["subject"], "t_ms", "closed")
    base = T.table(spark, sf, "events").select((F.col("user_id") % 15).alias("subject")).distinct().select(
        "subject", F.lit(12.0).alias("eye"), F.lit(24.0).alias("brow"), F.lit(15.0).alias("blink"))
    return L.face_scores(f, base, ["subject"])


@query("legacy_face_scores", FACE_SCORE_SQL + " SELECT subject, idx, round(stress_score, 6) AS stress_score FROM s")
def _(spark, sf):
    return _face_scores(spark, sf).select("subject", "idx", *r6("stress_score"))


@query("legacy_hysteresis", f"""
WITH RECURSIVE f AS (SELECT subject, idx, ax % 20 < 11 AS hot FROM ({T.SAMPLES_SQL}) s),
w AS (SELECT subject, idx, CASE WHEN hot THEN 1 ELSE 0 END AS counter, CASE WHEN NOT hot THEN 'CALM' END AS state FROM f WHERE idx = 0
 UNION ALL SELECT f.subject, f.idx, CASE WHEN f.hot THEN w.counter + 1 ELSE greatest(0, w.counter - 1) END,
  CASE WHEN f.hot AND w.counter + 1 >= 15 THEN 'STRESSED' WHEN NOT f.hot AND w.counter - 1 >= 15 THEN 'STRESSED' WHEN NOT f.hot AND w.counter <= 1 THEN 'CALM' ELSE w.state END
  FROM w JOIN f ON f.subject = w.subject AND f.idx = w.idx + 1)
SELECT subject, idx, counter, state FROM w""")
def _(spark, sf):
    s = T.samples(spark, sf).withColumn("hot", F.col("ax") % 20 < 11)
    return L.hysteresis(s, ["subject"], ["idx"], "hot").select("subject", "idx", "counter", "state")


@query("legacy_held_hr", f"""
WITH b AS (SELECT subject, seq, seq * 5 + ax % 3 AS pk FROM (SELECT subject, idx AS seq, ax FROM ({T.SAMPLES_SQL}) s) q), h AS (SELECT * FROM (SELECT subject, pk, 7 * 60e0 / (pk - lag(pk) OVER (PARTITION BY subject ORDER BY pk)) AS hr FROM b) z WHERE hr IS NOT NULL),
g AS (SELECT subject, idx * 4 AS idx FROM ({T.SAMPLES_SQL}) s),
p AS (SELECT g.*, a.pk AS ta, a.hr AS va FROM g ASOF LEFT JOIN h a ON a.subject = g.subject AND g.idx >= a.pk), n AS (SELECT p.*, c.pk AS tb, c.hr AS vb FROM p ASOF LEFT JOIN h c ON c.subject = p.subject AND p.idx < c.pk)
SELECT subject, idx, round(CASE WHEN ta IS NULL THEN vb WHEN tb IS NULL THEN va ELSE va + (vb - va) * ((idx - ta) / CAST(tb - ta AS DOUBLE)) END, 6) AS hr FROM n""")
def _(spark, sf):
    s = T.samples(spark, sf)
    peaks = s.select("subject", (F.col("idx") * 5 + F.col("ax") % 3).alias("at"))
    return L.held_hr(peaks, s.select("subject", (F.col("idx") * 4).alias("idx")), ["subject"], "at", "idx", 7.0).select("subject", "idx", *r6("hr"))


@query("legacy_label_text", f"""
SELECT true_label, predicted_label, count(*) AS n FROM (SELECT CASE WHEN y = 1 THEN 'Stress' ELSE 'Non-Stress' END AS true_label, CASE WHEN p >= 0.5e0 THEN 'Stress' ELSE 'Non-Stress' END AS predicted_label FROM ({T.SCORED_SQL}) s) x GROUP BY ALL""")
def _(spark, sf):
    d = L.label_text(T.scored(spark, sf).withColumn("yhat", (F.col("p") >= 0.5).cast("int")), "y", "yhat")
    return d.groupBy("true_label", "predicted_label").agg(F.count("*").alias("n"))
