"""Check-in history over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.catalog import query
from pulsegrid.catalog.beat import r6
from pulsegrid.operators import history as H
from pulsegrid.plans import tables as T

NOW = "2024-01-25 18:00:00"
C = f"({T.CHECKINS_SQL}) c"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


DAYS_SQL = f"SELECT user_id, CAST(created_at AS DATE) AS day, count(*) AS n, avg(fused) AS mean_score FROM {C} GROUP BY ALL"


@query("history_day_scores", f"SELECT user_id, day, n, round(mean_score, 6) AS mean_score FROM ({DAYS_SQL}) d")
def _(spark, sf):
    return H.day_scores(T.checkins(spark, sf)).select("user_id", "day", "n", *r6("mean_score"))


@query("history_calendar", f"""
SELECT g.user_id, g.day, coalesce(n, 0) AS n, round(mean_score, 6) AS mean_score FROM (
 SELECT user_id, CAST(unnest(range(DATE '2023-12-18', DATE '2024-01-22', INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT DISTINCT user_id FROM events) u) g
LEFT JOIN ({DAYS_SQL}) d USING (user_id, day)""")
def _(spark, sf):
    d = H.day_scores(T.checkins(spark, sf))
    return H.calendar(d, F.lit("2023-12-18"), F.lit("2024-01-21")).select("user_id", "day", "n", *r6("mean_score"))


@query("history_month_grid", f"""
SELECT g.user_id, g.day, coalesce(n, 0) AS n, day(g.day) - 1 + isodow(DATE '2024-01-01') - 1 AS cell FROM (
 SELECT user_id, CAST(unnest(range(DATE '2024-01-01', DATE '2024-02-01', INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT DISTINCT user_id FROM events) u) g
LEFT JOIN ({DAYS_SQL}) d USING (user_id, day)""")
def _(spark, sf):
    d = H.day_scores(T.checkins(spark, sf))
    return H.month_grid(d, F.to_date(now())).select("user_id", "day", "n", "cell")


@query("history_trend", f"""
SELECT user_id, day, round(mean_score, 6) AS mean_score FROM ({DAYS_SQL}) d
WHERE mean_score IS NOT NULL AND datediff('day', day, DATE '2024-01-25') BETWEEN 0 AND 13""")
def _(spark, sf):
    return H.trend(T.checkins(spark, sf), now()).select("user_id", "day", *r6("mean_score"))


@query("history_week_summary", f"""
WITH x AS (SELECT *, CAST(created_at AS DATE) >= DATE '2024-01-22' AS this,
   CAST(created_at AS DATE) >= DATE '2024-01-15' AND CAST(created_at AS DATE) < DATE '2024-01-22' AS last FROM {C}),
g AS (SELECT user_id, count_if(this) AS n, avg(fused) FILTER (WHERE this) AS a, avg(fused) FILTER (WHERE last) AS b,
  count(fused) FILTER (WHERE this) AS ns,
  arg_min(created_at, (fused, created_at, id)) FILTER (WHERE this AND fused IS NOT NULL) AS lo,
  arg_max(created_at, (fused, created_at, id)) FILTER (WHERE this AND fused IS NOT NULL) AS hi,
  arg_max(tag, (fused, created_at, id)) FILTER (WHERE this AND fused IS NOT NULL) AS ht FROM x WHERE this OR last GROUP BY user_id)
SELECT user_id, n, round(a, 6) AS average, round(b, 6) AS last_week, ns AS n_scored, CASE WHEN ns > 1 THEN CAST(lo AS DATE) END AS calmest_day,
  CASE WHEN ns > 1 THEN CAST(hi AS DATE) END AS highest_day, CASE WHEN ns > 1 THEN ht END AS highest_tag,
  CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN abs(a - b) < 0.05e0 THEN 'About the same as last week.' END AS same FROM g""")
def _(spark, sf):
    return H.week_summary(T.checkins(spark, sf), now()).select(
        "user_id", "n", *r6("average", "last_week"), "n_scored", "calmest_day", "highest_day", "highest_tag",
        F.when(F.col("phrase").startswith("About"), F.col("phrase")).alias("same"))


@query("history_tag_trends", f"SELECT tag, count(*) AS n, round(avg(fused), 6) AS mean_score FROM {C} WHERE fused IS NOT NULL GROUP BY tag HAVING count(*) >= 2")
def _(spark, sf):
    return H.tag_trends(T.checkins(spark, sf), []).select("tag", "n", *r6("mean_score"))


@query("history_tag_counts", f"SELECT user_id, tag, count(*) AS n FROM {C} GROUP BY ALL")
def _(spark, sf):
    return H.tag_counts(T.checkins(spark, sf))


@query("history_tag_suggestions", f"""
WITH own AS (SELECT user_id, tag, max(created_at) AS t FROM {C} GROUP BY ALL),
o AS (SELECT user_id, list(tag ORDER BY t DESC, tag DESC) AS tags FROM own GROUP BY user_id)
SELECT user_id, array_to_string(list_filter(list_concat(tags, ['work', 'sleep']), lambda x: x <> 'view')[1:4], ',') AS tags FROM o""")
def _(spark, sf):
    c = T.checkins(spark, sf)
    chosen = c.groupBy("user_id").agg(F.array(F.lit("view")).alias("chosen"))
    return H.tag_suggestions(c, chosen, ["work", "sleep"], n=4).select("user_id", F.array_join("tags", ",").alias("tags"))


@query("history_filtered", f"""
SELECT id FROM {C} WHERE tag = 'error' AND date_trunc('month', created_at) = DATE '2024-01-01' AND datediff('day', CAST(created_at AS DATE), DATE '2024-01-25') BETWEEN 0 AND 29""")
def _(spark, sf):
    return H.filtered(T.checkins(spark, sf), tag="error", month=F.to_date(now()), last_days=30, now=F.to_date(now())).select("id")


@query("history_suggestion", f"""
WITH b AS (SELECT *, CAST(created_at AS DATE) AS day, CAST(created_at AS DATE) >= DATE '2024-01-22' AS wk FROM {C} WHERE created_at <= TIMESTAMP '{NOW}'),
g AS (SELECT user_id, max(created_at) AS last, count_if(wk) AS nw, count(fused) FILTER (WHERE wk) AS ns,
      arg_min(day, (fused, -epoch_us(created_at))) FILTER (WHERE wk AND fused IS NOT NULL) AS calm FROM b GROUP BY user_id),
t AS (SELECT user_id, tag, avg(fused) AS m FROM b WHERE wk AND fused IS NOT NULL GROUP BY user_id, tag HAVING count(*) >= 2),
tt AS (SELECT user_id, max(m) AS m, arg_max(tag, (m, tag)) AS tag FROM t GROUP BY user_id)
SELECT user_id, CASE
 WHEN TIMESTAMP '{NOW}' - last > INTERVAL 2 DAY THEN 'You haven''t done a check-in since ' || dayname(last) || '.'
 WHEN ns >= 3 AND m >= 0.1e0 THEN 'This week, check-ins tagged "' || tag || '" read highest, averaging +' || CAST(CAST(round(m, 6) AS DECIMAL(18, 6)) AS DECIMAL(18, 2)) || '.'
 WHEN ns >= 3 THEN nw || ' check-in' || CASE WHEN nw = 1 THEN '' ELSE 's' END || ' this week. Your calmest was ' || CASE WHEN calm = DATE '2024-01-25' THEN 'today' ELSE dayname(calm) END || '.'
 WHEN CAST(last AS DATE) = DATE '2024-01-25' THEN 'You have checked in today. Another one later helps you compare your morning and evening.'
 ELSE 'A check-in at about the same time each day makes days easier to compare.' END AS suggestion
FROM g LEFT JOIN tt USING (user_id)""")
def _(spark, sf):
    return H.suggestion(T.checkins(spark, sf), now())


@query("history_newest_first", f"""
SELECT id, CASE d WHEN 0 THEN 'Today' WHEN 1 THEN 'Yesterday' ELSE CASE WHEN d > 1 AND d < 7 THEN dayname(created_at) ELSE day(created_at) || ' ' || strftime(created_at, '%b') END END AS label
FROM (SELECT *, datediff('day', CAST(created_at AS DATE), DATE '2024-01-25') AS d FROM {C}) x""")
def _(spark, sf):
    return H.newest_first(T.checkins(spark, sf), now()).select("id", "label")
