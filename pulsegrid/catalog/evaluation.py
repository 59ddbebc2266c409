"""Evaluation of scored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.catalog import query
from pulsegrid.catalog.beat import r6, sql6
from pulsegrid.operators import calibrate as C
from pulsegrid.operators import evaluate as E
from pulsegrid.operators.ordered import grouped_quantiles
from pulsegrid.plans import tables as T

SRC = f"({T.SCORED_SQL}) s"


def auc_sql(by: str, y: str = "y", p: str = "p", src: str = SRC) -> str:
    """Mean rank form: ties get the middle rank."""
    part = f"PARTITION BY {by}" if by else ""
    keys = f"{by}, " if by else ""
    return f"""
SELECT {keys}(sum(rk) FILTER (WHERE y_ = 1) - np * (np + 1) / 2e0) / nullif(np * nn, 0) AS roc_auc FROM (
 SELECT {keys}{y} AS y_, rank() OVER ({part} ORDER BY {p}) + (count(*) OVER ({part + ', ' if part else 'PARTITION BY '}{p}) - 1) / 2e0 AS rk,
        CAST(count(*) FILTER ({y} = 1) OVER ({part}) AS DOUBLE) AS np,
        CAST(count(*) FILTER ({y} = 0) OVER ({part}) AS DOUBLE) AS nn FROM {src}) r
GROUP BY {keys}np, nn"""


METRICS_SQL = f"""
SELECT c.owner, n, n_pos, n_neg,
       CASE WHEN n_pos > 0 AND n_neg > 0 THEN (tp / CAST(n_pos AS DOUBLE) + tn / CAST(n_neg AS DOUBLE)) / 2 END AS balanced_accuracy,
       (coalesce(2e0 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2e0 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2 AS macro_f1,
       roc_auc
FROM (SELECT owner, count(*) AS n, count_if(y = 1) AS n_pos, count_if(y = 0) AS n_neg, count_if(y = 1 AND p >= 0.5e0) AS tp,
             count_if(y = 0 AND p >= 0.5e0) AS fp, count_if(y = 1 AND p < 0.5e0) AS fn, count_if(y = 0 AND p < 0.5e0) AS tn
      FROM {SRC} GROUP BY owner) c LEFT JOIN ({auc_sql('owner')}) a USING (owner)"""


@query("evaluation_owner_metrics", f"SELECT owner, n, n_pos, n_neg, {sql6('balanced_accuracy', 'macro_f1', 'roc_auc')} FROM ({METRICS_SQL}) m")
def _(spark, sf):
    return E.binary_metrics(T.scored(spark, sf), ["owner"], "y", "p").select(
        "owner", "n", "n_pos", "n_neg", *r6("balanced_accuracy", "macro_f1", "roc_auc"))


@query("evaluation_summary", f"WITH m AS ({METRICS_SQL}) " + " UNION ALL ".join(
    f"SELECT '{c}' AS metric, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS sd, count({c}) AS n_owners FROM m"
    for c in ("balanced_accuracy", "macro_f1", "roc_auc")))
def _(spark, sf):
    return E.summarise(E.binary_metrics(T.scored(spark, sf), ["owner"], "y", "p"), []).select(
        "metric", *r6("mean", "sd"), "n_owners")


@query("evaluation_pooled_auc", f"SELECT round(roc_auc, 6) AS roc_auc FROM ({auc_sql('')}) a")
def _(spark, sf):
    return E.auc(T.scored(spark, sf), [], "y", "p").select(*r6("roc_auc"))


@query("evaluation_by_condition", f"""
SELECT cond, count(*) AS n, round(avg(2 * p - 1), 6) AS mean_score,
       round(avg(CASE WHEN p >= 0.5e0 THEN 1e0 ELSE 0e0 END), 6) AS frac_flagged FROM {SRC} GROUP BY cond""")
def _(spark, sf):
    return E.by_condition(T.scored(spark, sf), "cond", "p").select("cond", "n", *r6("mean_score", "frac_flagged"))


@query("evaluation_log_loss", f"""
SELECT owner, round((avg(-ln(q)) FILTER (WHERE y = 1) + avg(-ln(1 - q)) FILTER (WHERE y = 0)) / 2, 6) AS loss
FROM (SELECT *, least(greatest(p, 1e-6), 1 - 1e-6) AS q FROM {SRC}) t GROUP BY owner""")
def _(spark, sf):
    return E.balanced_log_loss(T.scored(spark, sf), ["owner"], "y", "p").select("owner", *r6("loss"))


@query("evaluation_class_weights", f"""
SELECT owner, round(count_if(y = 0) / CAST(nullif(count_if(y = 1), 0) AS DOUBLE), 6) AS pos_ratio,
       round(count(*) / (2e0 * count_if(y = 1)), 6) AS w_pos, round(count(*) / (2e0 * count_if(y = 0)), 6) AS w_neg
FROM {SRC} GROUP BY owner""")
def _(spark, sf):
    return E.class_weights(T.scored(spark, sf), ["owner"], "y").select("owner", *r6("pos_ratio", "w_pos", "w_neg"))


@query("evaluation_report", f"""
WITH c AS (SELECT k, count_if(y = k AND f = k) AS tp, count_if(y <> k AND f = k) AS fp, count_if(y = k AND f <> k) AS fn,
                  count_if(y = k) AS support, count(*) AS total FROM (SELECT y, CASE WHEN p >= 0.5e0 THEN 1 ELSE 0 END AS f FROM {SRC}) a,
                  (VALUES (0), (1)) v(k) GROUP BY k),
r AS (SELECT k, coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0) AS pr, coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0) AS re,
             coalesce(2e0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, support, total, tp FROM c),
o AS (SELECT CAST(k AS VARCHAR) AS class, pr, re, f1, support FROM r
 UNION ALL SELECT 'accuracy', sum(tp) / CAST(max(total) AS DOUBLE), sum(tp) / CAST(max(total) AS DOUBLE), sum(tp) / CAST(max(total) AS DOUBLE), max(total) FROM r
 UNION ALL SELECT 'macro avg', avg(pr), avg(re), avg(f1), max(total) FROM r
 UNION ALL SELECT 'weighted avg', sum(pr * support) / max(total), sum(re * support) / max(total), sum(f1 * support) / max(total), max(total) FROM r)
SELECT class, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1, support FROM o""")
def _(spark, sf):
    return E.classification_report(T.scored(spark, sf), "y", "p").select(
        "class", *r6("precision", "recall", "f1"), "support")


@query("evaluation_condition_counts", f"""
SELECT owner, count_if(cond = 1) AS baseline, count_if(cond = 2) AS stress, count_if(cond = 3) AS amusement FROM {SRC} GROUP BY owner""")
def _(spark, sf):
    return E.owner_condition_counts(T.scored(spark, sf), "owner", "cond")


@query("evaluation_below_chance", f"""
SELECT owner, round(roc_auc, 6) AS roc_auc FROM ({auc_sql('owner')}) a WHERE roc_auc < 0.5e0""")
def _(spark, sf):
    return E.below_chance(E.auc(T.scored(spark, sf), ["owner"], "y", "p"), "owner").select("owner", *r6("roc_auc"))


@query("evaluation_validate_pairs", f"""
SELECT CASE WHEN owner IS NULL THEN 2 ELSE 0 END + CASE WHEN cond IS NULL THEN 1 ELSE 0 END AS level, owner, cond AS condition,
       count(*) AS n, round(avg(CASE WHEN valid THEN 1e0 ELSE 0e0 END), 6) AS valid_frac, round(avg(err), 6) AS mae,
       round(avg(CASE WHEN err IS NULL THEN NULL WHEN err <= 5 THEN 1e0 ELSE 0e0 END), 6) AS within,
       round(corr(value, ref) FILTER (WHERE valid), 6) AS r, round(median(ref), 6) AS median_ref
FROM (SELECT *, CASE WHEN valid THEN abs(value - ref) END AS err FROM {SRC}) t
GROUP BY GROUPING SETS ((owner, cond), (owner), (cond), ())""")
def _(spark, sf):
    return E.validate_pairs(T.scored(spark, sf), "owner", "cond", "value", "ref", "valid").select(
        "level", "owner", "condition", "n", *r6("valid_frac", "mae", "within", "r", "median_ref"))


@query("evaluation_paired_check", f"""
SELECT owner, count(*) AS n, round(avg(abs(value - ref)), 6) AS mae, round(avg(value - ref), 6) AS bias, count_if(q = 'good') AS n_good,
       round(avg(abs(value - ref)) FILTER (WHERE q = 'good'), 6) AS mae_good,
       CASE WHEN count_if(q = 'good') < 5 THEN 'more' WHEN avg(abs(value - ref)) FILTER (WHERE q = 'good') <= 5 THEN 'pass' ELSE 'fail' END AS verdict
FROM (SELECT *, CASE id % 3 WHEN 0 THEN 'good' WHEN 1 THEN 'fair' ELSE 'poor' END AS q FROM {SRC}) t GROUP BY owner""")
def _(spark, sf):
    q = F.element_at(F.array(F.lit("good"), F.lit("fair"), F.lit("poor")), (F.col("id") % 3 + 1).cast("int"))
    return E.paired_check(T.scored(spark, sf).withColumn("q", q), ["owner"], "value", "ref", "q").select(
        "owner", "n", *r6("mae", "bias"), "n_good", *r6("mae_good"), "verdict")


@query("evaluation_histogram", f"""
WITH b AS (SELECT y, least(CAST(floor((p * 2 - 1 + 1) / (2 / 40e0)) AS BIGINT), 39) AS bin, count(*) AS n FROM {SRC} GROUP BY ALL)
SELECT y, bin, n, round(n / (sum(n) OVER (PARTITION BY y) * (2 / 40e0)), 6) AS density FROM b""")
def _(spark, sf):
    s = T.scored(spark, sf).withColumn("score", F.col("p") * 2 - 1)
    return E.histogram(s, ["y"], "score", -1.0, 1.0, 40).select("y", "bin", "n", *r6("density"))


@query("evaluation_quantiles", f"""
SELECT owner, round(median(value), 6) AS med, round(quantile_cont(value, 0.95), 6) AS q95,
       round(list_sort(list(value))[least(CAST(floor(count(*) * 0.95e0) AS BIGINT), count(*) - 1) + 1], 6) AS p95,
       round(list_sort(list(value))[CAST(floor((count(*) - 1) * 0.3e0) AS BIGINT) + 1], 6) AS p30 FROM {SRC} GROUP BY owner""")
def _(spark, sf):
    return grouped_quantiles(T.scored(spark, sf), ["owner"], "value", {
        "med": ("linear", 0.5), "q95": ("linear", 0.95), "p95": ("upper", 0.95), "p30": ("lower", 0.3)}).select(
        "owner", *r6("med", "q95", "p95", "p30"))


MOTION_SRC = f"(SELECT *, id % 5 <> 0 AS hr_ok, value / 100e0 AS cov FROM {SRC}) s"


@query("evaluation_motion_report", f"""
WITH o AS ({auc_sql('owner', p='value')})
SELECT measure, grp, round(value, 6) AS value FROM (
SELECT 'auc_owner' AS measure, CAST(owner AS VARCHAR) AS grp, roc_auc AS value FROM o
UNION ALL SELECT 'auc_mean', 'all', avg(roc_auc) FROM o
UNION ALL SELECT 'auc_pooled', 'all', roc_auc FROM ({auc_sql('', p='value')}) a
UNION ALL SELECT 'r_label', 'all', corr(value, y) FROM {MOTION_SRC}
UNION ALL SELECT 'r_coverage', 'all', corr(value, cov) FROM {MOTION_SRC}
UNION ALL SELECT 'mean', CAST(cond AS VARCHAR), avg(value) FROM {MOTION_SRC} GROUP BY cond
UNION ALL SELECT 'hrv_valid_frac', CAST(cond AS VARCHAR), avg(CASE WHEN valid THEN 1e0 ELSE 0e0 END) FROM {MOTION_SRC} GROUP BY cond
UNION ALL SELECT 'hr_valid_frac', CAST(cond AS VARCHAR), avg(CASE WHEN hr_ok THEN 1e0 ELSE 0e0 END) FROM {MOTION_SRC} GROUP BY cond
UNION ALL SELECT 'median', CAST(cond AS VARCHAR), median(value) FROM {MOTION_SRC} GROUP BY cond
UNION ALL SELECT 'median_hrv', CASE WHEN valid THEN 'valid' ELSE 'invalid' END, median(value) FROM {MOTION_SRC} GROUP BY valid) z""")
def _(spark, sf):
    s = T.scored(spark, sf).withColumn("hr_ok", F.col("id") % 5 != 0).withColumn("cov", F.col("value") / 100.0)
    return E.motion_report(s, "owner", "cond", "value", "y", "valid", "hr_ok", "cov").select(
        "measure", "grp", *r6("value"))


@query("evaluation_typical_constants", f"""
WITH r AS (SELECT owner, avg(value) AS rm, stddev_samp(value) AS rs FROM {SRC} WHERE cond = 1 AND valid GROUP BY owner HAVING count(*) >= 2),
m AS (SELECT owner, cond, median(value) AS med FROM {SRC} GROUP BY owner, cond HAVING count(*) >= 2)
SELECT 'value' AS feature, cond, round(median(med - rm), 6) AS shift, round((SELECT median(rm) FROM r), 6) AS mean,
       round((SELECT median(rs) FROM r), 6) AS sd FROM m JOIN r USING (owner) GROUP BY cond""")
def _(spark, sf):
    s = T.scored(spark, sf)
    return C.typical_constants(s, ["owner"], "cond", ["value"], (F.col("cond") == 1) & F.col("valid")).select(
        "feature", "cond", *r6("shift", "mean", "sd"))
