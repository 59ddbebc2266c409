"""Models fitted on calibrated beat windows and on labelled runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid import constants as K
from pulsegrid.catalog import query
from pulsegrid.catalog.activity import up
from pulsegrid.catalog.beat import REF_SQL, STATS_SQL, r6
from pulsegrid.operators import calibrate as C
from pulsegrid.operators import evaluate as E
from pulsegrid.operators import models as M
from pulsegrid.operators import sessions as S
from pulsegrid.plans import activity_tables as A
from pulsegrid.plans import tables as T
from pulsegrid.plans.flows import BEAT_FEATURES, beat_scores
from pulsegrid.session import checkpointed


def training_windows(spark, sf):
    """Calibrated windows with the stress label. Written once: every Newton step reads them again."""
    ref = beat_scores(spark, sf, stage="reference")
    stats = C.owner_stats(ref, ["subject"], BEAT_FEATURES, F.col("is_ref"))
    z = C.zscores(ref.filter("NOT is_ref"), stats, ["subject"], BEAT_FEATURES)
    return checkpointed(z.withColumn("y", F.when(F.col("label") == 2, 1).otherwise(0)))


SIGNALS = {"hr": ["z_hr_mean"], "hrv": ["z_rmssd", "z_sdnn"]}


@query("model_nested_loo_scores")
def _(spark, sf):
    z = training_windows(spark, sf)
    for s, result in M.loo_cv_all(z, "subject", "y", SIGNALS).items():
        z = M.held_out_scores(z, "subject", result, f"p_{s}")
    return z.select("subject", "win_start", "y", *r6("p_hr", "p_hrv"))


@query("model_nested_loo_metrics")
def _(spark, sf):
    z = training_windows(spark, sf)
    out = None
    for s, result in M.loo_cv_all(z, "subject", "y", SIGNALS).items():
        p = M.held_out_scores(z, "subject", result, "p")
        m = E.summarise(E.binary_metrics(p, ["subject"], "y", "p"), []).withColumn("signal", F.lit(s))
        out = m if out is None else out.unionByName(m)
    return out.select("signal", "metric", *r6("mean", "sd"), "n_owners")


@query("model_fold_coefficients")
def _(spark, sf):
    z = training_windows(spark, sf)
    r = M.loo_cv(z, "subject", "y", SIGNALS["hrv"])
    return r.coefficients(spark).select("fold", "feature", *r6("coef", "intercept"), "c")


@query("model_sign_agreement")
def _(spark, sf):
    z = training_windows(spark, sf)
    out = None
    for result in M.loo_cv_all(z, "subject", "y", SIGNALS).values():
        c = result.coefficients(spark).withColumn("feature", F.regexp_replace("feature", "^z_", ""))
        out = c if out is None else out.unionByName(c)
    return E.sign_agreement(out, []).select("feature", *r6("sign_match"), "n_folds")


@query("model_feature_ablation")
def _(spark, sf):
    z = training_windows(spark, sf)
    out = None
    sets = {"+".join(feats): feats for feats in (["z_rmssd", "z_sdnn"], ["z_rmssd"], ["z_sdnn"])}
    for name, result in M.loo_cv_all(z, "subject", "y", sets).items():
        p = M.held_out_scores(z, "subject", result, "p")
        m = E.summarise(E.binary_metrics(p, ["subject"], "y", "p"), []).withColumn("features", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out.select("features", "metric", *r6("mean", "sd"), "n_owners")


@query("model_stacked_fusion")
def _(spark, sf):
    z = training_windows(spark, sf)
    results = M.loo_cv_all(z, "subject", "y", SIGNALS)
    return M.stacked_scores(z, "subject", "y", results).select("subject", "win_start", "y", *r6("stacked_p"))


@query("model_population_fit")
def _(spark, sf):
    z = training_windows(spark, sf).dropna(subset=SIGNALS["hrv"])
    m = M.fit_population(z, "y", SIGNALS["hrv"], c=1.0)
    rows = [(f, float(c), float(m.intercept)) for f, c in zip(SIGNALS["hrv"], m.coefficients)]
    return spark.createDataFrame(rows, "feature string, coef double, intercept double")


@query("model_boosted_trees")
def _(spark, sf):
    z = training_windows(spark, sf).dropna(subset=["z_hr_mean"])
    m = M.fit_trees(z, "y", ["z_hr_mean"], rounds=20, rate=0.1)
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    scored = m.transform(VectorAssembler(inputCols=["z_hr_mean"], outputCol="_x").transform(z))
    return scored.select("subject", "win_start", "y", F.round(vector_to_array("probability")[1], 6).alias("p"))


@query("model_personal_fit")
def _(spark, sf):
    return _personal(spark, sf).select("user_id", "activity", F.array_join("features", ",").alias("features"),
                                       F.round("balanced_accuracy", 3).alias("balanced_accuracy"), "n_held_out", "ready")


def _runs(spark, sf):
    r = S.labelled_runs(A.runs(spark, sf))
    e = F.col("run")
    m = F.map_from_entries(F.array(
        F.struct(F.lit("interKeyMeanMs").alias("k"), (200 + e % 83 + F.col("y") * 15).cast("double").alias("v")),
        F.struct(F.lit("interKeyCv").alias("k"), (e % 29 / 50.0).alias("v")),
        F.struct(F.lit("errorRate").alias("k"), (e % 13 / 100.0).alias("v")),
        F.struct(F.lit("corrections").alias("k"), F.when(e % 11 != 0, e % 5).cast("double").alias("v"))))
    return r.withColumn("metrics", m)


def _personal(spark, sf):
    return M.train_personal(_runs(spark, sf))


# what can be told without fitting: who gets a model, from which features and rows, and that nothing is left to improve
@query("model_personal_gradients", f"""
WITH r AS (SELECT user_id, session, run, CASE WHEN phase = 'challenge' THEN 1 ELSE 0 END AS y FROM ({A.RUNS_SQL}) x WHERE completed AND phase IN ('rest', 'challenge')),
f AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE run % 11 <> 0) AS h FROM r GROUP BY user_id),
u AS (SELECT user_id, CASE WHEN n >= 2 THEN 3 ELSE 0 END + CASE WHEN h >= greatest(2, 0.8e0 * n) THEN 1 ELSE 0 END AS used FROM f),
d AS (SELECT r.*, used FROM r JOIN u USING (user_id) WHERE used > 0 AND (used = 3 OR run % 11 <> 0)),
t AS (SELECT user_id, any_value(used) AS used, count(*) AS n, sum(y) AS p FROM d GROUP BY user_id HAVING sum(y) > 0 AND sum(y) < count(*)),
s AS (SELECT user_id, session, count(*) AS n, sum(y) AS p FROM d GROUP BY user_id, session),
e AS (SELECT user_id, sum(s.n) AS n_held_out FROM s JOIN t USING (user_id) WHERE t.p - s.p > 0 AND t.p - s.p < t.n - s.n GROUP BY user_id)
SELECT user_id, 'typing' AS activity, 'interKeyMeanMs,interKeyCv,errorRate' || CASE WHEN used = 4 THEN ',corrections' ELSE '' END AS features,
       n AS n_rows, coalesce(n_held_out, 0)::BIGINT AS n_held_out, 0e0 AS gradient FROM t LEFT JOIN e USING (user_id)""")
def _(spark, sf):
    runs = checkpointed(_runs(spark, sf))
    m = M.train_personal(runs, l2=1.0)
    key = ["user_id", "activity"]
    x = F.transform("features", lambda f: F.try_element_at("metrics", f))
    d = runs.join(m, key).withColumn("x", x).filter(F.forall("x", lambda v: v.isNotNull()))
    off = F.col("y") - 1 / (1 + F.exp(-F.aggregate(F.zip_with("coef", "x", lambda c, v: c * v), F.col("intercept"), lambda s, v: s + v)))
    d = d.withColumn("off", off)
    cells = d.select(*key, "features", "n_held_out", "off", F.posexplode(F.arrays_zip("x", "coef")).alias("j", "c"))
    per = cells.groupBy(*key, "features", "n_held_out", "j").agg(
        F.count("*").alias("n_rows"), F.sum("off").alias("g0"), F.sum(F.col("off") * F.col("c.x")).alias("g"), F.avg("c.x").alias("m"),
        F.stddev_pop("c.x").alias("sd"), F.max("c.coef").alias("coef"))
    slope = (F.col("g") - F.col("m") * F.col("g0")) / F.col("sd") - F.col("coef") * F.col("sd")
    return per.groupBy(*key, "features", "n_held_out").agg(F.max("n_rows").alias("n_rows"), F.round(F.max(F.greatest(F.abs("g0"), F.abs(slope))), 4).alias("gradient")).select(
        *key, F.array_join("features", ",").alias("features"), "n_rows", "n_held_out", "gradient")


@query("model_fold_gradients", f"""
WITH ref AS ({REF_SQL}), st AS ({STATS_SQL}),
z AS (SELECT r.subject, max(h.mean) IS NOT NULL AND max(r.hr_mean) IS NOT NULL AS hr, count(v.mean) = 2 AND max(r.rmssd) IS NOT NULL AND max(r.sdnn) IS NOT NULL AS hrv
      FROM ref r LEFT JOIN st h ON h.subject = r.subject AND h.feature = 'hr_mean' LEFT JOIN st v ON v.subject = r.subject AND v.feature IN ('rmssd', 'sdnn')
      WHERE NOT r.is_ref GROUP BY r.subject, r.win_start),
s AS (SELECT 'hr' AS signal, subject FROM z WHERE hr UNION ALL SELECT 'hrv', subject FROM z WHERE hrv),
n AS (SELECT signal, subject AS fold, count(*) AS n FROM s GROUP BY ALL)
SELECT signal, CAST(fold AS VARCHAR) AS fold, (SELECT count(*) FROM s WHERE s.signal = n.signal) - n AS n_rows, 0e0 AS gradient FROM n""")
def _(spark, sf):
    z = training_windows(spark, sf)
    out = None
    for s, result in M.loo_cv_all(z, "subject", "y", SIGNALS).items():
        feats = SIGNALS[s]
        c = result.coefficients(spark).groupBy("fold").agg(F.first("c").alias("c"), F.first("intercept").alias("b0"), F.map_from_entries(F.collect_list(F.struct("feature", "coef"))).alias("b"))
        folds = [r.asDict() for r in c.collect()]       # one row an owner
        told = F.array(*[F.struct(F.lit(f["fold"]).alias("fold"), F.lit(f["c"]).alias("c"), F.lit(f["b0"]).alias("b0"), F.array(*[F.lit(f["b"][x]) for x in feats]).alias("b")) for f in folds])
        d = z.dropna(subset=feats).select("subject", "y", F.array(*feats).alias("x"), F.explode(told).alias("f")).filter(F.col("subject").cast("string") != F.col("f.fold"))
        off = F.col("y") - 1 / (1 + F.exp(-F.aggregate(F.zip_with("f.b", "x", lambda b, v: b * v), F.col("f.b0"), lambda a, v: a + v)))
        d = d.withColumn("off", off)
        per = d.groupBy("f.fold").agg(F.count("*").alias("n_rows"), F.first("f").alias("f"), *[F.count_if(F.col("y") == k).alias(f"n{k}") for k in (0, 1)], *[
            F.sum(F.when(F.col("y") == k, F.col("off") * (1.0 if j < 0 else F.get("x", F.lit(j))))).alias(f"g{k}_{j}") for k in (0, 1) for j in range(-1, len(feats))])
        slope = [F.abs(F.col("n_rows") / 2.0 * (F.col(f"g0_{j}") / F.col("n0") + F.col(f"g1_{j}") / F.col("n1")) - (F.lit(0.0) if j < 0 else F.get("f.b", F.lit(j)) / F.col("f.c")))
                 for j in range(-1, len(feats))]
        part = per.select(F.lit(s).alias("signal"), "fold", "n_rows", F.round(F.greatest(*slope), 4).alias("gradient"))
        out = part if out is None else out.unionByName(part)
    return out


@query("model_personal_scores")
def _(spark, sf):
    runs = _runs(spark, sf)
    return M.score_personal(M.train_personal(runs), runs).select("user_id", "run", "y", *r6("score"))


@query("model_holdout_split", f"SELECT id, y, CAST('0x' || substr(md5('0:' || y || ':' || id), 1, 8) AS BIGINT) % 10000 < 2000 AS is_test FROM ({T.SCORED_SQL}) s")
def _(spark, sf):
    return M.holdout(T.scored(spark, sf), "y", F.col("id")).select("id", "y", "is_test")


@query("model_table_scores", f"""
WITH z AS (SELECT event_id AS id, value / 50e0 - 1 AS hr_mean, event_id % 7 / 3e0 - 1 AS rmssd, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 11 / 5e0 - 1 END AS sdnn FROM events)
SELECT id, 'hr' AS signal, round({K.MODEL_INTERCEPT['hr']!r}e0 + {K.MODEL_COEF['hr_mean']!r}e0 * hr_mean, 6) AS logit FROM z
UNION ALL SELECT id, 'hrv', round({K.MODEL_INTERCEPT['hrv']!r}e0 + {K.MODEL_COEF['rmssd']!r}e0 * rmssd + {K.MODEL_COEF['sdnn']!r}e0 * coalesce(sdnn, 0), 6) FROM z""")
def _(spark, sf):
    from pulsegrid.operators import score as SC

    e = F.col("event_id")
    cells = F.array(F.struct(F.lit("hr_mean").alias("feature"), (F.col("value") / 50.0 - 1).alias("z")),
                    F.struct(F.lit("rmssd").alias("feature"), (e % 7 / 3.0 - 1).alias("z")),
                    F.struct(F.lit("sdnn").alias("feature"), F.when(e % 5 != 0, e % 11 / 5.0 - 1).alias("z")))
    z = T.table(spark, sf, "events").select(e.alias("id"), F.inline(cells))
    return SC.score_with_models(z, SC.model_table(spark), ["id"]).select("id", "signal", *r6("logit"))
