import math

import pytest
from pyspark.sql import functions as F

from conftest import as_dicts
from pulsegrid import constants as K
from pulsegrid.functions import text as W
from pulsegrid.operators import calibrate as C
from pulsegrid.operators import score as S

FEATURES = ", ".join(f"{f} double" for f in K.MODEL_FEATURES)
SCHEMA = f"id long, user_id long, started_at timestamp, source string, quality string, {FEATURES}"


def readings(spark, rows):
    """rows: (id, day, hr, rmssd, quality, source)"""
    from datetime import datetime, timedelta
    out = []
    for i, day, hr, rm, q, src in rows:
        f = dict.fromkeys(K.MODEL_FEATURES)
        f.update(hr_mean=float(hr), rmssd=None if rm is None else float(rm), sdnn=None if rm is None else rm * 1.2)
        out.append((i, 1, datetime(2024, 1, 1) + timedelta(days=day), src, q, *[f[k] for k in K.MODEL_FEATURES]))
    return spark.createDataFrame(out, SCHEMA)


def base(spark, days=3):
    return readings(spark, [(i, i, 70 + i, 48 + i, "good", "camera") for i in range(days)])


def score(spark, reading, rest):
    stats = C.baselines(rest, "user_id", K.MODEL_FEATURES)
    return as_dicts(S.score_readings(reading, stats, S.baseline_carries(rest, "user_id")))[0]


def test_no_score_before_three_days(spark):
    r = readings(spark, [(9, 9, 90, 30, "good", "camera")])
    assert score(spark, r, base(spark, 2))["fused"] is None
    same = readings(spark, [(1, 1, 70, 48, "good", "camera"), (2, 1.1, 71, 47, "good", "camera"), (3, 2, 72, 46, "good", "camera")])
    assert as_dicts(C.baselines(same, "user_id", ["hr_mean"]))[0]["n"] == 2
    assert as_dicts(C.baselines(same, "user_id", ["hr_mean"], count="windows"))[0]["n"] == 3


def test_high_heart_rate_reads_as_stress(spark):
    s = score(spark, readings(spark, [(9, 9, 88, 48, "good", "camera")]), base(spark))
    assert s["score_hr"] > 0.2 and s["fused"] is not None


def test_camera_variability_counts_only_when_good(spark):
    assert score(spark, readings(spark, [(9, 9, 80, 30, "fair", "camera")]), base(spark))["score_hrv"] is None
    assert score(spark, readings(spark, [(9, 9, 80, 30, "good", "camera")]), base(spark))["score_hrv"] is not None
    assert score(spark, readings(spark, [(9, 9, 80, 30, "fair", "ble-hr")]), base(spark))["score_hrv"] is not None


def test_reasons_for_missing_signals(spark):
    r = as_dicts(S.usable_signals(readings(spark, [(9, 9, 80, 30, "fair", "camera")])), "signal")
    assert [x["signal"] for x in r if not x["used"]] == ["eda", "hrv", "temp"]
    assert "wearable" in r[0]["reason"] and r[2]["reason"].startswith("Needs a good signal; the camera's was fair")


def test_model_values(spark):
    d = spark.createDataFrame([(2.0, -1.0, 0.5)], "z_hr_mean double, z_rmssd double, z_sdnn double")
    r = as_dicts(S.fuse(S.score_signals(d, signals=["hr", "hrv"]), signals=["hr", "hrv"]))[0]
    hr = K.MODEL_INTERCEPT["hr"] + 2 * K.MODEL_COEF["hr_mean"]
    hrv = K.MODEL_INTERCEPT["hrv"] - K.MODEL_COEF["rmssd"] + 0.5 * K.MODEL_COEF["sdnn"]
    assert r["logit_hr"] == pytest.approx(hr) and r["logit_hrv"] == pytest.approx(hrv)
    assert r["fused"] == pytest.approx(2 / (1 + math.exp(-(hr + hrv) / 2)) - 1)


def test_contributions_add_up_to_the_logit(spark):
    d = spark.createDataFrame([(2.0, None)], "z_rmssd double, z_sdnn double")
    r = d.select(S.signal_logit("hrv").alias("l"), F.aggregate(S.contributions("hrv"), F.lit(0.0), lambda s, c: s + c["value"]).alias("c")).first()
    assert r["l"] == pytest.approx(r["c"] + K.MODEL_INTERCEPT["hrv"])


def test_fusion_clips_excludes_and_handles_none(spark):
    d = spark.createDataFrame([(50.0, -1.0), (None, None)], "a double, b double")
    limit = math.log((1 - 1e-6) / 1e-6)
    both = [r[0] for r in d.select(S.fused_logit([F.col("a"), F.col("b")])).collect()]
    assert both == [pytest.approx((limit - 1) / 2), None]
    assert d.select(S.fused_logit([F.col("a"), F.col("b")], [F.lit(False), F.lit(True)])).first()[0] == -1
    assert [r[0] for r in d.select(S.fused_logit([F.col("a")], empty="zero")).collect()][1] == 0


def test_calibration_floor_and_single_value(spark):
    d = spark.createDataFrame([("a", 60.0), ("a", 60.1), ("b", 70.0), ("c", None)], "o string, hr_mean double")
    s = {r["o"]: r for r in as_dicts(C.owner_stats(d, ["o"], ["hr_mean"]))}
    assert s["a"]["sd_hr_mean"] == 1.0 and s["b"]["sd_hr_mean"] == 1.0
    assert s["c"]["mean_hr_mean"] is None and s["c"]["sd_hr_mean"] is None


def test_calibration_is_scale_and_shift_free(spark):
    d = spark.createDataFrame([("a", float(v)) for v in (60, 64, 71, 80)], "o string, x double")
    moved = d.withColumn("x", F.col("x") * 3 + 11)
    z = lambda df: [round(r["z_x"], 9) for r in as_dicts(C.zscores(df, C.owner_stats(df, ["o"], ["x"]), ["o"], ["x"]), "x")]
    assert z(d) == z(moved)


def test_reference_windows(spark):
    d = spark.createDataFrame([("a", float(15 * i), 1) for i in range(40)] + [("b", 0.0, 2)], "o string, t double, label int")
    assert C.reference_mask(d, ["o"], "t", "label").filter("is_ref").count() == 17
    assert C.reference_mask(d, ["o"], "t", "label", mode="baseline").filter("is_ref").count() == 40
    assert C.reference_mask(d, ["o"], "t", "label", mode="none").filter("is_ref").count() == 0


GOOD = "Your heart rate sits a little above rest. That can follow a busy morning. A short walk may help."


@pytest.mark.parametrize("text,ok", [
    (GOOD, True), ("  " + GOOD.replace(". ", ".\n"), True), ("- " + GOOD, False), ("**Note** " + GOOD, False),
    ("As an AI, I cannot say. " + GOOD, False), ("Short.", False), (GOOD + " One. Two. Three.", False), ("x" * 601, False)])
def test_note_filter(spark, text, ok):
    r = spark.createDataFrame([(text,)], "t string").select(W.acceptable_note(F.col("t")).alias("a")).first()[0]
    assert (r is not None) == ok


def test_fixed_and_signed(spark):
    from pulsegrid.functions.scalar import round_significant, round_up, signed
    d = spark.createDataFrame([(-0.001,), (-1.255,), (2.5,), (0.0,)], "x double")
    assert [r[0] for r in d.select(W.fixed(F.col("x"), 1)).collect()] == ["0.0", "−1.3", "2.5", "0.0"]
    assert [r[0] for r in d.select(signed(F.col("x"), 1)).collect()] == ["0.0", "−1.3", "+2.5", "0.0"]
    assert [r[0] for r in d.select(round_up(F.col("x") * 100 / 100)).collect()] == [0, -1, 3, 0]
    assert spark.range(1).select(round_significant(F.lit(0.000123456), 3)).first()[0] == pytest.approx(0.000123)


def test_models_of_a_table_meet_rows_dealt_by_key(spark):
    """No task gets all rows of a feature, and groups are added up only where their rows have met."""
    rows = [(k, f, None if k % 3 == 0 and f == "sdnn" else k / 7 - 1) for k in range(50) for f in ("hr_mean", "rmssd", "sdnn")]
    z = spark.createDataFrame(rows, "id long, feature string, z double")
    d = S.score_with_models(z, S.model_table(spark), ["id"])
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(feature" not in plan and plan.count("Exchange hashpartitioning(id") == 1
    got = {(r["id"], r["signal"]): r["logit"] for r in d.collect()}
    assert len(got) == 100
    for k, f, v in rows:
        if f == "hr_mean":
            assert got[k, "hr"] == pytest.approx(K.MODEL_INTERCEPT["hr"] + K.MODEL_COEF["hr_mean"] * v)
    z = {(k, f): v or 0 for k, f, v in rows}
    assert all(got[k, "hrv"] == pytest.approx(K.MODEL_INTERCEPT["hrv"] + sum(K.MODEL_COEF[f] * z[k, f] for f in ("rmssd", "sdnn"))) for k in range(50))
