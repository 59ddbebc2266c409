import math
import random

import pytest
from pyspark.sql import functions as F

from conftest import as_dicts
from pulsegrid.operators import joins as J
from pulsegrid.operators import legacy as L
from pulsegrid.operators import sessions as S
from pulsegrid.operators import windows as W

BLOCKS = pytest.mark.parametrize("opts", [{}, {"block_rows": 6, "bounded": False}], ids=["plain", "blocks"])


@BLOCKS
def test_asof_nearest_matches_brute_force(spark, opts):
    rng = random.Random(4)
    left = [("a" if i % 5 else "b", i, rng.randint(0, 200)) for i in range(60)] + [("c", 99, 5)]
    right, seen = [], set()
    for i in range(50):
        k, t = ("a", "b")[i % 2], rng.randint(0, 200)
        if (k, t) not in seen:
            seen.add((k, t))
            right.append((k, i, t, float(i)))
    lo = spark.createDataFrame(left, "o string, id long, t long")
    re = spark.createDataFrame(right, "o string, rid long, rt long, v double")
    got = {r["id"]: r for r in as_dicts(J.asof_nearest(lo, re, ["o"], t="t", left_id="id", right_t="rt", right_id="rid", values=["v"], **opts))}
    near = {r["id"]: r for r in as_dicts(J.asof_nearest(lo, re, ["o"], t="t", left_id="id", right_t="rt", right_id="rid", values=["v"], tolerance=3, **opts))}
    for o, i, t in left:
        mine = [r for r in right if r[0] == o]
        best = min(mine, key=lambda r: (abs(r[2] - t), r[2])) if mine else None
        assert (got[i]["rt"], got[i]["v"]) == ((best[2], best[3]) if best else (None, None))
        assert (near[i]["v"] is not None) == bool(best and abs(best[2] - t) < 3)


@BLOCKS
def test_interpolation_holds_ends_and_marks_gaps(spark, opts):
    s = spark.createDataFrame([("a", 0.0, 0.0), ("a", 100.0, 10.0), ("a", 600.0, 60.0)], "o string, t double, v double")
    g = spark.createDataFrame([("a", float(x)) for x in (-50, 0, 25, 100, 350, 600, 700)], "o string, g double")
    r = as_dicts(J.interpolate_at(g, s, ["o"], t="g", sample_t="t", values=["v"], max_gap=250, **opts), "g")
    assert [x["v"] for x in r] == [0, 0, 2.5, 10, 35, 60, 60]
    assert [x["valid"] for x in r][1:5] == [True, True, False, False]


def test_uniform_grid(spark):
    s = spark.createDataFrame([("a", 1000), ("a", 2010), ("b", 5)], "o string, t long")
    g = as_dicts(J.uniform_grid(s, ["o"], "t", 10.0), "o", "grid_idx")
    assert len(g) == 12 and g[10]["grid_t"] == 2000.0 and g[11]["grid_t"] == 5.0


def test_bucketed_interval_equals_range_join(spark):
    p = spark.range(0, 400, 3).selectExpr("'a' AS o", "id AS t")
    s = spark.createDataFrame([("a", i * 37, i * 37 + 50) for i in range(10)], "o string, s long, e long")
    a = J.bucketed_interval(p, s, ["o"], t="t", start="s", end="e", bucket=40)
    b = J.in_interval(p, s, ["o"], t="t", start="s", end="e")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))


def test_label_spans_follow_rounded_edges(spark):
    n = 700
    d = spark.range(n).selectExpr("'a' AS o", "id AS idx", "CAST(id % 3 AS INT) AS label")
    got = {r["target_idx"]: r["label"] for r in as_dicts(W.label_over_span(d, ["o"], idx="idx", fs=32, label_fs=700, label="label"))}
    import numpy as np
    edges = np.round(np.arange(33) * 700 / 32).astype(int)
    for i in range(32):
        assert got[i] == np.bincount(np.arange(n)[edges[i]:edges[i + 1]] % 3).argmax()


def beats(spark, rr=True):
    rows, t = [], 0.0
    while t < 600000:
        s = t / 1000
        hr = 70 if s < 180 else 88 if s < 420 else 70 + 18 * math.exp(-(s - 420) / 40)
        step = 60000 / (hr + 2 * math.sin(s))
        t += step
        rows.append(("x", round(t), step if rr else None, round(hr)))
    return spark.createDataFrame(rows, "session string, t_ms long, rr_ms double, hr long")


def phases(spark):
    return spark.createDataFrame([("x", "rest", 0, 180000), ("x", "challenge", 180000, 420000), ("x", "recovery", 420000, 600000)],
                                 "session string, phase string, start_ms long, end_ms long")


def test_session_summary(spark):
    p, b = phases(spark), beats(spark)
    start = S.phase_table(p).select("session", "t0")
    series = S.hr_series(b, start)
    assert series.count() >= 119 and series.agg(F.min("t")).first()[0] == 2.5 and S.rmssd_series(b, start).count() > 30
    n = S.summary_numbers(series, p)
    r = as_dicts(n)[0]
    assert r["rest_hr"] == pytest.approx(70, abs=0.5) and r["hr_rise"] == pytest.approx(18, abs=0.5) and 25 <= r["recovery_half_time_s"] <= 42
    info = spark.createDataFrame([("x", "Strap", False, "recovery")], "session string, device string, aborted boolean, last_phase string")
    runs = spark.createDataFrame([("x", "rest", 1, "follow-dot", {"meanErrorPct": 4.0, "onTargetPct": 60.0}), ("x", "challenge", 2, "follow-dot", {"meanErrorPct": 6.0, "onTargetPct": 60.0})],
                                 "session string, phase string, started_ms long, activity string, metrics map<string, double>")
    text = S.summary_text(n, S.probe_changes(runs), info).first()["summary"]
    assert "rose 18 bpm during the challenge, from 70 at rest to 88" in text and "seconds into paced breathing" in text
    assert "your tracking changed: distance off the dot 50% higher than at rest" in text


def test_rest_readings_with_and_without_intervals(spark):
    r = as_dicts(S.rest_readings(beats(spark), phases(spark)), "win_start")
    assert [x["win_start"] for x in r] == [60000, 75000, 90000, 105000, 120000] and r[0]["rmssd"] > 0
    r = as_dicts(S.rest_readings(beats(spark, rr=False), phases(spark)))
    assert len(r) == 5 and r[0]["rmssd"] is None and r[0]["hr_mean"] == 70


@BLOCKS
def test_hysteresis(spark, opts):
    rng = random.Random(6)
    flags = [rng.random() < 0.55 for _ in range(300)]
    d = spark.createDataFrame([("a", i, f) for i, f in enumerate(flags)], "o string, i long, hot boolean")
    c, state, want = 0, None, []
    for f in flags:
        c = c + 1 if f else max(0, c - 1)
        state = "STRESSED" if c >= 15 else "CALM" if c == 0 else state
        want.append((c, state))
    assert [(r["counter"], r["state"]) for r in as_dicts(L.hysteresis(d, ["o"], ["i"], "hot", **opts), "i")] == want


@BLOCKS
def test_blink_rate(spark, opts):
    rng = random.Random(7)
    closed = [rng.random() < 0.3 for _ in range(200)]
    d = spark.createDataFrame([("a", i * 500, c) for i, c in enumerate(closed)], "o string, t long, closed boolean")
    on = [i * 500 for i, c in enumerate(closed) if c and (i == 0 or not closed[i - 1])]
    for r in as_dicts(L.blink_rate(d, ["o"], "t", "closed", **opts), "t"):
        assert r["blink_rate"] == 2 * sum(r["t"] - 30000 < x <= r["t"] for x in on)


@BLOCKS
def test_runs_of_windows(spark, opts):
    d = spark.createDataFrame([("a", t) for t in (0, 15, 30, 75, 90, 200)], "o string, t long")
    r = as_dicts(W.runs_of_rows(d, ["o"], "t", step=15, **opts), "run")
    assert [(x["run_start"], x["run_end"], x["n"]) for x in r] == [(0, 30, 3), (75, 90, 2), (200, 200, 1)]
