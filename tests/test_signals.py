import math

import numpy as np
import pytest

from conftest import as_dicts
from pulsegrid.operators import pulse as P
from pulsegrid.operators import signals as S


def test_filter_design_has_butterworth_response():
    for sections, fs, f3 in ((S.butterworth(2, None, 1.0, 4), 4, 1.0), (S.butterworth(3, 0.7, 3.5, 64), 64, 0.7), (S.butterworth(3, 5, 20, 700), 700, 20), (S.butterworth(2, 0.7, None, 60), 60, 0.7)):
        z = np.exp(2j * np.pi * f3 / fs)
        h = np.prod([np.polyval(b, z) / np.polyval(a, z) * z ** (len(a) - len(b)) for b, a in sections])
        assert abs(h) == pytest.approx(1 / math.sqrt(2), abs=1e-9)


def test_zero_phase_keeps_a_constant_and_is_linear():
    x = np.random.default_rng(0).normal(size=(3, 240))
    assert S.zero_phase(S.TONIC, np.full((1, 240), 2.5), pad=9) == pytest.approx(2.5)
    assert S.zero_phase(S.SMOOTH, x[:1] + 2 * x[1:2], pad=9) == pytest.approx(S.zero_phase(S.SMOOTH, x[:1], pad=9) + 2 * S.zero_phase(S.SMOOTH, x[1:2], pad=9))


def test_peaks_on_hand_arrays():
    p, prom = S.find_peaks(np.array([0, 1, 0, 3, 0, 2, 2, 2, 0, 1, 0], float))
    assert p.tolist() == [1, 3, 6, 9] and prom.tolist() == [1, 3, 2, 1]
    assert S.find_peaks(np.array([0, 1, 0, 3, 0, 2, 2, 2, 0, 1, 0], float), prominence=1.5)[0].tolist() == [3, 6]
    assert S.find_peaks(np.array([0, 2, 1, 3, 1, 2, 0], float), distance=3)[0].tolist() == [3]
    assert S.find_peaks(np.array([0, 1, 1, 0], float))[0].tolist() == [1]
    assert S.find_peaks(np.ones(5))[0].tolist() == []


def brute_peaks(x, distance, prominence):
    n, peaks, i = len(x), [], 1
    while i < n - 1:
        if x[i - 1] < x[i]:
            j = i
            while j < n - 1 and x[j + 1] == x[i]:
                j += 1
            if j < n - 1 and x[j + 1] < x[i]:
                peaks.append((i + j) // 2)
            i = j
        i += 1
    order = sorted(range(len(peaks)), key=lambda k: (x[peaks[k]], k), reverse=True)
    alive = set(range(len(peaks)))
    for k in order:
        if k in alive:
            alive -= {m for m in alive if m != k and abs(peaks[m] - peaks[k]) < distance}
    out = []
    for k in sorted(alive):
        p = peaks[k]
        lo = next((q for q in range(p, -1, -1) if x[q] > x[p]), -1)
        hi = next((q for q in range(p, n) if x[q] > x[p]), n)
        if x[p] - max(min(x[lo + 1:p + 1]), min(x[p:hi])) >= prominence:
            out.append(p)
    return out


def test_peaks_match_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(60):
        x = np.round(np.cumsum(rng.normal(size=60)) + rng.normal(size=60), 1)
        d, pr = int(rng.integers(1, 8)), float(rng.choice([0, 0.5, 1.5]))
        assert S.find_peaks(x, distance=d, prominence=pr)[0].tolist() == brute_peaks(x.tolist(), d, pr)


def test_skin_conductance_counts_responses(spark):
    t = np.arange(240) / 4
    bumps = sum(0.1 * np.where(t >= c, np.exp(-(t - c) / 4) - np.exp(-(t - c) / 0.75), 0) for c in (10, 35))
    d = spark.createDataFrame([(1, (0.8 + 0.002 * t + bumps).tolist()), (2, [1.0] * 240)], "k int, eda array<double>")
    r = as_dicts(S.eda_features(d), "k")
    assert r[0]["scr_count"] == 2 and 0.03 < r[0]["scr_amp"] < 0.1
    assert r[1]["scr_count"] == 0 and r[1]["scr_amp"] == 0 and r[1]["eda_tonic"] == pytest.approx(1)


@pytest.mark.parametrize("opts", [{}, {"block_rows": 4, "bounded": False}], ids=["plain", "blocks"])
def test_windows_from_chunks(spark, opts):
    n = 60 * 4 * 4 + 7
    d = spark.range(n).selectExpr("'a' AS o", "id AS idx", "id * 0.01 AS temp").filter("idx <> 700")
    w = as_dicts(S.temp_features(S.window_arrays(d, ["o"], "idx", ["temp"], fs=4, **opts)), "win")
    assert [r["win"] for r in w] == [0, 60, 120, 180, 240, 300, 360, 420, 720] and all(len(r["temp"]) == 240 for r in w)
    assert w[0]["temp_mean"] == pytest.approx(1.195) and w[0]["temp_slope"] == pytest.approx(2.4)


def test_pulse_beats_follow_the_rate(spark):
    t = np.arange(3840) / 64
    d = spark.createDataFrame([(1, np.sin(2 * np.pi * 1.25 * t).tolist())], "k int, bvp array<double>")
    r = as_dicts(S.pulse_features(d, ["k"]))[0]
    assert r["hr_mean"] == pytest.approx(75, abs=0.3) and r["hrv_valid"] and r["rmssd"] < 5


def test_ecg_peaks_across_blocks(spark):
    fs, n = 70, 70 * 33
    beats = np.arange(30, n, 56)
    x = np.zeros(n)
    for b in beats:
        x += -1.0 * np.exp(-0.5 * ((np.arange(n) - b) / 1.2) ** 2)      # inverted lead
    d = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "o string, i long, v double")
    got = [r["peak"] for r in as_dicts(S.ecg_r_peaks(d, ["o"], "i", "v", fs=fs, block_s=5), "peak")]
    inner = [b for b in beats if 70 < b < n - 70]
    assert all(min(abs(g - b) for g in got) <= 1 for b in inner) and all(b - a >= 21 for a, b in zip(got, got[1:]))


@pytest.mark.parametrize("block,scan", [(60, 256), (137, 2), (1000, 256), (5000, 3)])
def test_filter_in_blocks_equals_one_pass(spark, monkeypatch, block, scan):
    """With a step, a gap in the numbers, a second owner, a run that is too short and a last block shorter than the extension."""
    from pulsegrid.operators import filters as B
    monkeypatch.setattr(B, "SCAN", scan)
    rng = np.random.default_rng(7)
    sections = S.butterworth(3, 5.0, 20.0, 250)
    runs = {("a", 10): rng.normal(size=1000) + np.r_[np.zeros(400), np.full(600, 50.0)], ("a", 2000): np.cumsum(rng.normal(size=1203)), ("a", 9000): rng.normal(size=15),
            ("b", 0): rng.normal(size=block * 2 + 3), ("b", 99_999): rng.normal(size=30)}
    rows = [(o, first + i, float(v)) for (o, first), x in runs.items() for i, v in enumerate(x)]
    d = spark.createDataFrame(rows, "o string, i long, v double").repartition(4)
    for opts in ({}, {"block_rows": 90, "bounded": False}):
        got = {}
        for r in B.zero_phase_blocks(d, ["o"], "i", "v", sections, block=block, **(opts if block == 60 else {})).collect():
            got.setdefault(r["o"], {}).update({r["start"] + k: v for k, v in enumerate(r["x"])})
        want = {}
        for (o, first), x in runs.items():
            if len(x) > 21:
                want.setdefault(o, {}).update({first + k: v for k, v in enumerate(S.zero_phase(sections, x[None, :])[0])})
        assert got.keys() == want.keys()
        for o in want:
            assert got[o].keys() == want[o].keys() and max(abs(got[o][k] - want[o][k]) for k in want[o]) < 1e-9


def frames(bpm, fps=30, seconds=60, noise=0.05, burst=None, drop=None, seed=1):
    rng = np.random.default_rng(seed)
    t = np.arange(int(seconds * fps)) * 1000 / fps
    rr = 60000 / bpm
    onset, at = [], -rr / 2
    while at < seconds * 1000 + 1000:
        onset.append(at)
        at += rr * (1 + 0.04 * math.sin(2 * math.pi * 0.25 * at / 1000)) + rng.normal(0, 8)
    dt = (t[:, None] - np.array(onset)[None, :]) / 1000
    p = (np.exp(-((dt - 0.15) / 0.07) ** 2 / 2) + 0.35 * np.exp(-((dt - 0.42) / 0.09) ** 2 / 2)).sum(axis=1)
    shake = np.zeros(len(t))
    if burst:
        on = (t >= burst[0] * 1000) & (t < burst[1] * 1000)
        shake[on] = np.cumsum(rng.normal(0, 12, on.sum()))
    keep = np.ones(len(t), bool) if not drop else ~((t >= drop[0] * 1000) & (t < drop[1] * 1000))
    r = 205 - 3 * p + 1.5 * np.sin(2 * np.pi * 0.12 * t / 1000) + shake + rng.normal(0, 3 * noise, len(t))
    g = 38 - 1.5 * p + 0.3 * shake + rng.normal(0, 3 * noise, len(t))
    true = np.diff([o for o in onset if 0 < o < seconds * 1000])
    rows = [(float(a), float(b), float(c), 22.0) for a, b, c, k in zip(t, r, g, keep) if k]
    acc = [(float(a), float(abs(rng.normal(0, 2.5 if s else 0.03)))) for a, s in zip(t, shake != 0)]
    return rows, acc, 60000 / true.mean()


def test_pulse_readings(spark):
    cases = {"50": frames(50), "75": frames(75, fps=24), "120": frames(120, fps=60), "noisy": frames(90, noise=0.3, seed=5),
             "burst": frames(80, burst=(10, 40), seed=3), "drop": frames(70, drop=(30, 31.2), seed=9)}
    f = spark.createDataFrame([(k, *r) for k, (rows, _, _) in cases.items() for r in rows] + [("bare", i * 33.3, 120 + math.sin(i) * 0.3, 118.0, 110.0) for i in range(300)],
                              "reading string, t_ms double, r double, g double, b double")
    acc = spark.createDataFrame([(k, *a) for k, (_, ms, _) in cases.items() for a in ms], "reading string, t_ms double, a double")
    readings = spark.createDataFrame([(k, k != "75") for k in [*cases, "bare"]], "reading string, torch boolean")
    out = {r["reading"]: r for r in as_dicts(P.measure(f, readings, acc))}
    for k in ("50", "75", "120", "drop"):
        assert abs(out[k]["hr_mean"] - cases[k][2]) <= 2, k
    assert abs(out["noisy"]["hr_mean"] - cases["noisy"][2]) <= 5
    assert out["50"]["quality"] == "good" and out["75"]["quality"] == "fair" and out["120"]["quality"] == "good"
    assert out["burst"]["quality"] == "poor" and out["burst"]["motion_flagged"] and "still" in out["burst"]["why"]
    assert out["bare"]["quality"] == "poor" and out["bare"]["why"].startswith("Cover the lens")


def test_no_interval_spans_a_gap(spark):
    rows, _, _ = frames(70, drop=(30, 31.2), seed=9)
    f = spark.createDataFrame([("a", *r) for r in rows], "reading string, t_ms double, r double, g double, b double")
    masked = P.motion_mask(P.resample(f))
    rr = [r["rr_ms"] for r in as_dicts(P.beat_intervals(P.waves(masked), masked), "k")]
    assert None in rr and max(x for x in rr if x) < 1.3 * 60000 / 70


def test_tonic_weights_equal_the_filters(spark):
    rng = np.random.default_rng(2)
    d = spark.createDataFrame([(i, (2 + np.cumsum(rng.normal(0, 0.02, 240))).tolist()) for i in range(5)], "k int, eda array<double>")
    a, b = as_dicts(S.tonic_features(d), "k"), as_dicts(S.eda_features(d), "k")
    for x, y in zip(a, b):
        assert x["eda_tonic"] == pytest.approx(y["eda_tonic"], abs=1e-9) and x["eda_slope"] == pytest.approx(y["eda_slope"], abs=1e-9)


def test_a_grid_is_not_joined_with_itself(spark):
    """The plan knows a grid by its readings only, so a join with one would broadcast all its samples through the driver."""
    f = spark.createDataFrame([(r, i * 33.0, 180 + math.sin(i / 4), 60.0, 40.0) for r in ("x", "y") for i in range(200)] + [(None, 0.0, 1.0, 1.0, 1.0)],
                              "reading string, t_ms double, r double, g double, b double")
    acc = spark.createDataFrame([(r, i * 20.0, float(i % 7)) for r in ("x", "y") for i in range(300)], "reading string, t_ms double, a double")
    grid = P.resample(f)
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan(grid)
    rows = as_dicts(grid, "reading", "i")
    assert [(r["reading"], r["i"]) for r in rows] == [(r, i) for r in ("x", "y") for i in range(395)] and all(r["t_ms"] == pytest.approx(r["i"] * 1000 / 60) for r in rows)
    merged = plan(P.motion_mask(grid, acc))
    assert not [x for x in merged.splitlines() if "BroadcastHashJoin" in x and ("_tick" in x or "_k#" in x)] and merged.count("SortMergeJoin [reading") >= 2
