import math
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import as_dicts
from pulsegrid.operators import beats as B
from pulsegrid.operators.windows import assign_windows
from pulsegrid.session import new_folder
from pulsegrid import constants as K
from pulsegrid.streaming import live as L
from pulsegrid.streaming import replay as P
from pulsegrid.streaming import versioned as V

T0 = datetime(2024, 3, 1, 8)


@pytest.fixture
def beat_files(spark, tmp_path):
    rng = random.Random(3)
    rows, t = [], 0
    for _ in range(700):
        rr = rng.choice([780, 800, 810, 830, 1600 if rng.random() < 0.05 else 790])
        t += rr
        rows.append(("a", t, float(rr)))
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "owner string, t_ms long, rr_ms double").withColumn("ts", F.timestamp_millis(F.col("t_ms") + int(T0.timestamp() * 1000)))
    d.repartition(3).write.parquet(str(tmp_path / "in"))
    return d, str(tmp_path / "in")


def test_sliding_windows_equal_batch(spark, beat_files):
    batch, folder = beat_files
    s = spark.readStream.schema(batch.schema).parquet(folder)
    got = as_dicts(L.run_once(L.stream_windows(s, watermark="10 seconds"), new_folder(spark, "t")), "win_start")
    zero = int(T0.timestamp() * 1000)
    placed = assign_windows(batch.select("owner", (F.col("t_ms") + zero).alias("t_ms"), "rr_ms"), "t_ms")
    want = {r["win_start"]: r for r in as_dicts(B.beat_features(placed, ["owner", "win_start"], ["t_ms"]))}
    assert len(got) >= len(want) - 5 and len(got) > 30
    for r in got:
        w = want[int(r["win_start"].timestamp() * 1000)]
        for c in ("hr_mean", "rmssd", "sdnn", "coverage", "rejected"):
            assert r[c] == (None if w[c] is None else pytest.approx(w[c])), c
        assert r["n_beats"] == w["n_beats"]


def test_bins(spark, beat_files):
    batch, folder = beat_files
    s = spark.readStream.schema(batch.schema).parquet(folder).withColumn("hr", F.lit(70.0))
    got = as_dicts(L.run_once(L.hr_bins(s, "owner", "ts", "rr_ms", "hr", watermark="10 seconds"), new_folder(spark, "t")))
    assert len(got) > 80 and all((r["win_end"] - r["win_start"]) == timedelta(seconds=5) for r in got)


def run_state(spark, tmp_path, rows, schema, op, want):
    """Rows through a stateful operator into a memory table, until `want` holds for its rows or time is up.

    Processing-time timers keep a stream busy, so it is polled rather than waited for.
    """
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    name = f"t{random.randrange(10**9)}"
    q = (op(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName(name).outputMode("append")
         .trigger(processingTime="200 milliseconds").option("checkpointLocation", str(tmp_path / "c")).start())
    try:
        for _ in range(80):
            time.sleep(0.5)
            got = [r.asDict() for r in spark.table(name).collect()]
            if want(got):
                return got
            if q.exception():
                raise q.exception()
        return got
    finally:
        q.stop()


FAR = 10 ** 10      # a row that moves the watermark past all others


def replayed(spark, tmp_path, rows, schema, op, key, files=1):
    """Rows through an event-time operator, in some files taken one by one; sorted output."""
    names = [f.split()[0] for f in schema.split(", ")]
    t = names.index("now_ms") if "now_ms" in names else names.index("t_ms")
    end = tuple("~" if n == key else FAR if k == t else None for k, n in enumerate(names))
    folder = new_folder(spark, "replay")
    for k in range(files):      # by time, so that no row is late
        part = sorted(rows, key=lambda r: r[t])[k * len(rows) // files:(k + 1) * len(rows) // files] + [end] * (k == files - 1)
        random.Random(k).shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    with P.with_rocks(spark):
        out = L.run_once(op(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)), new_folder(spark, "t"))
    return sorted((tuple(r) for r in out.collect()), key=str)


PACKETS = "device string, t_ms long, rr_ms double, contact boolean, battery long"


def packets(seed=1):
    rng, rows = random.Random(seed), []
    for d in "ab":
        t = 0
        for n in range(90):
            t += rng.choice([800, 820, 790, 1700, 300]) if rng.random() < 0.9 else rng.choice([4000, 4001, 5000, 9000, 60_000])
            rows.append((d, t, None if rng.random() < 0.1 else float(rng.choice([800, 810, 790, 1500, 250])), rng.choice([True, True, True, True, None, False]),
                         rng.choice([None, None, 90, 80])))
    return rows


def slow_quality(rows, trailing=20_000, silent=4000):
    """The rule of the feature, one packet at a time over stored intervals."""
    from statistics import median
    out = []
    for d in sorted({r[0] for r in rows}):
        shown, mine = "", sorted((r for r in rows if r[0] == d), key=lambda r: (r[1], r[2] is not None, r[2] or 0))
        for i, (_, t, rr, contact, _) in enumerate(mine):
            if i and t - mine[i - 1][1] > silent and shown != "poor":
                shown = "poor"
                out.append((d, mine[i - 1][1] + silent, "poor"))
            seen = [r[2] for r in mine[:i + 1] if r[1] > t - trailing and r[2] is not None and r[3] is not False]
            usual = [x for x in seen if 300 <= x <= 2000]
            clean = []
            for j, x in enumerate(usual):
                near = usual[max(0, j - K.RR_NEIGHBOURS):j] + usual[j + 1:j + 1 + K.RR_NEIGHBOURS]
                if len(near) < 2 or abs(x - median(near)) <= K.RR_MAX_DEVIATION * median(near):
                    clean.append(x)
            if contact is False:
                q = "poor"
            elif not seen:
                q = "fair"
            elif len(clean) < 3:
                q = "poor"
            else:
                cover, bad = len(clean) * median(clean) / trailing, 1 - len(clean) / len(seen)
                q = "good" if cover >= 0.9 and bad <= 0.05 else "fair" if cover >= K.HRV_COVERAGE and bad <= 0.2 else "poor"
            if q != shown:
                shown = q
                out.append((d, t, q))
        if shown != "poor":
            out.append((d, mine[-1][1] + silent, "poor"))
    return sorted(out, key=str)


@pytest.mark.parametrize("files", [1, 7])
def test_quality_is_emitted_on_change(spark, tmp_path, files):
    rows = packets()
    assert replayed(spark, tmp_path, rows, PACKETS, P.live_quality, "device", files) == slow_quality(rows)


def test_quality_of_a_steady_strap(spark, tmp_path):
    rows = [("s", i * 800, 800.0, True, None) for i in range(60)] + [("s", 48000 + i * 800, 800.0, False, None) for i in range(3)]
    got = replayed(spark, tmp_path, rows, PACKETS, P.live_quality, "device")
    seen = [r[2] for r in sorted(got, key=lambda r: r[1])]
    assert seen == ["poor", "fair", "good", "poor"] or (seen[0] == "poor" and seen[-2:] == ["good", "poor"])


@pytest.mark.parametrize("files", [1, 5])
def test_gaps(spark, tmp_path, files):
    rows, want = packets(3), []
    for d in "ab":
        t = sorted(r[1] for r in rows if r[0] == d)
        for a, b in zip(t, [*t[1:], FAR]):
            due = [(a + 4000 + x, e, n) for x, e, n in ((0, "retry", 1), (1000, "retry", 2), (3000, "retry", 3), (7000, "retry", 4), (15000, "retry", 5), (31000, "gone", 5)) if a + 4000 + x < b]
            want += [(d, *x) for x in due]
            if due and b != FAR:
                want.append((d, b, "back", min(len(due), 5)))
    assert replayed(spark, tmp_path, rows, PACKETS, P.connection_gaps, "device", files) == sorted(want, key=str)


@pytest.mark.parametrize("files", [1, 6])
def test_device_state(spark, tmp_path, files):
    rows, want = packets(5), []
    for d in "ab":
        has, battery, before = False, None, None
        for _, t, rr, contact, level in sorted((r for r in rows if r[0] == d), key=lambda r: [(v is not None, v) for v in r[1:]]):
            has, battery = has or rr is not None, battery if level is None else level
            if (contact, has, battery) != before:
                want.append((d, t, contact, has, battery))
            before = (contact, has, battery)
    assert replayed(spark, tmp_path, rows, PACKETS, P.device_state, "device", files) == sorted(want, key=str)


@pytest.mark.parametrize("files", [1, 4])
def test_retention(spark, tmp_path, files):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), 2000 * (n + 1), rng.choice(["beats", "frames", "acceleration", "samples", "keystrokes", "other"])) for n in range(900)]
    want = []
    for d, t, kind in rows:
        mine = sorted(x for e, x, k in rows if (e, k) == (d, kind) and x <= t)
        mine = [x for x in mine if x >= t - P.KEEP_MS[kind]] if kind in P.KEEP_MS else mine[-P.KEEP_ROWS.get(kind, 1):]
        want.append((d, t, kind, len(mine), mine[0]))
    assert replayed(spark, tmp_path, rows, "device string, t_ms long, kind string", P.retained, "device", files) == sorted(want, key=str)


def test_held_back_beats(spark, tmp_path):
    rows = [("r", float(t), 10_000) for t in (0, 800, 900, 1600, 2400, 9700)]
    got = sorted(replayed(spark, tmp_path, rows, "reading string, t_ms double, now_ms long", P.held_back_beats, "reading"), key=lambda r: r[1])
    assert [(r[1], r[2]) for r in got] == [(800, 800), (1600, 800), (2400, 800)] and got[-1][3] == 75


@pytest.mark.parametrize("files", [1, 5])
def test_beats_of_repeated_looks(spark, tmp_path, files):
    rng = random.Random(8)
    beats, t = [], 0.0
    for _ in range(60):
        t += rng.choice([700.0, 810.0, 240.0, 2500.0, 650.5])
        beats.append(t)
    looks = [(now, [b + rng.choice([0, 0, 20]) for b in beats if now - 6000 <= b <= now]) for now in range(1000, 50_000, 500)]
    rows = [("r", b, now) for now, seen in looks for b in seen]
    last, rates, want = -1e9, [], []
    for _, b, now in sorted(rows, key=lambda r: (r[2], r[1])):
        if b > last + 250 and b <= now - 350:
            gap, last = b - last, b
            if 300 <= gap <= 2000:
                rates.append(60000 / gap)
            if rates:
                w = sorted(rates[-5:])
                want.append(("r", b, gap if 300 <= gap <= 2000 else None, w[len(w) // 2]))
    got = replayed(spark, tmp_path, rows, "reading string, t_ms double, now_ms long", P.held_back_beats, "reading", files)
    assert len(want) > 30 and got == [(k, t, rr, pytest.approx(hr)) for k, t, rr, hr in sorted(want, key=str)]


def test_trace_batch_equals_stream(spark, tmp_path):
    import math
    rows = [("r", i * 33.3, 200 + 3 * math.sin(i / 3) + (60 if 300 < i < 320 else 0)) for i in range(600)]
    schema = "reading string, t_ms double, r double"
    got = run_state(spark, tmp_path, rows, schema, L.live_trace, lambda r: len(r) == 600)
    want = as_dicts(L.trace(spark.createDataFrame(rows, schema)), "t_ms")
    assert [r["v"] for r in got] == pytest.approx([r["v"] for r in want])


def whole_trace(t, r):
    """The trace by its definition, frame by frame."""
    import math
    out, slow, fast, last = [], None, 0.0, None
    for now, x in zip(t, (-v for v in r)):
        dt = 1 / 30 if last is None else min(0.2, (now - last) / 1000)
        if slow is None or abs(x - slow) > 25:
            slow, fast = x, 0.0
        slow += (x - slow) * (1 - math.exp(-dt / 1.2))
        fast += (x - slow - fast) * (1 - math.exp(-dt / 0.07))
        last = now
        out.append(fast)
    return out


def test_trace_of_long_readings_is_exact(spark):
    import math
    import random
    rng = random.Random(1)
    t = [i * 1000 / 60 for i in range(9000)]
    waves = {f"slope{k}": [5000 - x / 1000 * k for x in t] for k in (18, 20.83, 21, 21.5, 22)}
    waves |= {f"zigzag{p}": [40 + 180 * abs((x / 1000 % p) / p * 2 - 1) for x in t] for p in (15.0, 16.6, 17.0, 17.3, 18.1)}
    waves |= {"noise": [200 + rng.gauss(0, 9) for _ in t], "sine": [130 + 24.9 * math.sin(x / 300) for x in t]}
    df = spark.createDataFrame([(k, a, b) for k, w in waves.items() for a, b in zip(t, w)], "reading string, t_ms double, r double").repartition(4)
    for chunk in (60_000, 25_000):
        got = {}
        for r in L.trace(df, chunk_ms=chunk).collect():
            got.setdefault(r["reading"], []).append((r["t_ms"], r["v"]))
        for k, w in waves.items():
            assert [v for _, v in sorted(got[k])] == pytest.approx(whole_trace(t, w), abs=1e-9)


@pytest.mark.parametrize("files", [1, 3])
def test_phase_intervals(spark, tmp_path, files):
    rows = [("a", 1000, "rest"), ("a", 2000, "rest"), ("a", 61000, "challenge"), ("a", 180000, "end"), ("b", 5000, "rest"), ("b", 9000, "stop"), ("b", 20000, "rest"),
            ("a", 400000, "rest"), ("a", 500000, "recovery")]
    got = replayed(spark, tmp_path, rows, "session string, t_ms long, phase string", P.phase_intervals, "session", files)
    assert got == [("a", "challenge", 61000, 180000, False), ("a", "rest", 1000, 61000, False), ("a", "rest", 400000, 500000, False), ("b", "rest", 5000, 9000, True)]


def test_bounded_readings(spark, tmp_path):
    b = spark.createDataFrame([("a", T0 + timedelta(seconds=i), 1000.0) for i in range(200)], "owner string, ts timestamp, rr_ms double")
    s = spark.createDataFrame([("a", T0 + timedelta(seconds=20))], "owner string, start_ts timestamp")
    b.coalesce(1).write.parquet(str(tmp_path / "b"))
    s.coalesce(1).write.parquet(str(tmp_path / "s"))
    j = L.bounded_readings(spark.readStream.schema(b.schema).parquet(str(tmp_path / "b")), spark.readStream.schema(s.schema).parquet(str(tmp_path / "s")))
    out = L.run_once(j, new_folder(spark, "t"))
    assert out.count() == 60 and out.agg(F.min("ts")).first()[0] == T0 + timedelta(seconds=20)


FEED = "user_id long, id string, seq long, v string"


def test_change_feed_merge(spark, tmp_path):
    for n, rows in enumerate(([(1, "a", 1, "x"), (1, "b", 2, "y")], [(1, "a", 3, "z")])):
        spark.createDataFrame(rows, FEED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = V.merge_changes(spark.readStream.schema(FEED).parquet(str(tmp_path / "in")), str(tmp_path / "t"), str(tmp_path / "c"))
        q.awaitTermination()
    schema = spark.createDataFrame([], FEED).schema
    table = V.read_table(spark, str(tmp_path / "t"), schema, ["user_id", "id"], "seq")
    assert [(r["id"], r["v"]) for r in as_dicts(table, "id")] == [("a", "z"), ("b", "y")]
    first = V.read_table(spark, str(tmp_path / "t"), schema, ["user_id", "id"], "seq", version=0)
    assert [(r["id"], r["v"]) for r in as_dicts(first, "id")] == [("a", "x"), ("b", "y")]
    assert V.read_table(spark, str(tmp_path / "none"), schema, ["user_id", "id"], "seq").count() == 0


def test_versions_of_a_table(spark, tmp_path):
    """Every version equals the newest rows so far, also when a batch is run again; old data goes; a small batch writes little."""
    rng = random.Random(6)
    folder, key, state, seq = str(tmp_path / "t"), ["user_id", "id"], {}, 0
    schema = spark.createDataFrame([], FEED).schema
    size = lambda v: sum(p.stat().st_size for p in (tmp_path / "t" / "data" / f"version={v}").rglob("*.parquet"))
    sizes = []
    for n in range(7):
        rows = []
        for _ in range(3000 if n == 0 else 30 if n < 5 else 2500):
            seq += 1
            rows.append((rng.randrange(40), f"r{rng.randrange(100)}", seq, f"{rng.getrandbits(800):x}"))
        for r in rows:
            state[r[:2]] = r
        batch = spark.createDataFrame(rows + rows[:5], schema)
        for _ in range(2 if n in (2, 5) else 1):
            V.merge_batch(batch, n, folder, key, "seq", buckets=8, keep=2)
        sizes.append(size(n))
        assert sorted(tuple(r) for r in V.read_table(spark, folder, schema, key, "seq").collect()) == sorted(state.values())
    assert V.versions(spark, folder) == [5, 6] and all(s < sizes[0] / 4 for s in sizes[1:5])
    named = {(p, b) for v in (5, 6) for b, p, _, _ in V.manifest(spark, folder, v)}
    there = {(int(p.parent.name[8:]), int(p.name[7:])) for p in (tmp_path / "t" / "data").glob("version=*/bucket=*")}
    assert there == named and max(len([e for e in V.manifest(spark, folder, 6) if e[0] == b]) for b in range(8)) <= 6


def test_file_ingestion(spark, tmp_path):
    (tmp_path / "drop").mkdir()
    for n in range(2):
        (tmp_path / "drop" / f"{n}.csv").write_text("timestamp,rmssd\n2024-01-01T00:00:00,40\n")
        L.ingest_files(spark, "csv", str(tmp_path / "drop"), "timestamp string, rmssd double", str(tmp_path / "sink"), str(tmp_path / "cc"), {"header": "true"}).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "sink")).count() == 2


def test_micro_batch_scoring(spark, tmp_path):
    rows = [("a", "hr", T0, 1.0), ("a", "hr", T0 + timedelta(seconds=5), 2.0), ("a", "temp", T0, 3.0)]
    d = spark.createDataFrame(rows, "owner string, signal string, ts timestamp, x double")
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    q = L.score_batches(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")), lambda b: b.withColumn("score", F.col("x") * 10),
                        lambda b, n: seen.extend(b.collect()), str(tmp_path / "c"), every=None)
    q.awaitTermination()
    assert sorted((r["signal"], r["score"]) for r in seen) == [("hr", 20.0), ("temp", 30.0)]


def test_one_row_per_reading(spark, tmp_path):
    b = spark.createDataFrame([("a", T0 + timedelta(seconds=i), 1000.0) for i in range(600)], "owner string, ts timestamp, rr_ms double")
    s = spark.createDataFrame([("a", T0 + timedelta(seconds=x)) for x in (20, 300, 590)], "owner string, start_ts timestamp")
    b.coalesce(1).write.parquet(str(tmp_path / "b"))
    s.coalesce(1).write.parquet(str(tmp_path / "s"))
    r = L.readings(spark.readStream.schema(b.schema).parquet(str(tmp_path / "b")), spark.readStream.schema(s.schema).parquet(str(tmp_path / "s")), watermark="10 seconds")
    out = as_dicts(L.run_once(r, new_folder(spark, "t")), "start_ts")
    assert [x["start_ts"] for x in out] == [T0 + timedelta(seconds=20), T0 + timedelta(seconds=300)]
    assert out[0]["n_beats"] == 60 and out[0]["hr_mean"] == 60


class Kept:
    """State of one key in a dict, as a state store gives it."""

    def __init__(self):
        self.values, self.timers = {}, []

    def getMapState(self, name, *schemas):
        return MapOf(self.values.setdefault(name, {}))

    def getValueState(self, name, schema):
        return ValueOf(self.values, name)

    def registerTimer(self, at):
        self.timers.append(at)


class MapOf:
    def __init__(self, d):
        self.d = d
        self.updateValue, self.getValue, self.removeKey = d.__setitem__, d.__getitem__, d.pop

    def keys(self):
        return list(self.d)


class ValueOf:
    def __init__(self, d, name):
        self.exists, self.get, self.update = lambda: name in d, lambda: d[name], lambda v: d.__setitem__(name, v)


class Watermark:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


@pytest.mark.parametrize("in_order", [True, False])
def test_a_batch_of_any_size_is_played_in_portions(monkeypatch, in_order):
    """A key's rows of one batch are not in memory together, and portions tell the same as one play of them all."""
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(2)
    n = 40_000
    d = pd.DataFrame({"t_ms": rng.integers(0, 400_000, n), "rr_ms": np.where(rng.random(n) < 0.9, 700 + rng.integers(0, 300, n), np.nan),
                      "contact": rng.choice(np.array([True, True, None, False], object), n), "battery": np.where(rng.random(n) < 0.1, rng.integers(1, 90, n), np.nan)})
    d = d.sort_values("t_ms", kind="stable") if in_order else d

    def played(processor, upto):
        at, handle = [], Kept()
        processor.keys = ["device"]
        processor.init(handle)
        play = processor.play
        processor.play = lambda state, rows, until: (at.append(len(rows)), play(state, rows, until))[1]
        processor.handleInputRows(("a",), iter([d[i:i + 1000] for i in range(0, n, 1000)]), None)
        out = [x for ms in upto for x in processor.handleExpiredTimer(("a",), Watermark(ms), None)]
        return pd.concat(out).reset_index(drop=True), max(at), handle

    for make in (lambda: P.Device(), lambda: P.Quality(20, 4000), lambda: P.Gaps(4000, P.RETRY_S)):
        whole, most, _ = played(make(), [10 ** 9])
        with monkeypatch.context() as m:
            for name, rows in (("STORE_ROWS", 5000), ("PIECE_ROWS", 100), ("PLAY_ROWS", 500)):
                m.setattr(P, name, rows)
            parts, few, handle = played(make(), [100_000, 100_500, 10 ** 9])
        assert parts.equals(whole) and few < 8000 and not handle.values["waiting"]


def test_spans_equal_their_intervals_one_by_one():
    """Flags, counts and features of overlapping spans, also with copies, against each span by itself."""
    import numpy as np
    from statistics import median, stdev
    from pulsegrid.streaming import spans as S

    def kept(rr):
        usual = [(i, x) for i, x in enumerate(rr) if 300 <= x <= 2000]
        out = []
        for j, (i, x) in enumerate(usual):
            near = [y for _, y in usual[max(0, j - K.RR_NEIGHBOURS):j] + usual[j + 1:j + 1 + K.RR_NEIGHBOURS]]
            if len(near) < 2 or abs(x - median(near)) <= K.RR_MAX_DEVIATION * median(near):
                out.append((i, x))
        return out

    rng = np.random.default_rng(1)
    for n in (0, 1, 11, 60, 500):
        rr = rng.choice([700.0, 800.0, 810.0, 1000.0, 1500.0, 250.0, 2500.0, math.nan], n, p=[.3, .2, .2, .1, .05, .05, .05, .05])
        a = rng.integers(0, n + 1, 60)
        b, times = np.minimum(n, a + rng.choice([0, 1, 9, 10, 11, 12, 40, 300], 60)), rng.choice([1, 1, 2, 9, 10, 11, 25], 60)
        got, told = S.features(rr, a, b, times, 60), S.qualities(rr, a, b, 20)
        for x in range(60):
            all_ = [v for v in rr[a[x]:b[x]] for _ in range(times[x])]
            clean = kept(all_)
            v, steps = [y for _, y in clean], [q - p for (i, p), (j, q) in zip(clean, clean[1:]) if j == i + 1]
            cover = min(len(v) * median(v) / 60_000, 1.5) if len(v) >= 3 else 0.0
            hrv = cover >= K.HRV_COVERAGE and len(steps) >= K.HRV_PAIRS
            want = [60_000 / (sum(v) / len(v)) if cover >= K.HR_COVERAGE else math.nan, math.sqrt(sum(s * s for s in steps) / len(steps)) if hrv else math.nan,
                    stdev(v) if hrv else math.nan, cover, 1 - len(v) / len(all_) if all_ else 0.0, len(all_), len(v)]
            assert [got[c][x] for c in ("hr_mean", "rmssd", "sdnn", "coverage", "rejected", "n_beats", "n_clean")] == pytest.approx(want, abs=1e-9, nan_ok=True)
            seen = list(rr[a[x]:b[x]])
            clean = [y for _, y in kept(seen)]
            cover, bad = (len(clean) * median(clean) / 20_000, 1 - len(clean) / len(seen)) if clean else (0, 1)
            assert told[x] == ("fair" if not seen else "poor" if len(clean) < 3 else "good" if cover >= 0.9 and bad <= 0.05 else
                               "fair" if cover >= K.HRV_COVERAGE and bad <= 0.2 else "poor")


def test_overlapping_readings_are_not_joined_beat_by_beat(spark, tmp_path):
    """Many readings over the same beats: no pair of reading and beat is made, and each equals its own window."""
    rng = random.Random(9)
    beats = [(o, T0 + timedelta(milliseconds=rng.randrange(150_000)), rng.choice([700.0, 820.0, 1500.0, 250.0, None])) for o in ("a", "b", None) for _ in range(400)]
    starts = [(o, T0 + timedelta(milliseconds=rng.randrange(60_000) // 100 * 100)) for o in ("a", "b", None) for _ in range(60)]
    end = datetime(2025, 1, 1)
    b, s = spark.createDataFrame(beats + [("~", end, 1.0)], "owner string, ts timestamp, rr_ms double"), spark.createDataFrame(starts + starts[:3] + [("~", end)], "owner string, start_ts timestamp")
    b.coalesce(1).write.parquet(str(tmp_path / "b"))
    s.coalesce(1).write.parquet(str(tmp_path / "s"))
    r = L.readings(spark.readStream.schema(b.schema).parquet(str(tmp_path / "b")), spark.readStream.schema(s.schema).parquet(str(tmp_path / "s")))
    assert "Join" not in r._jdf.queryExecution().analyzed().toString()
    got = as_dicts(L.run_once(r, new_folder(spark, "t")), "owner", "start_ts")
    near = (F.col("b.owner") == F.col("s.owner")) & (F.col("b.ts") >= F.col("s.start_ts")) & (F.col("b.ts") < F.col("s.start_ts") + F.expr("INTERVAL 60 SECONDS"))
    pairs = b.alias("b").join(s.alias("s"), near).filter("s.owner <> '~'").groupBy("s.owner", "s.start_ts").agg(
        F.collect_list(F.struct(F.unix_micros("b.ts").alias("t"), F.col("b.rr_ms").alias("v"))).alias("rows"))
    want = as_dicts(pairs.select("owner", "start_ts", B.array_features(F.col("rows"), 60).alias("f")).select("owner", "start_ts", "f.*"), "owner", "start_ts")
    assert len(got) == len(want) > 90
    for g, w in zip(got, want):
        assert g == {c: pytest.approx(v) if isinstance(v, float) else v for c, v in w.items()}
