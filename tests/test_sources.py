import json
import random
import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from conftest import as_dicts
from pulsegrid.sources import exports as X
from pulsegrid.sources import sinks


def health_xml():
    rec = '<Record type="HKQuantityTypeIdentifier{}" sourceName="{}" startDate="{}" endDate="{}" value="{}"'
    hr = "HeartRate"
    out = [rec.format("StepCount", "Phone", "2026-03-01 09:00:00 +0530", "2026-03-01 09:05:00 +0530", 312) + "/>"]
    for i in range(10):
        t = f"2026-03-01 09:{i * 5:02d}:10 +0530"
        out.append(rec.format(hr, "Someone", t, t, 70 + i) + "/>")
    for s in range(0, 60, 5):
        t = f"2026-03-01 18:00:{s:02d} +0530"
        out.append(rec.format(hr, "Watch", t, t, 140) + '><MetadataEntry key="k" value="2"/></Record>')
    beats, t = [], 21 * 3600 + 41 * 60
    for i in range(70):
        h, m, s = int(t // 3600), int(t % 3600 // 60), t % 60
        beats.append(f'<InstantaneousBeatsPerMinute bpm="{73 if i % 2 else 75}" time="{h % 12 or 12}:{m:02d}:{s:05.2f} PM"/>')
        t += 0.8 if i % 2 else 0.82
    out.append(rec.format("HeartRateVariabilitySDNN", "Watch", "2026-03-01 21:41:00 +0530", "2026-03-01 21:42:00 +0530", 48.5)
               + "><HeartRateVariabilityMetadataList>" + "".join(beats) + "</HeartRateVariabilityMetadataList></Record>")
    out.append(rec.format("HeartRateVariabilitySDNN", "Watch", "2026-03-02 07:00:00 +0530", "2026-03-02 07:01:00 +0530", 61.2) + "/>")
    for i, d in enumerate(("2026-03-01", "2026-03-02")):
        out.append(rec.format("RestingHeartRate", "Watch", f"{d} 00:00:00 +0530", f"{d} 23:59:00 +0530", 58 + i) + "/>")
    return "<HealthData>" + "\n".join(out) + "</HealthData>"


def test_health_export(spark, tmp_path):
    (tmp_path / "export.xml").write_text(health_xml())
    records = X.read_health_xml(spark, str(tmp_path / "export.xml"))
    m = as_dicts(X.health_measurements(records), "started_ms")
    hr = [r for r in m if r["sdnn"] is None]
    hrv = [r for r in m if r["sdnn"] is not None]
    assert len(hr) == 11 and hr[0]["hr_mean"] == 70 and hr[0]["quality"] == "fair" and hr[0]["device"] == "Apple Health"
    assert next(r for r in hr if r["hr_mean"] == 140)["quality"] == "good"
    assert len(hrv) == 2 and hrv[0]["rmssd"] == pytest.approx(20, abs=0.5) and hrv[0]["hr_mean"] == pytest.approx(60000 / 810, abs=0.5)
    assert hrv[1]["sdnn"] == 61.2 and hrv[1]["hr_mean"] is None
    daily = as_dicts(X.health_daily(records), "day")
    assert [(d["day"], d["resting_hr"], d["hrv"], d["hrv_kind"]) for d in daily] == [
        (date(2026, 3, 1), 58, 48.5, "sdnn"), (date(2026, 3, 2), 59, 61.2, "sdnn")]
    one = X.health_measurements(records).withColumn("o", F.lit(1))
    s = X.summary_sentence(X.import_summary(one, X.limited(one, ["o"]), X.health_daily(records).withColumn("o", F.lit(1)), ["o"]), "Apple Health")
    assert s.first()["summary"] == "Apple Health: 11 heart-rate minutes and 2 HRV readings from 1 Mar 2026 to 2 Mar 2026. Resting heart rate on 2 days."
    assert X.limited(one, ["o"], days=0).count() == 0 and X.limited(one, ["o"], rows=3).count() == 3


def test_band_export(spark, tmp_path):
    rows = [{"dateTime": f"03/01/26 08:0{s // 60}:{s % 60:02d}", "value": {"bpm": 60 + s % 10, "confidence": 2}} for s in range(0, 120, 5)]
    rows += [{"dateTime": "03/01/26 08:05:00", "value": {"bpm": 90, "confidence": 3}}, {"dateTime": "03/01/26 08:05:30", "value": {"bpm": 91, "confidence": 3}},
             {"dateTime": "03/01/26 08:00:02", "value": {"bpm": 200, "confidence": 0}}]
    (tmp_path / "hr.json").write_text(json.dumps(rows))
    (tmp_path / "rest.json").write_text(json.dumps([{"dateTime": "03/02/26 00:00:00", "value": {"date": "03/01/26", "value": 61.37}}]))
    (tmp_path / "hrv.csv").write_text("timestamp,rmssd,coverage\n2026-03-01T01:05:00,38.2,0.93\n2026-03-01T01:10:00,41.0,0.6\nbad,1,1\n")
    (tmp_path / "daily.csv").write_text("timestamp,rmssd\n2026-03-01T00:00:00,39.9\n")
    hrv = X.read_band_hrv(spark, str(tmp_path / "hrv.csv"))
    m = as_dicts(X.band_measurements(X.read_band_hr(spark, str(tmp_path / "hr.json")), hrv), "started_ms")
    hr = [r for r in m if r["hr_mean"] is not None]
    assert len(hr) == 3 and hr[0]["hr_mean"] == 62.5 and hr[0]["quality"] == "good" and hr[2]["quality"] == "fair"
    assert [(r["rmssd"], r["quality"], r["duration_s"]) for r in m if r["rmssd"]] == [(38.2, "good", 300), (41.0, "fair", 300)]
    assert as_dicts(X.read_band_resting(spark, str(tmp_path / "rest.json"))) == [{"day": date(2026, 3, 1), "resting_hr": 61.4}]
    assert as_dicts(X.read_band_daily(spark, str(tmp_path / "daily.csv")))[0]["hrv"] == 39.9


def test_wristband_session(spark, tmp_path):
    d = tmp_path / "1772352000_A01B2C"
    d.mkdir()
    start, minutes = 1772352000, 3
    scr = lambda t: sum(0.1 * (math.exp(-(t - c) / 4) - math.exp(-(t - c) / 0.75)) for c in (20, 80, 140) if t >= c)
    n4 = minutes * 240
    (d / "EDA.csv").write_text("\n".join([f"{start}.0", "4.0", *[f"{0.8 + 0.002 * i / 4 + scr(i / 4):.6f}" for i in range(n4)]]))
    (d / "TEMP.csv").write_text("\n".join([f"{start}.0", "4.0", *[f"{33.1 - 0.001 * i / 4:.2f}" for i in range(n4)]]))
    acc = [f"{start}.0, {start}.0, {start}.0", "32.0, 32.0, 32.0"]
    for i in range(minutes * 60 * 32):
        move = i >= 2 * 60 * 32
        acc.append(f"{round(30 * math.sin(i / 3)) if move else i % 3 - 1},-2,{64 + (round(20 * math.cos(i / 5)) if move else 0)}")
    (d / "ACC.csv").write_text("\n".join(acc))
    ibi, t, i = [f"{start}.0, IBI"], 0.4, 0
    while t < minutes * 60 - 1:
        r = 0.8 if i % 2 else 0.82
        t, i = t + r, i + 1
        ibi.append(f"{t:.6f},{r:.6f}")
    (d / "IBI.csv").write_text("\n".join(ibi))
    (d / "HR.csv").write_text("\n".join([f"{start + 10}.0", "1.0", *["74.00"] * (minutes * 60 - 10)]))
    ch = X.read_channel(spark, str(d / "[EATH]*[APCR].csv"))
    assert {r[0] for r in ch.select("channel").distinct().collect()} == {"EDA", "TEMP", "ACC", "HR"}
    m = as_dicts(X.wristband_measurements(ch, X.read_intervals(spark, str(d / "IBI.csv"))), "started_ms")
    assert len(m) == 3
    a, _, c = m
    assert a["device"] == "Empatica E4 A01B2C" and a["started_ms"] == start * 1000 and a["quality"] == "good"
    assert a["hr_mean"] == pytest.approx(60000 / 810, abs=0.5) and a["rmssd"] == pytest.approx(20, abs=0.5)
    assert a["scr_count"] == 1 and a["temp_slope"] == pytest.approx(-0.06, abs=0.005) and not a["motion_flagged"]
    assert c["motion_flagged"] and c["quality"] == "poor"


def packets(spark, *payloads):
    return spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(payloads)], "i int, payload binary")


def test_heart_rate_packets(spark):
    p = as_dicts(X.parse_hr_packets(packets(
        spark, [0x16, 0x3C, 0xEC, 0x03], [0x10, 0x48, 0x55, 0x03, 0x4E, 0x03], [0x04, 0x00], [0x19, 0x96, 0x00, 0xD2, 0x04, 0x9A, 0x01], [0x00, 0x58],
        [0x10, 0x40, 0x00, 0x04, 0x07], [0x01], [0x01, 0x40])), "i")
    assert [r["i"] for r in p] == [0, 1, 2, 3, 4, 5]
    assert p[0]["hr"] == 60 and p[0]["contact"] is True and p[0]["rr"][0] == pytest.approx(980.469, abs=0.01)
    assert [round(x, 1) for x in p[1]["rr"]] == [833.0, 826.2] and p[1]["contact"] is None
    assert p[2]["contact"] is False and p[2]["rr"] == []
    assert p[3]["hr"] == 150 and p[3]["energy"] == 1234 and p[3]["rr"][0] == pytest.approx(400.39, abs=0.01)
    assert p[4]["hr"] == 88 and not p[4]["rr_flag"] and p[5]["rr"] == [1000]


def test_packet_beats_spread_back(spark):
    d = X.parse_hr_packets(packets(spark, [0x10, 0x48, 0x00, 0x04, 0x00, 0x04], [0x04, 0x40], [0x00, 0x00], [0x00, 0x58])).withColumn("arrived_ms", F.lit(10_000))
    b = as_dicts(X.packet_beats(d, ["i"]), "i", "t_ms")
    assert [(r["i"], r["t_ms"], r["rr_ms"]) for r in b] == [(0, 9000, 1000.0), (0, 10000, 1000.0), (3, 10000, None)]


def test_sensor_frames(spark):
    def head(kind, form, ns=1):
        return [kind, *ns.to_bytes(8, "little"), form]
    i24 = lambda v: list((v & 0xFFFFFF).to_bytes(3, "little"))
    i16 = lambda v: list((v & 0xFFFF).to_bytes(2, "little"))
    f = as_dicts(X.parse_frames(packets(
        spark, [*head(0, 0, 599_000_000_000_000_000), *i24(-120), *i24(1450), *i24(-8388608), *i24(8388607)],
        [*head(2, 1), *i16(12), *i16(-3), *i16(1001)], [*head(2, 0), 1, 0xFF, 100], [*head(1, 0), 1, 2, 3], [0, 1, 2])), "i")
    assert [r["type"] for r in f] == ["ecg", "acc", "acc"]
    assert f[0]["samples"] == [-120, 1450, -8388608, 8388607] and f[0]["epoch_ms"] == 946684800000 + 599_000_000_000
    assert f[1]["samples"] == [12, -3, 1001] and f[2]["samples"] == [1, -1, 100]


def test_chest_motion(spark):
    d = spark.createDataFrame([("still", "acc", [0, 0, 1000] * 20), ("moving", "acc", [0, 0, 900, 0, 0, 1100] * 20)], "k string, type string, samples array<long>")
    m = {r["k"]: r for r in as_dicts(X.chest_motion(d, ["k"]))}
    assert m["still"]["acc_std"] == pytest.approx(0) and not m["still"]["flagged"]
    assert m["moving"]["acc_std"] == pytest.approx(0.1) and m["moving"]["flagged"]


def test_clock_and_dates(spark):
    d = spark.createDataFrame([("9:41:03.12 PM",), ("12:00:01 AM",), ("23:59:59",), ("x",)], "s string")
    assert [r[0] for r in d.select(X.clock_seconds(F.col("s"))).collect()] == [pytest.approx(78063.12), 1.0, 86399.0, None]
    assert spark.range(1).select(X.zoned_millis(F.lit("2024-03-01 09:41:03 -0800"))).first()[0] == 1709314863000


def test_questionnaire_and_tables(spark, tmp_path):
    (tmp_path / "S2_readme.txt").write_text("Age: 27\nHeight (cm): 175\nWeight (kg): 80\nGender: male\nDominant hand: right\nDid you drink coffee today? NO\n"
                                            "Did you do any sports today? YES\nAre you a smoker? NO\nDo you feel ill today? NO\n### Additional notes ###\nfelt cold\n")
    q = as_dicts(X.read_questionnaire(spark, str(tmp_path / "*.txt")))[0]
    assert q["age"] == 27 and q["dominant_hand"] == "right" and q["sports_today"] and not q["coffee_today"] and q["notes"] == "felt cold"
    (tmp_path / "k.tsv").write_text(" Press Time\tRelase Time\n2024-01-01 00:00:00\t2024-01-01 00:00:01\n")
    assert X.read_keystrokes(spark, str(tmp_path / "k.tsv")).columns == ["press_time", "release_time"]
    (tmp_path / "c.tsv").write_text("Time\tStress Val\n2024-01-01 00:00:00\tVery Stressed\n2024-01-01 00:05:00\tNeutral\n")
    assert [r["stress"] for r in as_dicts(X.read_conditions(spark, str(tmp_path / "c.tsv")), "time")] == [1, 0]
    v = tmp_path / "v"
    v.mkdir()
    (v / "a_Numerics.csv").write_text("Time, SpO2\n" + "".join(f"{i},97\n" for i in range(61)))
    (v / "b_Numerics.csv").write_text("Time,HR\n1,60\n")
    (v / "c_Numerics.csv").write_text("SpO2\n95\n")
    out = X.read_vitals(spark, str(v / "*_Numerics.csv"))
    assert out.count() == 61 and out.filter("value = 97").count() == 61


def test_chunks(spark, tmp_path):
    d = spark.createDataFrame([("S2", "EDA", 4, 0, [1.0, 2.0]), ("S2", "EDA", 4, 500, [3.0])], X.CHUNK_SCHEMA)
    d.write.partitionBy("subject").parquet(str(tmp_path / "c"))
    assert [(r["idx"], r["value"]) for r in as_dicts(X.chunk_samples(X.read_chunks(spark, str(tmp_path / "c"))), "idx")] == [(0, 1.0), (1, 2.0), (2, 3.0)]


def test_feature_table_roundtrip(spark, tmp_path):
    d = spark.createDataFrame([("S2", 1.5, None, 1), ("S3", 2.0, 3.0, 0)], "subject string, t double, rmssd double, stress int")
    sinks.write_csv(d, str(tmp_path / "f"))
    back = sinks.read_features_csv(spark, str(tmp_path / "f"), "subject string, t double, rmssd double, stress int")
    assert as_dicts(back, "subject") == as_dicts(d, "subject")


def test_owner_order(spark):
    d = spark.createDataFrame([("S10",), ("S2",), ("S13",)], "s string")
    assert [r[0] for r in sinks.owner_order(d, "s").collect()] == ["S2", "S10", "S13"]


def test_result_documents(spark):
    from pulsegrid import constants as K
    from pulsegrid.operators import score as S

    coefs = S.model_table(spark).withColumn("sd_floor", F.lit(1.0)).withColumn("rank", F.when(F.col("feature") == "rmssd", 0).otherwise(1))
    metrics = spark.createDataFrame([("hr", 0.81254999)], "signal string, balanced_accuracy double")
    docs = {r["signal"]: json.loads(r["document"]) for r in sinks.model_constants(coefs, metrics).collect()}
    assert docs["hr"]["loso"]["balanced_accuracy"] == 0.8125 and [f["name"] for f in docs["hrv"]["features"]] == ["rmssd", "sdnn"]
    assert docs["eda"]["intercept"] == K.MODEL_INTERCEPT["eda"]
    m = spark.createDataFrame([("S2", 10, 4, 0.5, 0.4, None)], "owner string, n long, n_pos long, balanced_accuracy double, macro_f1 double, roc_auc double")
    assert sinks.metric_rows(m, "rest5", "hr:lr").first()["n_stress"] == 4
    rows = spark.createDataFrame([(1, i) for i in range(25)], "user_id long, i long")
    parts = as_dicts(sinks.user_documents(rows, "user_id", ["i"], ["i"], part_rows=10), "part")
    assert [len(json.loads(p["document"])) for p in parts] == [10, 10, 5] and json.loads(parts[1]["document"])[0] == {"i": 10}


def test_score_helpers(spark):
    from pulsegrid.operators import score as S

    d = spark.createDataFrame([("hr", 0.5, 0.5 + 5e-7), ("hrv", 0.5, 0.6)], "signal string, p double, expected double")
    assert [r["ok"] for r in as_dicts(S.parity(d, "p", "expected", ["signal"]), "signal")] == [True, False]
    t = spark.createDataFrame([(59.0,), (60.0,), (74.9,), (75.0,)], "t double")
    assert [r[0] for r in t.select(S.last_finished_window(F.col("t"))).collect()] == [None, 0, 0, 15]


def test_lines_of_split_files_have_exact_numbers(spark, tmp_path):
    """Files of many splits, read by many tasks, with empty lines, both line ends and no line end at the end."""
    rng = random.Random(2)
    want = {}
    for name, n, end in (("a.csv", 4000, "\n"), ("b.csv", 2500, "\r\n"), ("c.csv", 1, "\n"), ("d.csv", 900, "\n")):
        rows = ["" if rng.random() < 0.05 else f"{i},{'x' * rng.randrange(60)}" for i in range(n)]
        rows[-1] = "end"
        (tmp_path / name).write_text(end.join(rows), newline="")
        want[name] = rows
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7k")
        spark.conf.set("spark.sql.files.openCostInBytes", "100")
        d = X.numbered_lines(spark, str(tmp_path / "*.csv"))
        assert spark.read.text(str(tmp_path / "*.csv")).rdd.getNumPartitions() > 20
        full = X.numbered_lines(spark, str(tmp_path / "*.csv"), skip_empty=True).groupBy("file").agg(F.sort_array(F.collect_list(F.struct("line", "value"))).alias("l")).collect()
        got = {}
        for r in d.collect():
            got.setdefault(r["file"].rpartition("/")[2], {})[r["line"]] = r["value"]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert {f: [rows[i] for i in range(len(rows))] for f, rows in got.items()} == want
    assert {r["file"].rpartition("/")[2]: [tuple(x) for x in r["l"]] for r in full} == {f: list(enumerate(x for x in rows if x)) for f, rows in want.items()}


def test_an_import_written_twice_is_one_batch(spark, tmp_path):
    rows = spark.createDataFrame([(1, 60.0), (2, 61.0)], "t long, hr double")
    folder = str(tmp_path / "imports")
    for _ in range(2):
        sinks.write_import(rows, folder, "a", "import-apple", "export.zip", "2024-05-01T08:00:00")
    sinks.write_import(rows.limit(1), folder, "b", "import-apple", "export.zip", "2024-05-01T08:00:00")
    sinks.write_import(rows.limit(1), folder, "a", "import-apple", "export.zip", "2024-05-02T08:00:00")
    got = sinks.read_imports(spark, folder, rows.schema)
    assert got.columns == ["t", "hr", *sinks.IMPORT] and got.count() == 4
    assert sorted(r["count"] for r in got.groupBy("import_id", "imported_at").count().collect()) == [1, 1, 2]
