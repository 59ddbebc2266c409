"""Import rules over the driver's tables: events stand in for the rows of an export."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.catalog import query
from pulsegrid.catalog.activity import up
from pulsegrid.catalog.beat import r6
from pulsegrid.plans import tables as T
from pulsegrid.session import new_folder
from pulsegrid.sources import exports as X

HR_SQL = "SELECT user_id % 15 AS owner, epoch_us(ts) // 1000 // 300 AS t_ms, 40 + value AS bpm FROM events"


def hr_samples(spark, sf):
    """Spot heart rates on a compressed clock (hours become seconds)."""
    return T.table(spark, sf, "events").select(
        (F.col("user_id") % 15).alias("owner"), F.floor(T.millis("ts") / F.lit(300)).alias("t_ms"), (40 + F.col("value")).alias("bpm"))


@query("source_minute_hr", f"""
SELECT owner, t_ms // 60000 * 60000 AS started_ms, round(avg(bpm), 6) AS hr_mean, count(*) AS n, CASE WHEN count(*) >= 6 THEN 'good' ELSE 'fair' END AS quality
FROM ({HR_SQL}) h WHERE bpm BETWEEN 30 AND 220 GROUP BY owner, t_ms // 60000""")
def _(spark, sf):
    return X.minute_hr(hr_samples(spark, sf), ["owner"], "t_ms", "bpm").select("owner", "started_ms", *r6("hr_mean"), "n", "quality")


COVERED_SQL = f"""
WITH h AS (SELECT *, t_ms // 60000 AS k FROM ({HR_SQL}) h WHERE bpm BETWEEN 30 AND 220),
g AS (SELECT *, t_ms - lag(t_ms) OVER (PARTITION BY owner, k ORDER BY t_ms) AS gap FROM h),
a AS (SELECT owner, k, avg(bpm) AS hr, count(*) AS n, list_sort(list(gap) FILTER (WHERE gap IS NOT NULL)) AS gs FROM g GROUP BY owner, k),
c AS (SELECT *, least(1e0, n * CASE WHEN n > 1 THEN least(greatest(gs[len(gs) // 2 + 1], 1000), 15000) ELSE 5000 END / 60000e0) AS coverage FROM a)"""


@query("source_minute_hr_covered", COVERED_SQL + """
SELECT owner, k * 60000 AS started_ms, round(hr, 6) AS hr_mean, n, round(coverage, 6) AS coverage, CASE WHEN coverage >= 0.75e0 THEN 'good' ELSE 'fair' END AS quality FROM c WHERE coverage >= 0.25e0""")
def _(spark, sf):
    return X.minute_hr_covered(hr_samples(spark, sf), ["owner"], "t_ms", "bpm").select("owner", "started_ms", *r6("hr_mean"), "n", *r6("coverage"), "quality")


@query("source_time_formats", """
SELECT event_id, epoch_us(ts) // 1000000 * 1000 + 8 * 3600000 AS zoned_ms, epoch_us(ts) // 1000000 * 1000 AS short_ms, date_part('hour', ts) * 3600 + date_part('minute', ts) * 60 + CAST(date_part('second', ts) AS DOUBLE) AS clock_s FROM events""")
def _(spark, sf):
    e = T.table(spark, sf, "events")
    return e.select("event_id", X.zoned_millis(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" -0800"))).alias("zoned_ms"),
                    X.short_utc_millis(F.date_format("ts", "MM/dd/yy HH:mm:ss")).alias("short_ms"), X.clock_seconds(F.date_format("ts", "h:mm:ss a")).alias("clock_s"))


# -- exports written from the events and read back ----------------------------------------------------

def export_files(rows, folder: str, name) -> str:
    """Write text rows (folder columns `part`, order `n`, `line`) as one file per part, and give the files the names that `name`
    makes of the part, as devices name them. The names go through the file system of the session's shared folder."""
    spark = rows.sparkSession
    # a part's lines in order; parts are spread over tasks
    rows.repartition("part").sortWithinPartitions("part", "n").select("part", "line").write.partitionBy("part").text(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for d in fs.listStatus(path(folder)):
        part = d.getPath().getName().partition("=")[2]
        for f in fs.listStatus(d.getPath()) if d.isDirectory() else []:
            fs.rename(f.getPath(), path(d.getPath(), name(part)))
    return folder


ROUTES = {"click": "heart_rate-2024-03-01.json", "view": "resting_heart_rate-2024-03-01.json", "error": "Heart Rate Variability Details - 2024-03-01.csv",
          "purchase": "EDA.csv", "signup": "sleep-2024-03-01.json"}


@query("source_file_routes", """
SELECT kind, count(*) AS n_lines FROM (SELECT CASE event_type WHEN 'click' THEN 'hr' WHEN 'view' THEN 'resting' WHEN 'error' THEN 'hrv-details' WHEN 'purchase' THEN 'EDA' END AS kind
 FROM events) e GROUP BY kind""")
def _(spark, sf):
    e = T.table(spark, sf, "events").select(F.col("event_type").alias("part"), F.col("event_id").alias("n"), F.col("event_id").cast("string").alias("line"))
    folder = export_files(e, new_folder(spark, "routes"), ROUTES.__getitem__)
    lines = spark.read.option("recursiveFileLookup", True).text(folder)
    return lines.groupBy(X.file_kind(F.col("_metadata.file_path")).alias("kind")).agg(F.count("*").alias("n_lines"))


# a session per user of fifteen: 4 Hz samples in the order of the events
CHANNEL_SQL = "SELECT user_id % 15 AS session, row_number() OVER (PARTITION BY user_id % 15 ORDER BY event_id) - 1 AS idx, value AS v1, event_id % 7 = 0 AS gap FROM events"


@query("source_channel_files", f"""
SELECT session, 'EDA' AS channel, 1700000000000e0 + session * 60000 AS start_ms, 4e0 AS hz, idx, v1 FROM ({CHANNEL_SQL}) c""")
def _(spark, sf):
    e = T.table(spark, sf, "events").select((F.col("user_id") % 15).alias("part"), (F.col("event_id") + 2).alias("n"), F.concat(
        F.col("value").cast("string"), F.when(F.col("event_id") % 7 == 0, "\n").otherwise("")).alias("line"))       # some empty lines
    starts = e.select("part").distinct()
    heads = starts.select("part", F.lit(0).cast("long").alias("n"), F.concat((F.lit(1_700_000_000) + F.col("part") * 60).cast("string"), F.lit(".0")).alias("line"))
    rates = starts.select("part", F.lit(1).cast("long").alias("n"), F.lit("4.0").alias("line"))
    folder = export_files(heads.unionByName(rates).unionByName(e), new_folder(spark, "channels"), lambda part: "EDA.csv")
    c = X.read_channel(spark, f"{folder}/*/EDA.csv")
    return c.select(F.regexp_extract("session", r"part=(\d+)$", 1).cast("long").alias("session"), "channel", "start_ms", "hz", "idx", "v1")


@query("source_interval_files", """
SELECT session, round(t_ms, 3) AS t_ms, round(rr_ms, 3) AS rr_ms FROM (
 SELECT user_id % 15 AS session, (1700000000 + user_id % 15 * 60) * 1000e0 + event_id * 0.75e0 * 1000 AS t_ms, (700 + value) AS rr_ms, event_id FROM events) x WHERE event_id % 11 <> 0""")
def _(spark, sf):
    e = F.col("event_id")
    text = F.concat((e * 0.75).cast("string"), F.lit(","), F.when(e % 11 == 0, "lost").otherwise(F.format_string("%.5f", (700 + F.col("value")) / 1000)))
    d = T.table(spark, sf, "events").select((F.col("user_id") % 15).alias("part"), (e + 1).alias("n"), text.alias("line"))
    heads = d.select("part").distinct().select("part", F.lit(0).cast("long").alias("n"), F.concat((F.lit(1_700_000_000) + F.col("part") * 60).cast("string"), F.lit(".0, IBI")).alias("line"))
    folder = export_files(heads.unionByName(d), new_folder(spark, "intervals"), lambda part: "IBI.csv")
    r = X.read_intervals(spark, f"{folder}/*/IBI.csv")
    return r.select(F.regexp_extract("session", r"part=(\d+)$", 1).cast("long").alias("session"), F.round("t_ms", 3).alias("t_ms"), F.round("rr_ms", 3).alias("rr_ms"))


@query("source_vitals_files", """
WITH e AS (SELECT user_id % 40 AS patient, row_number() OVER (PARTITION BY user_id % 40 ORDER BY event_id) AS row, CASE WHEN event_id % 9 <> 0 THEN 90 + event_id % 10 END AS v FROM events)
SELECT patient, row, CAST(v AS DOUBLE) AS value FROM e WHERE v IS NOT NULL AND patient % 4 <> 0 AND patient IN (SELECT patient FROM e WHERE v IS NOT NULL GROUP BY patient HAVING count(*) >= 60)""")
def _(spark, sf):
    e, p = F.col("event_id"), F.col("part")
    v = F.when(e % 9 != 0, (90 + e % 10).cast("string")).otherwise("")
    d = T.table(spark, sf, "events").select((F.col("user_id") % 40).alias("part"), e, v.alias("v")).select(
        "part", (e + 1).alias("n"), F.when(p % 2 == 0, F.concat_ws(",", e.cast("string"), "v", F.lit("60"))).otherwise(F.concat_ws(",", "v", e.cast("string"))).alias("line"))
    names = F.when(p % 4 == 0, "Time, HR, RESP").when(p % 2 == 0, "Time, SpO2, HR").otherwise("SpO2,Time")
    heads = d.select("part").distinct().select("part", F.lit(0).cast("long").alias("n"), names.alias("line"))
    folder = export_files(heads.unionByName(d), new_folder(spark, "vitals"), lambda part: f"p{part}_Numerics.csv")
    out = X.read_vitals(spark, f"{folder}/*/*_Numerics.csv")
    return out.select(F.regexp_extract("file", r"part=(\d+)/", 1).cast("long").alias("patient"), "row", "value")


@query("source_health_export", f"""
SELECT CASE event_id % 4 WHEN 0 THEN '{X.VARIABILITY}' WHEN 1 THEN '{X.RESTING}' ELSE '{X.HEART_RATE}' END AS type, epoch_us(ts) // 1000000 * 1000 + 8 * 3600000 AS t_ms,
       epoch_us(ts) // 1000000 * 1000 + 8 * 3600000 + CASE WHEN event_id % 3 = 0 THEN 0 ELSE 60000 END AS end_ms, CAST(ts AS DATE) AS day, 'Watch ' || user_id % 3 AS device, value,
       CASE WHEN event_id % 8 = 0 THEN 2 END AS n_beats FROM events WHERE event_type <> 'signup' AND event_id % 13 <> 0""")
def _(spark, sf):
    e = F.col("event_id")
    text = lambda c: F.concat(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit(" -0800"))
    kind = F.when(F.col("event_type") == "signup", "HKQuantityTypeIdentifierStepCount").when(e % 4 == 0, X.VARIABILITY).when(e % 4 == 1, X.RESTING).otherwise(X.HEART_RATE)
    beat = F.struct(F.lit("60").alias("_bpm"), F.lit("9:41:03.12 PM").alias("_time"))
    rows = T.table(spark, sf, "events").select(
        kind.alias("_type"), text(F.col("ts")).alias("_startDate"), F.when(e % 3 != 0, text(F.col("ts") + F.expr("INTERVAL 1 MINUTE"))).alias("_endDate"),
        F.concat(F.lit("Watch "), (F.col("user_id") % 3).cast("string")).alias("_sourceName"), F.when(e % 13 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("_value"),
        F.when(e % 8 == 0, F.struct(F.array(beat, beat).alias("InstantaneousBeatsPerMinute"))).alias("HeartRateVariabilityMetadataList"))
    folder = new_folder(spark, "health")
    rows.write.option("rootTag", "HealthData").option("rowTag", "Record").xml(folder)
    return X.read_health_xml(spark, folder).select("type", "t_ms", "end_ms", "day", "device", "value", F.when(F.col("beats").isNotNull(), F.size("beats")).alias("n_beats"))


@query("source_band_minutes", """
WITH h AS (SELECT epoch_us(ts) // 1000000 * 1000 AS t_ms, CAST(40 + value AS DOUBLE) AS bpm, event_id % 6 AS c FROM events)
SELECT t_ms, round(bpm, 6) AS bpm, CASE WHEN c < 4 THEN CAST(c AS DOUBLE) END AS confidence FROM h WHERE bpm BETWEEN 30 AND 220 AND c <> 0""")
def _(spark, sf):
    e = F.col("event_id")
    cell = F.struct((40 + F.col("value")).alias("bpm"), F.when(e % 6 < 4, e % 6).alias("confidence"))
    row = F.struct(F.date_format("ts", "MM/dd/yy HH:mm:ss").alias("dateTime"), cell.alias("value"))
    day = T.table(spark, sf, "events").groupBy(F.to_date("ts").alias("part")).agg(F.to_json(F.collect_list(row)).alias("line"))     # one list a day, as the band writes it
    folder = export_files(day.withColumn("n", F.lit(0)), new_folder(spark, "band"), lambda part: f"heart_rate-{part}.json")
    return X.read_band_hr(spark, f"{folder}/*/heart_rate-*.json").select("t_ms", *r6("bpm"), "confidence")


@query("source_band_tables", """
WITH e AS (SELECT event_id, epoch_us(ts) // 1000000 * 1000 AS t_ms, CAST(ts AS DATE) AS day, value, event_id % 4 AS k FROM events)
SELECT 'details' AS kind, t_ms, NULL::DATE AS day, round(value, 4) AS value, CASE WHEN k >= 3 THEN 'good' ELSE 'fair' END AS quality FROM e WHERE event_id % 10 <> 0 AND value > 0
UNION ALL SELECT 'daily', NULL, day, floor(round(value, 4) * 10 + 0.5e0) / 10, 'rmssd' FROM e WHERE event_id % 10 <> 0 AND value > 0
UNION ALL SELECT 'resting', NULL, day, floor(round(40 + value, 4) * 10 + 0.5e0) / 10, NULL FROM e""")
def _(spark, sf):
    e, v = F.col("event_id"), F.round("value", 4)
    t = T.table(spark, sf, "events")
    rows = t.select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.when(e % 10 == 0, "n/a").otherwise(v.cast("string")).alias("rmssd"), ((e % 4) * 0.3).alias("coverage"))
    folder = new_folder(spark, "tables")
    rows.write.option("header", True).csv(f"{folder}/details")
    rows.drop("coverage").write.option("header", True).csv(f"{folder}/daily")
    cell = F.struct(F.date_format("ts", "MM/dd/yy").alias("date"), F.round(40 + F.col("value"), 4).alias("value"))
    day = t.groupBy(F.to_date("ts").alias("part")).agg(F.to_json(F.collect_list(F.struct(F.lit("01/01/20 00:00:00").alias("dateTime"), cell.alias("value")))).alias("line"))
    export_files(day.withColumn("n", F.lit(0)), f"{folder}/resting", lambda part: f"resting_heart_rate-{part}.json")
    none = F.lit(None)
    details = X.read_band_hrv(spark, f"{folder}/details").select(F.lit("details").alias("kind"), F.col("started_ms").alias("t_ms"), none.cast("date").alias("day"), F.col("rmssd").alias("value"), "quality")
    daily = X.read_band_daily(spark, f"{folder}/daily").select(F.lit("daily").alias("kind"), none.cast("long").alias("t_ms"), "day", F.col("hrv").alias("value"), F.col("hrv_kind").alias("quality"))
    rest = X.read_band_resting(spark, f"{folder}/resting/*/resting_heart_rate-*.json").select(
        F.lit("resting").alias("kind"), none.cast("long").alias("t_ms"), "day", F.col("resting_hr").alias("value"), none.cast("string").alias("quality"))
    return details.unionByName(daily).unionByName(rest)


# a packet: flags (16-bit rate or not, contact, energy, intervals), rate, energy, one or two intervals
PACKETS_SQL = """
SELECT event_id, user_id, epoch_us(ts) // 1000 AS arrived_ms, event_id % 2 AS wide, event_id % 3 <> 0 AS has_contact, event_id % 6 < 3 AS touching, event_id % 5 = 0 AS has_energy, event_id % 7 <> 0 AS has_rr,
 40 + event_id % 90 AS hr, 500 + event_id % 700 AS rr1, 600 + event_id % 500 AS rr2, event_id % 4 <> 1 AS two FROM events"""


def packets(spark, sf):
    e = F.col("event_id")
    byte = lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")
    two = lambda v: F.concat(byte(v % 256), byte(F.floor(v / F.lit(256))))
    flag = ((e % 2) + F.when(e % 3 != 0, 4).otherwise(0) + F.when(e % 6 < 3, 2).otherwise(0) + F.when(e % 5 == 0, 8).otherwise(0) + F.when(e % 7 != 0, 16).otherwise(0))
    hr, none = 40 + e % 90, F.lit("")
    body = F.concat(byte(flag), F.when(e % 2 == 1, two(hr)).otherwise(byte(hr)), F.when(e % 5 == 0, two(300 + e % 50)).otherwise(none),
                    F.when(e % 7 != 0, F.concat(two(500 + e % 700), F.when(e % 4 != 1, two(600 + e % 500)).otherwise(none))).otherwise(none))
    return T.table(spark, sf, "events").select("event_id", "user_id", T.millis("ts").alias("arrived_ms"), F.unhex(body).alias("payload"))


@query("source_hr_packets", f"""
SELECT event_id, hr, CASE WHEN has_contact THEN touching END AS contact, CASE WHEN has_energy THEN 300 + event_id % 50 END AS energy, has_rr AS rr_flag,
 CASE WHEN NOT has_rr THEN 0 WHEN two THEN 2 ELSE 1 END AS n_rr, CASE WHEN has_rr THEN round(rr1 * 1000 / 1024e0, 6) END AS rr1 FROM ({PACKETS_SQL}) p""")
def _(spark, sf):
    return X.parse_hr_packets(packets(spark, sf)).select("event_id", "hr", "contact", "energy", "rr_flag", F.size("rr").alias("n_rr"), F.round(F.get("rr", 0), 6).alias("rr1"))


@query("source_packet_beats", f"""
WITH p AS (SELECT * FROM ({PACKETS_SQL}) p WHERE NOT (has_contact AND NOT touching))
SELECT event_id, 0 AS k, CASE WHEN NOT has_rr THEN arrived_ms WHEN two THEN CAST(floor(arrived_ms - rr2 * 1000 / 1024e0 + 0.5e0) AS BIGINT) ELSE arrived_ms END AS t_ms, CASE WHEN has_rr THEN round(rr1 * 1000 / 1024e0, 6) END AS rr_ms, hr FROM p
UNION ALL SELECT event_id, 1, arrived_ms, round(rr2 * 1000 / 1024e0, 6), hr FROM p WHERE has_rr AND two""")
def _(spark, sf):
    return X.packet_beats(X.parse_hr_packets(packets(spark, sf)), ["event_id"]).select("event_id", "k", "t_ms", *r6("rr_ms"), "hr")


@query("source_sensor_frames", """
SELECT event_id, 'acc' AS type, 946684800000 + event_id * 5 AS epoch_ms, CASE WHEN event_id % 2 = 0 THEN event_id % 256 - CASE WHEN event_id % 256 >= 128 THEN 256 ELSE 0 END ELSE event_id % 65536 - CASE WHEN event_id % 65536 >= 32768 THEN 65536 ELSE 0 END END AS x FROM events""")
def _(spark, sf):
    e = F.col("event_id")
    byte = lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")
    ns = e * 5_000_000
    clock = F.concat(*[byte(F.pmod(F.floor(ns / F.lit(float(256 ** k))), F.lit(256))) for k in range(8)])
    one = F.when(e % 2 == 0, byte(e % 256)).otherwise(F.concat(byte(e % 256), byte(F.floor(e / F.lit(256)) % 256)))
    body = F.concat(F.lit("02"), clock, F.when(e % 2 == 0, "00").otherwise("01"), one, one, one)
    f = X.parse_frames(T.table(spark, sf, "events").select("event_id", F.unhex(body).alias("payload")))
    return f.select("event_id", "type", "epoch_ms", F.get("samples", 0).alias("x"))


@query("source_import_limits", f"""
WITH h AS (SELECT owner, t_ms AS started_ms, bpm FROM ({HR_SQL}) h), c AS (SELECT owner, max(started_ms) - 7776000000 AS cut FROM h GROUP BY owner),
k AS (SELECT h.owner, started_ms, row_number() OVER (PARTITION BY h.owner ORDER BY started_ms DESC) AS r FROM h JOIN c USING (owner) WHERE started_ms > cut)
SELECT owner, count(*) AS n, min(started_ms) AS oldest FROM k WHERE r <= 100 GROUP BY owner""")
def _(spark, sf):
    h = hr_samples(spark, sf).withColumnRenamed("t_ms", "started_ms")
    return X.limited(h, ["owner"], rows=100).groupBy("owner").agg(F.count("*").alias("n"), F.min("started_ms").alias("oldest"))


@query("source_import_summary", f"""
WITH h AS (SELECT owner, k * 60000 AS s FROM (SELECT DISTINCT owner, t_ms // 60000 AS k FROM ({HR_SQL}) h WHERE bpm BETWEEN 30 AND 220) q)
SELECT owner, count(*) AS n_hr, 0 AS n_hrv, 0 AS dropped, CAST(make_timestamp(min(s) * 1000) AS DATE) AS from_day, CAST(make_timestamp(max(s) * 1000) AS DATE) AS to_day, n_rest FROM h
JOIN (SELECT user_id % 15 AS owner, count(DISTINCT CAST(ts AS DATE)) AS n_rest FROM events WHERE event_type = 'click' GROUP BY 1) d USING (owner) GROUP BY owner, n_rest""")
def _(spark, sf):
    m = X.minute_hr(hr_samples(spark, sf), ["owner"], "t_ms", "bpm")
    m = X.measurement(m, source="import-apple", device=F.lit("x"), started=F.col("started_ms"), duration=F.lit(60), quality=F.col("quality"), hr=F.col("hr_mean"), keep=["owner"])
    e = T.table(spark, sf, "events").select((F.col("user_id") % 15).alias("owner"), "event_type", F.to_date("ts").alias("day"), "value")
    daily = X.daily_context(e.filter("event_type = 'click'"), e.filter("event_type = 'none'"), ["owner"], "day", "value")
    return X.import_summary(m, X.limited(m, ["owner"]), daily, ["owner"]).select("owner", "n_hr", "n_hrv", "dropped", "from_day", "to_day", "n_rest")
