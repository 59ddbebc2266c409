"""Readers for device exports. Every reader returns measurements, daily context or beats as DataFrames.

Formats are read with Spark's own readers; files are spread over tasks by the reader. Text files whose line numbers mean
something (channels, intervals, vitals) are read split by split with exact numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid import constants as K
from pulsegrid.functions.scalar import round_up, upper_middle
from pulsegrid.operators.beats import beat_features
from pulsegrid.operators.records import keep_recent, newest_n

# -- routing ------------------------------------------------------------------------------------------

FILE_KINDS = {
    "hr": r"^heart_rate-\d{4}-\d{2}-\d{2}\.json$",
    "resting": r"^resting_heart_rate-.*\.json$",
    "hrv-details": r"(?i)^Heart Rate Variability Details.*\.csv$",
    "hrv-daily": r"(?i)^Daily Heart Rate Variability Summary.*\.csv$",
    "EDA": r"^EDA\.csv$", "TEMP": r"^TEMP\.csv$", "ACC": r"^ACC\.csv$", "HR": r"^HR\.csv$", "IBI": r"^IBI\.csv$",
}


def file_name(path: Column) -> Column:
    """The last part of a path; Spark's own paths have blanks and other signs percent-encoded."""
    last = F.element_at(F.split(path, "/"), -1)
    return F.coalesce(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))), last)


def file_kind(path: Column) -> Column:
    """Kind of an export file by its name; NULL for files that are not read."""
    name = file_name(path)
    kind = F.lit(None).cast("string")
    for k, pattern in reversed(FILE_KINDS.items()):
        kind = F.when(name.rlike(pattern), k).otherwise(kind)
    return kind


def wristband_id(path: Column) -> Column:
    found = F.regexp_extract(file_name(path), r"(\d{9,11})_([A-Z0-9]{6})", 2)
    return F.when(found != "", F.concat(F.lit("Empatica E4 "), found)).otherwise("Empatica E4")


# -- times --------------------------------------------------------------------------------------------

def zoned_millis(text: Column) -> Column:
    """`2024-03-01 09:41:03 -0800` to epoch ms."""
    return F.unix_millis(F.try_to_timestamp(F.trim(text), F.lit("yyyy-MM-dd HH:mm:ss Z")))


def clock_seconds(text: Column) -> Column:
    """`9:41:03.12 PM` to seconds of the day (24 h when there is no AM/PM)."""
    pattern = r"(?i)^(\d{1,2}):(\d{2}):(\d{2}(?:\.\d+)?)\s*(AM|PM)?$"
    part = lambda i: F.regexp_extract(F.trim(text), pattern, i)
    h = part(1).try_cast("int")
    half = F.upper(part(4))
    hour = F.when((half == "PM") & (h < 12), h + 12).when((half == "AM") & (h == 12), 0).otherwise(h)
    return hour * 3600 + part(2).try_cast("int") * 60 + part(3).try_cast("double")


def short_utc_millis(text: Column) -> Column:
    """`03/01/24[ 08:00:05]` (UTC) to epoch ms."""
    t = F.trim(text)
    forms = ["MM/dd/yy HH:mm:ss", "MM/dd/yy", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy"]
    return F.unix_millis(F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in forms]))


def iso_millis(text: Column) -> Column:
    return F.unix_millis(text.try_cast("timestamp"))


# -- common shapes ------------------------------------------------------------------------------------

MEASUREMENT = ["source", "device", "started_ms", "duration_s", "quality", "hr_mean", "rmssd", "sdnn"]


def measurement(df: DataFrame, *, source: str, device: Column, started: Column, duration: Column, quality: Column,
                hr: Column | None = None, rmssd: Column | None = None, sdnn: Column | None = None, keep: list[str] = []) -> DataFrame:
    null = F.lit(None).cast("double")
    pick = lambda c: (null if c is None else c.cast("double"))
    return df.select(*keep, F.lit(source).alias("source"), device.alias("device"), started.cast("long").alias("started_ms"),
                     duration.cast("long").alias("duration_s"), quality.alias("quality"), pick(hr).alias("hr_mean"),
                     pick(rmssd).alias("rmssd"), pick(sdnn).alias("sdnn"))


def minute_hr(samples: DataFrame, owner: list[str], t: str, bpm: str) -> DataFrame:
    """Mean heart rate per minute from spot samples in 30..220 bpm; good from six samples on."""
    k = F.floor(F.col(t) / F.lit(K.WINDOW_S * 1000.0))
    return (samples.filter(F.col(bpm).between(30, 220)).groupBy(*owner, k.alias("_k"))
            .agg(F.avg(bpm).alias("hr_mean"), F.count("*").alias("n"))
            .select(*owner, (F.col("_k") * K.WINDOW_S * 1000).alias("started_ms"), "hr_mean", "n",
                    F.when(F.col("n") >= 6, "good").otherwise("fair").alias("quality")))


def minute_hr_covered(samples: DataFrame, owner: list[str], t: str, bpm: str) -> DataFrame:
    """Mean heart rate per minute with the share of the minute that samples cover.

    Spacing is the upper median of the steps within the minute, between 1 and 15 s (5 s for one sample). Times
    are whole milliseconds; equal times are counted before anything is collected, so a minute's array has at
    most 60 000 entries. Minutes under a quarter are dropped.
    """
    k = F.floor(F.col(t) / F.lit(K.WINDOW_S * 1000.0))
    per_t = (samples.filter(F.col(bpm).between(30, 220)).groupBy(*owner, k.alias("_k"), F.col(t).alias("_t"))
             .agg(F.sum(F.col(bpm).cast("double")).alias("_s"), F.count("*").alias("_n")))
    agg = per_t.groupBy(*owner, "_k").agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"), F.sort_array(F.collect_list("_t")).alias("_ts"))
    times = F.col("_ts")
    m = F.size(times)
    gaps = F.zip_with(F.slice(times, F.lit(2), F.greatest(m - 1, F.lit(0))), F.slice(times, F.lit(1), F.greatest(m - 1, F.lit(0))), lambda b, a: b - a)
    zeros = F.array_repeat(F.lit(0).cast("long"), (F.col("_n") - m).cast("int"))
    step = F.when(F.col("_n") > 1, F.least(F.greatest(upper_middle(F.concat(gaps, zeros)), F.lit(1000)), F.lit(15000))).otherwise(5000)
    cov = F.least(F.lit(1.0), F.col("_n") * step / (K.WINDOW_S * 1000.0))
    return (agg.withColumn("coverage", cov).filter("coverage >= 0.25")
            .select(*owner, (F.col("_k") * K.WINDOW_S * 1000).alias("started_ms"), (F.col("_s") / F.col("_n")).alias("hr_mean"),
                    F.col("_n").alias("n"), "coverage", F.when(F.col("coverage") >= 0.75, "good").otherwise("fair").alias("quality")))


def daily_context(resting: DataFrame, hrv: DataFrame, owner: list[str], day: str, value: str, kind: str = "sdnn") -> DataFrame:
    """Daily means of resting heart rate and variability, to 0.1, for all days that have either."""
    mean = lambda d, name: d.groupBy(*owner, day).agg(round_up(F.avg(value), 1).alias(name))
    return (mean(resting, "resting_hr").join(mean(hrv, "hrv"), [*owner, day], "full")
            .withColumn("hrv_kind", F.when(F.col("hrv").isNotNull(), kind)))


def limited(measurements: DataFrame, owner: list[str], days: int = K.IMPORT_DAYS, rows: int = K.IMPORT_ROWS) -> DataFrame:
    """The last `days` days before the newest row, and the newest `rows` of those, per import.

    This is the import's retention rule; `import_summary` reports what it left out.
    """
    d = measurements.withColumn("_ts", F.timestamp_millis("started_ms"))
    kept = keep_recent(d, owner, "_ts", days) if owner else keep_recent(d.withColumn("_one", F.lit(1)), ["_one"], "_ts", days)
    key = owner or ["_one"]
    return newest_n(kept, key, ["started_ms"], rows).drop("_ts", "_one")


def import_summary(all_rows: DataFrame, kept: DataFrame, daily: DataFrame, owner: list[str]) -> DataFrame:
    """Counts by kind, date span, days with resting heart rate and rows left out, per import."""
    total = all_rows.groupBy(*owner).agg(F.count("*").alias("_all"))
    hrv = F.col("rmssd").isNotNull() | F.col("sdnn").isNotNull()
    got = kept.groupBy(*owner).agg(
        F.count(F.when(~hrv, 1)).alias("n_hr"), F.count(F.when(hrv, 1)).alias("n_hrv"), F.count("*").alias("_kept"),
        F.timestamp_millis(F.min("started_ms")).cast("date").alias("from_day"), F.timestamp_millis(F.max("started_ms")).cast("date").alias("to_day"))
    rest = daily.groupBy(*owner).agg(F.count("resting_hr").alias("n_rest"))
    d = total.join(got, owner, "left").join(rest, owner, "left").fillna(0, ["n_hr", "n_hrv", "_kept", "n_rest"])
    return d.withColumn("dropped", F.col("_all") - F.col("_kept")).drop("_all", "_kept")


def summary_sentence(summary: DataFrame, title: str, hrv_name: str = "HRV reading", days: int = K.IMPORT_DAYS) -> DataFrame:
    n = lambda c, one: F.concat(F.format_number(c, 0), F.lit(f" {one}"), F.when(F.col(c) == 1, "").otherwise("s"))
    day = lambda c: F.date_format(c, "d MMM yyyy")
    text = F.concat(
        F.lit(f"{title}: "), n("n_hr", "heart-rate minute"), F.lit(" and "), n("n_hrv", hrv_name),
        F.coalesce(F.concat(F.lit(" from "), day("from_day"), F.lit(" to "), day("to_day")), F.lit("")),
        F.lit(". Resting heart rate on "), n("n_rest", "day"), F.lit("."),
        F.when(F.col("dropped") > 0, F.concat(F.lit(" "), n("dropped", "older reading"), F.lit(f" left out (only the last {days} days are kept)."))).otherwise(""))
    return summary.withColumn("summary", text)


# -- health export (XML) ------------------------------------------------------------------------------

HEALTH_SCHEMA = """_type string, _startDate string, _endDate string, _sourceName string, _value string,
 HeartRateVariabilityMetadataList struct<InstantaneousBeatsPerMinute: array<struct<_bpm: string, _time: string>>>"""
HEART_RATE = "HKQuantityTypeIdentifierHeartRate"
VARIABILITY = "HKQuantityTypeIdentifierHeartRateVariabilitySDNN"
RESTING = "HKQuantityTypeIdentifierRestingHeartRate"


def read_health_xml(spark: SparkSession, path: str) -> DataFrame:
    """Heart-rate, variability and resting records; other types are dropped before anything else."""
    raw = spark.read.option("rowTag", "Record").schema(HEALTH_SCHEMA).xml(path)
    value = F.col("_value").try_cast("double")
    return (raw.filter(F.col("_type").isin(HEART_RATE, VARIABILITY, RESTING)).select(
        F.col("_type").alias("type"), zoned_millis(F.col("_startDate")).alias("t_ms"),
        F.coalesce(zoned_millis(F.col("_endDate")), zoned_millis(F.col("_startDate"))).alias("end_ms"),
        F.substring("_startDate", 1, 10).try_cast("date").alias("day"), F.col("_sourceName").alias("device"), value.alias("value"),
        F.col("HeartRateVariabilityMetadataList.InstantaneousBeatsPerMinute").alias("beats"))
        .filter("t_ms IS NOT NULL AND value IS NOT NULL"))


def intervals_from_clock(beats: Column) -> Column:
    """RR in ms from an HRV record's beats: time steps (past midnight adds a day), else 60000 / bpm."""
    bpm = F.filter(F.transform(beats, lambda b: b["_bpm"].try_cast("double")), lambda x: x.isNotNull())
    secs = F.filter(F.transform(beats, lambda b: clock_seconds(b["_time"])), lambda x: x.isNotNull())
    n = F.size(secs)
    steps = F.zip_with(F.slice(secs, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(secs, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda b, a: b - a)
    rr = F.transform(steps, lambda d: round_up(F.when(d < -43200, d + 86400).otherwise(d) * 1000).cast("double"))
    return F.when((n == F.size(bpm)) & (n >= 2), rr).otherwise(F.transform(F.filter(bpm, lambda b: b > 0), lambda b: F.lit(60000.0) / b))


def health_measurements(records: DataFrame, owner: list[str] = []) -> DataFrame:
    minutes = minute_hr(records.filter(F.col("type") == HEART_RATE), owner, "t_ms", "value")
    hr = measurement(minutes, source="import-apple", device=F.lit("Apple Health"), started=F.col("started_ms"), duration=F.lit(60),
                     quality=F.col("quality"), hr=F.col("hr_mean"), keep=owner)
    v = records.filter(F.col("type") == VARIABILITY).withColumn("_id", F.xxhash64(*owner, "t_ms", "end_ms", "device", "value"))
    v = v.withColumn("_rr", intervals_from_clock("beats")) if "beats" in v.columns else v.withColumn("_rr", F.array().cast("array<double>"))
    rows = v.dropDuplicates(["_id", *owner]).select(*owner, "_id", F.posexplode("_rr").alias("_k", "rr_ms"))
    feats = beat_features(rows, [*owner, "_id"], ["_k"], duration_s=None).withColumnsRenamed({"hr_mean": "_hr", "rmssd": "_rm", "sdnn": "_sd"})
    j = v.join(feats, [*owner, "_id"], "left")
    valid = F.coalesce("hrv_valid", F.lit(False))
    duration = F.greatest(F.lit(1), round_up((F.col("end_ms") - F.col("t_ms")) / 1000.0))
    hrv = measurement(j, source="import-apple", device=F.col("device"), started=F.col("t_ms"), duration=duration, quality=F.lit("fair"),
                      hr=F.col("_hr"), rmssd=F.when(valid, F.col("_rm")), sdnn=F.when(valid, F.col("_sd")).otherwise(F.col("value")), keep=owner)
    return hr.unionByName(hrv)


def health_daily(records: DataFrame, owner: list[str] = []) -> DataFrame:
    return daily_context(records.filter(F.col("type") == RESTING), records.filter(F.col("type") == VARIABILITY), owner, "day", "value")


# -- band export (JSON and CSV) -----------------------------------------------------------------------

def read_band_hr(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema("dateTime string, value struct<bpm: double, confidence: double>").option("multiLine", True).json(path)
    return (raw.select(short_utc_millis(F.col("dateTime")).alias("t_ms"), F.col("value.bpm").alias("bpm"), F.col("value.confidence").alias("confidence"))
            .filter(F.col("bpm").between(30, 220) & ~F.coalesce(F.col("confidence") == 0, F.lit(False)) & F.col("t_ms").isNotNull()))


def read_band_resting(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema("dateTime string, value struct<date: string, value: double>").option("multiLine", True).json(path)
    day = F.timestamp_millis(short_utc_millis(F.coalesce(F.col("value.date"), F.col("dateTime")))).cast("date")
    return raw.filter(F.col("value.value") > 0).select(day.alias("day"), round_up(F.col("value.value"), 1).alias("resting_hr"))


def read_band_hrv(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    rm, cov = F.col("rmssd").try_cast("double"), F.col("coverage").try_cast("double")
    d = raw.select(iso_millis(F.col("timestamp")).alias("t_ms"), rm.alias("rm"), cov.alias("cov")).filter("t_ms IS NOT NULL AND rm > 0")
    return measurement(d, source="import-fitbit", device=F.lit("Fitbit"), started=F.col("t_ms"), duration=F.lit(300),
                       quality=F.when(F.col("cov") >= 0.8, "good").otherwise("fair"), rmssd=F.col("rm"))


def read_band_daily(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    rm = F.col("rmssd").try_cast("double")
    return raw.filter(rm > 0).select(F.substring("timestamp", 1, 10).try_cast("date").alias("day"), round_up(rm, 1).alias("hrv"), F.lit("rmssd").alias("hrv_kind"))


def band_measurements(hr: DataFrame, hrv: DataFrame | None = None, owner: list[str] = []) -> DataFrame:
    m = measurement(minute_hr_covered(hr, owner, "t_ms", "bpm"), source="import-fitbit", device=F.lit("Fitbit"), started=F.col("started_ms"),
                    duration=F.lit(60), quality=F.col("quality"), hr=F.col("hr_mean"), keep=owner)
    return m if hrv is None else m.unionByName(hrv, allowMissingColumns=True)


# -- wristband session --------------------------------------------------------------------------------

def numbered_lines(spark: SparkSession, path: str, skip_empty: bool = False) -> DataFrame:
    """(file, line, value): every line (that is not empty) of text files with its number in its file, from 0.

    Large files are read by many tasks. A split's lines stand together in one task, so a line's place in its split is a difference
    of running ids; what comes before the split are the counts of the file's earlier splits, one row a split.
    """
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"))
    raw = (text.filter("value <> ''") if skip_empty else text).withColumn("_id", F.monotonically_increasing_id())
    earlier = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = raw.groupBy("file", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    splits = splits.withColumn("_shift", F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).select("file", "_block", "_shift")
    return raw.join(splits, ["file", "_block"]).select("file", (F.col("_id") + F.col("_shift")).alias("line"), "value")


def _session(file: Column) -> Column:
    return F.regexp_replace(file, r"/[^/]+$", "")


def _head(lines: DataFrame, n: int) -> DataFrame:
    """The first cells of the first `n` lines of every file, as numbers: file, h0, h1, ..."""
    first = F.split("value", ",")[0].try_cast("double")
    return lines.filter(F.col("line") < n).groupBy("file").agg(*[F.max(F.when(F.col("line") == i, first)).alias(f"h{i}") for i in range(n)])


def read_channel(spark: SparkSession, path: str) -> DataFrame:
    """Channel files: row 1 start time (s) per column, row 2 rate, then samples of 1 or 3 columns.

    (file, session, channel, start_ms, hz, idx, v1, v2, v3). Empty lines are passed over.
    """
    lines = numbered_lines(spark, path, skip_empty=True)
    head = _head(lines, 2).select("file", (F.col("h0") * 1000).alias("start_ms"), F.col("h1").alias("hz")).filter("start_ms IS NOT NULL AND hz > 0")
    body = lines.filter("line >= 2").join(head, "file")
    cell = lambda i: F.get(F.split("value", ","), i).try_cast("double")
    return body.select("file", _session(F.col("file")).alias("session"), F.regexp_replace(file_name(F.col("file")), r"\.csv$", "").alias("channel"),
                       "start_ms", "hz", (F.col("line") - 2).alias("idx"), cell(0).alias("v1"), cell(1).alias("v2"), cell(2).alias("v3"))


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """Interval files to beat end times and intervals: (session, t_ms, rr_ms)."""
    lines = numbered_lines(spark, path, skip_empty=True)
    d = lines.filter("line > 0").join(_head(lines, 1), "file")
    o, v = F.get(F.split("value", ","), 0).try_cast("double"), F.get(F.split("value", ","), 1).try_cast("double")
    return d.select(_session(F.col("file")).alias("session"), (F.col("h0") * 1000 + o * 1000).alias("t_ms"), (v * 1000).alias("rr_ms")).filter("t_ms IS NOT NULL AND rr_ms IS NOT NULL")


def wristband_measurements(channels: DataFrame, beats: DataFrame, device: Column | None = None) -> DataFrame:
    """One measurement per full minute of a session, from whichever channels are there."""
    from pulsegrid.operators.signals import array_mean, eda_kernel, slope_per_minute  # noqa: F401
    from pulsegrid.operators import signals as S

    s = ["session"]
    w = K.WINDOW_S * 1000
    span = channels.groupBy(*s, "channel").agg(F.min("start_ms").alias("a"), (F.min("start_ms") + F.count("*") / F.max("hz") * 1000).alias("b"))
    bspan = beats.groupBy(*s).agg(F.min_by(F.col("t_ms") - F.col("rr_ms"), "t_ms").alias("a"), F.max("t_ms").alias("b"))
    ends = span.select(*s, "a", "b").unionByName(bspan).groupBy(*s).agg(F.min("a").alias("t0"), F.max("b").alias("t1"))
    slots = ends.withColumn("_n", F.floor((F.col("t1") + 1 - F.col("t0")) / F.lit(float(w)))).filter("_n > 0").select(
        *s, "t0", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_k")).withColumn("start_ms", F.col("t0") + F.col("_k") * w)
    placed = channels.withColumnRenamed("start_ms", "_c0").join(ends, s)
    offset = F.rint((F.col("t0") - F.col("_c0")) / 1000 * F.col("hz"))
    k = F.floor((F.col("idx") - offset) / (F.col("hz") * K.WINDOW_S))
    placed = placed.withColumn("_k", k.cast("long")).filter("_k >= 0")
    full = placed.groupBy(*s, "channel", "_k").agg(
        F.count("*").alias("_n"), F.max("hz").alias("hz"), F.avg("v1").alias("_mean"),
        F.stddev_pop(F.sqrt(F.col("v1") * F.col("v1") + F.col("v2") * F.col("v2") + F.col("v3") * F.col("v3")) / K.ACC_UNITS_PER_G).alias("_acc"),
        F.regr_slope("v1", F.col("idx") / F.col("hz") / 60.0).alias("_slope"),
        F.when(F.first("channel") == "EDA", F.transform(F.sort_array(F.collect_list(F.when(F.col("channel") == "EDA", F.struct("idx", "v1")))), lambda x: x["v1"])).alias("eda"))
    full = full.filter(F.col("_n") >= F.col("hz") * K.WINDOW_S)
    eda = S.eda_features(full.filter("channel = 'EDA'").select(*s, "_k", "eda"), "eda", window_s=K.WINDOW_S).drop("eda")
    temp = full.filter("channel = 'TEMP'").select(*s, "_k", F.col("_mean").alias("temp_mean"), F.col("_slope").alias("temp_slope"))
    acc = full.filter("channel = 'ACC'").select(*s, "_k", F.col("_acc").alias("acc_std"))
    hr = full.filter("channel = 'HR'").select(*s, "_k", F.col("_mean").alias("_hr"))
    b = beats.join(ends.select(*s, "t0"), s).withColumn("_k", F.floor((F.col("t_ms") - F.col("t0")) / F.lit(float(w)))).filter("_k >= 0")
    feats = beat_features(b, [*s, "_k"], ["t_ms"]).select(*s, "_k", "hr_mean", "rmssd", "sdnn", "hrv_valid")
    d = slots
    for part in (feats, hr, eda, temp, acc):
        d = d.join(part, [*s, "_k"], "left")
    d = d.withColumn("hr_mean", F.coalesce("hr_mean", "_hr"))
    feature = ["hr_mean", "rmssd", "sdnn", "eda_tonic", "eda_slope", "scr_count", "scr_amp", "temp_mean", "temp_slope", "acc_std"]
    moving = F.col("acc_std") > K.MOTION_WRIST_G
    quality = (F.when(moving, "poor").when(F.col("eda_tonic").isNotNull() & F.col("temp_mean").isNotNull() & F.coalesce("hrv_valid", F.lit(False)), "good")
               .when(F.col("hr_mean").isNotNull(), "fair").otherwise("poor"))
    return d.filter(F.coalesce(*feature).isNotNull()).select(
        *s, F.lit("import-e4").alias("source"), (device if device is not None else wristband_id(F.col("session"))).alias("device"),
        round_up(F.col("start_ms")).cast("long").alias("started_ms"), F.lit(K.WINDOW_S).alias("duration_s"), quality.alias("quality"), *feature,
        moving.alias("motion_flagged"))


# -- recordings and older trainers --------------------------------------------------------------------

CHUNK_SCHEMA = "subject string, channel string, fs int, start_ms bigint, samples array<double>"


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Multi-rate recordings stored as chunks, partitioned by subject."""
    return spark.read.schema(CHUNK_SCHEMA).parquet(path)


def chunk_samples(chunks: DataFrame) -> DataFrame:
    """(subject, channel, fs, idx, value) with idx counted from the epoch of the chunk starts."""
    base = F.floor(F.col("start_ms") * F.col("fs") / 1000.0)
    return chunks.select("subject", "channel", "fs", base.alias("_b"), F.posexplode("samples").alias("_i", "value")).select(
        "subject", "channel", "fs", (F.col("_b") + F.col("_i")).alias("idx"), "value")


def read_questionnaire(spark: SparkSession, path: str) -> DataFrame:
    """Subject facts from free-text questionnaires, one file per subject."""
    raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    line = lambda k: F.nullif(F.trim(F.regexp_extract("value", rf"\Q{k}\E:[ \t]*([^\r\n]+)", 1)), F.lit(""))
    yes = lambda k: F.nullif(F.upper(F.regexp_extract("value", rf"\Q{k}\E\s*(\w+)", 1)), F.lit("")) == "YES"
    notes = F.get(F.split("value", r"\Q### Additional notes ###\E"), 1)
    return raw.select(
        "file", line("Age").try_cast("double").alias("age"), line("Height (cm)").try_cast("double").alias("height_cm"),
        line("Weight (kg)").try_cast("double").alias("weight_kg"), F.lower(line("Gender")).alias("gender"), F.lower(line("Dominant hand")).alias("dominant_hand"),
        yes("Did you drink coffee today?").alias("coffee_today"), yes("Did you do any sports today?").alias("sports_today"),
        yes("Are you a smoker?").alias("smoker"), yes("Do you feel ill today?").alias("ill_today"), F.coalesce(F.regexp_replace(notes, r"^\s+|\s+$", ""), F.lit("")).alias("notes"))


def tidy_header(df: DataFrame, rename: dict[str, str] = {}) -> DataFrame:
    """Column names trimmed, lower case, blanks to underscores; then renamed."""
    names = [c.strip().lower().replace(" ", "_") for c in df.columns]
    return df.toDF(*[rename.get(n, n) for n in names])


def read_keystrokes(spark: SparkSession, path: str) -> DataFrame:
    d = tidy_header(spark.read.option("header", True).option("sep", "\t").csv(path), {"relase_time": "release_time"})
    return d.select(F.col("press_time").try_cast("timestamp").alias("press_time"), F.col("release_time").try_cast("timestamp").alias("release_time"))


def read_mouse_speeds(spark: SparkSession, path: str) -> DataFrame:
    d = tidy_header(spark.read.option("header", True).option("sep", "\t").csv(path), {"time": "timestamp", "speed(ms)": "speed"})
    return d.select(F.col("timestamp").try_cast("timestamp").alias("timestamp"), F.col("speed").try_cast("double").alias("speed"))


def read_conditions(spark: SparkSession, path: str) -> DataFrame:
    d = tidy_header(spark.read.option("header", True).option("sep", "\t").csv(path))
    return d.select(F.col("time").try_cast("timestamp").alias("time"), F.contains(F.lower("stress_val"), F.lit("stressed")).cast("int").alias("stress"))


def read_vitals(spark: SparkSession, path: str, column: str = "SpO2", least: int = 60) -> DataFrame:
    """Vitals files that have the column and enough readings: (file, row, value), rows numbered from 1 in the order of the file.
    Headers may differ per file, so every file's own header line gives the position."""
    lines = numbered_lines(spark, path)
    names = F.transform(F.split("value", ","), lambda c: F.trim(c))
    head = lines.filter("line = 0").select("file", F.array_position(names, column).cast("int").alias("_at")).filter("_at > 0")
    cell = F.get(F.split("value", ","), F.col("_at") - 1).try_cast("double")
    v = lines.filter("line > 0").join(head, "file").select("file", F.col("line").alias("row"), cell.alias("value")).filter("value IS NOT NULL")
    many = v.groupBy("file").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select("file")
    return v.join(many, "file", "left_semi")


# -- radio packets ------------------------------------------------------------------------------------

def _u8(p: Column, at: Column | int) -> Column:
    at = at if isinstance(at, Column) else F.lit(at)
    return F.conv(F.hex(F.substring(p, at + 1, F.lit(1))), 16, 10).try_cast("long")


def _u16(p: Column, at: Column | int) -> Column:
    at = at if isinstance(at, Column) else F.lit(at)
    return _u8(p, at) + _u8(p, at + 1) * 256


def parse_hr_packets(packets: DataFrame, payload: str = "payload") -> DataFrame:
    """Heart-rate notifications: hr, contact (NULL = not reported), energy, rr array (ms), rr_flag. Packets that are
    too short are dropped."""
    p = F.col(payload)
    n = F.length(p)
    d = packets.filter(n >= 2).withColumn("_flags", _u8(p, 0))
    bit = lambda b: F.col("_flags").bitwiseAND(F.lit(b)) != 0
    d = d.filter(~bit(1) | (n >= 3)).withColumn("hr", F.when(bit(1), _u16(p, 1)).otherwise(_u8(p, 1)))
    d = d.withColumn("_o", F.when(bit(1), 3).otherwise(2)).withColumn("contact", F.when(bit(4), bit(2)))
    d = d.withColumn("energy", F.when(bit(8) & (F.col("_o") + 2 <= n), _u16(p, F.col("_o"))))
    d = d.withColumn("_o", F.col("_o") + F.when(bit(8), 2).otherwise(0)).withColumn("rr_flag", bit(16))
    count = F.floor((n - F.col("_o")) / F.lit(2)).cast("int")
    rr = F.when(F.col("rr_flag") & (count > 0), F.transform(F.sequence(F.lit(0), count - 1), lambda i: _u16(p, F.col("_o") + i * 2) * 1000 / 1024.0))
    return d.withColumn("rr", F.coalesce(rr, F.expr("CAST(array() AS ARRAY<DOUBLE>)"))).drop("_flags", "_o")


def packet_beats(parsed: DataFrame, keep: list[str], arrived: str = "arrived_ms") -> DataFrame:
    """Beats of parsed packets: intervals of one packet are spread back in time so that the last ends at arrival.
    Packets without skin contact or with heart rate 0 give none."""
    ok = parsed.filter(F.coalesce("contact", F.lit(True)) & (F.col("hr") != 0))
    none = F.array(F.struct(F.lit(None).cast("double").alias("rr"), F.col(arrived).cast("double").alias("t"), F.lit(0).alias("k")))
    spread = F.transform("rr", lambda r, i: F.struct(
        r.alias("rr"), (F.col(arrived) - F.aggregate(F.slice("rr", i + 2, F.size("rr")), F.lit(0.0), lambda s, x: s + x)).alias("t"), i.alias("k")))
    d = ok.select(*keep, arrived, "hr", F.explode(F.when(F.size("rr") > 0, spread).otherwise(none)).alias("_b"))
    return d.select(*keep, arrived, F.col("_b.k").alias("k"), round_up(F.col("_b.t")).cast("long").alias("t_ms"), F.col("_b.rr").alias("rr_ms"), "hr")


FRAME_EPOCH_MS = 946_684_800_000  # 2000-01-01


def _signed(value: Column, bits: int) -> Column:
    return F.when(value >= 2 ** (bits - 1), value - 2 ** bits).otherwise(value)


def parse_frames(frames: DataFrame, payload: str = "payload") -> DataFrame:
    """Sensor frames to samples: type (ecg or acc), epoch_ms of the last sample, samples (acc: x, y, z in turn).
    Unknown types and short frames are dropped."""
    p = F.col(payload)
    n = F.length(p)
    le = lambda at, w: sum((_u8(p, at + k) * (256 ** k) for k in range(1, w)), _u8(p, at))
    d = frames.filter(n >= 10).withColumn("_m", _u8(p, 0)).withColumn("_f", _u8(p, 9))
    d = d.withColumn("type", F.when((F.col("_m") == 0) & (F.col("_f") == 0), "ecg").when((F.col("_m") == 2) & (F.col("_f") <= 2), "acc")).filter("type IS NOT NULL")
    # nanoseconds after 2000 in eight bytes; a signed 64-bit number holds them for 292 years
    d = d.withColumn("_ns", le(F.lit(1), 8)).withColumn("epoch_ms", F.lit(FRAME_EPOCH_MS) + F.expr("_ns div 1000000"))
    width = F.when(F.col("type") == "ecg", 3).otherwise(F.col("_f") + 1)
    per = F.when(F.col("type") == "ecg", 1).otherwise(3)
    d = d.withColumn("_w", width).withColumn("_n", (F.floor((n - 10) / (F.col("_w") * per)) * per).cast("int"))

    def sample(i):
        at = F.lit(10) + i * F.col("_w")
        return (F.when(F.col("_w") == 1, _signed(_u8(p, at), 8)).when(F.col("_w") == 2, _signed(_u16(p, at), 16))
                .otherwise(_signed(le(at, 3), 24)))

    s = F.when(F.col("_n") > 0, F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: sample(i.cast("long")).cast("long")))
    return d.withColumn("samples", F.coalesce(s, F.expr("CAST(array() AS ARRAY<BIGINT>)"))).drop("_m", "_f", "_w", "_n", "_ns")


def chest_motion(frames: DataFrame, keep: list[str]) -> DataFrame:
    """SD of the acceleration magnitude (g) over the samples of a key, from parsed frames in milli-g."""
    flat = frames.filter("type = 'acc'").select(*keep, F.explode(F.transform(
        F.sequence(F.lit(0), (F.size("samples") / 3 - 1).cast("int")), lambda i: F.sqrt(
            F.pow(F.get("samples", i * 3), F.lit(2)) + F.pow(F.get("samples", i * 3 + 1), F.lit(2)) + F.pow(F.get("samples", i * 3 + 2), F.lit(2))) / 1000.0)).alias("g"))
    return flat.groupBy(*keep).agg(F.stddev_pop("g").alias("acc_std")).withColumn("flagged", F.col("acc_std") > K.MOTION_CHEST_G)
