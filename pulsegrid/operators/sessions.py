"""Guided stress sessions: series, summary numbers, rest readings, labelled runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid import constants as K
from pulsegrid.functions.scalar import round_up
from pulsegrid.operators.beats import beat_features
from pulsegrid.operators.ordered import Ordered
from pulsegrid.operators.windows import assign_windows, complete_windows

S = ["session"]


def instant_hr(rr: str = "rr_ms", hr: str = "hr") -> Column:
    return F.when(F.col(rr) > 0, 60000.0 / F.col(rr)).otherwise(F.col(hr))


def phase_table(phases: DataFrame) -> DataFrame:
    """One row per session with the bounds of its (first) rest, challenge and recovery phase, and its start."""
    cols = []
    for p in ("rest", "challenge", "recovery"):
        hit = F.col("phase") == p
        cols += [F.min_by(F.when(hit, F.col("start_ms")), F.when(hit, F.col("start_ms"))).alias(f"{p}_start"),
                 F.min_by(F.when(hit, F.col("end_ms")), F.when(hit, F.col("start_ms"))).alias(f"{p}_end")]
    return phases.groupBy(*S).agg(F.min("start_ms").alias("t0"), *cols)


def hr_series(beats: DataFrame, starts: DataFrame, bin_s: int = 5) -> DataFrame:
    """Heart rate in bins from the session start: (session, t, hr), t in seconds at the bin centre.

    Sessions with fewer than five beats have no series.
    """
    hr = instant_hr()
    enough = beats.groupBy(*S).agg(F.count("*").alias("_n")).filter("_n >= 5").select(*S)
    b = beats.join(starts, S).join(enough, S, "left_semi").filter(F.col("t_ms") >= F.col("t0"))
    b = b.withColumn("_hr", hr).filter((F.col("_hr") > 30) & (F.col("_hr") < 220))
    return (b.groupBy(*S, F.floor((F.col("t_ms") - F.col("t0")) / F.lit(bin_s * 1000.0)).alias("_k"))
            .agg(round_up(F.avg("_hr"), 1).alias("hr"))
            .select(*S, (F.col("_k") * bin_s + F.lit(bin_s / 2)).alias("t"), "hr"))


def rmssd_series(beats: DataFrame, starts: DataFrame) -> DataFrame:
    """Trailing 60 s variability every 15 s for sessions with more than 30 intervals: (session, t, rmssd)."""
    rr = beats.filter("rr_ms IS NOT NULL").join(starts, S).filter("t_ms >= t0")
    many = rr.groupBy(*S).agg(F.count("*").alias("_n")).filter("_n > 30").select(*S)
    rr = rr.join(many, S, "left_semi").withColumn("_t", F.col("t_ms") - F.col("t0"))
    w = beat_features(assign_windows(rr.select(*S, "_t", "rr_ms"), "_t"), [*S, "win_start"], ["_t"])
    w = complete_windows(w, rr, S, "_t")
    return (w.filter("rmssd IS NOT NULL")
            .select(*S, round_up((F.col("win_start") + 60000) / 1000.0).alias("t"), round_up(F.col("rmssd"), 1).alias("rmssd")))


def trailing_mean(series: DataFrame, key: list[str], t_ms: str, value: str, span_ms: int, name: str) -> DataFrame:
    """Mean over (t - span, t]. A key is cut into span-long chunks, each of which borrows the one before it."""
    lent = (series.withColumn("_own", F.floor(F.col(t_ms) / F.lit(float(span_ms))))
            .withColumn("_home", F.explode(F.array(F.col("_own"), F.col("_own") + 1))))
    w = Window.partitionBy(*key, "_home").orderBy(t_ms).rangeBetween(-(span_ms - 1), Window.currentRow)
    return lent.withColumn(name, F.avg(value).over(w)).filter("_own = _home").drop("_own", "_home")


def summary_numbers(series: DataFrame, phases: DataFrame) -> DataFrame:
    """Rest, challenge and end heart rate, the rise, and the recovery half-time, per session.

    `series` is the binned heart rate (one row per 5 s), so everything here is small per session.
    """
    p = phase_table(phases)
    sec = lambda c: (F.col(c) - F.col("t0")) / 1000.0
    s = series.join(p, S)
    t = F.col("t")
    within = lambda a, b: (t >= a) & (t < b)
    tenths = F.round(F.col("hr") * 10).cast("long")  # whole numbers: the mean does not depend on row order
    mean = lambda cond: F.floor(F.avg(F.when(cond, tenths)) + 0.5) / 10.0
    rest_from = F.greatest(sec("rest_start"), sec("rest_end") - 120)
    agg = s.groupBy(*S).agg(
        mean(within(rest_from, sec("rest_end"))).alias("rest_hr"),
        mean(within(sec("challenge_start"), sec("challenge_end"))).alias("challenge_hr"),
        mean(within(sec("recovery_end") - 60, sec("recovery_end"))).alias("recovery_end_hr"))
    agg = agg.withColumn("hr_rise", round_up(F.col("challenge_hr") - F.col("rest_hr"), 1))
    points = s.filter(within(sec("recovery_start") - 10, sec("recovery_end"))).withColumn("_ms", (t * 1000).cast("long"))
    rolled = trailing_mean(points, S, "_ms", "hr", 15_000, "_roll").join(agg, S)
    hit = ((F.col("hr_rise") >= 3) & (t >= sec("recovery_start"))
           & (F.col("_roll") <= F.col("rest_hr") + F.col("hr_rise") / 2))
    half = rolled.groupBy(*S).agg(round_up(F.min(F.when(hit, t - sec("recovery_start")))).alias("recovery_half_time_s"))
    return (p.select(*S).join(agg, S, "left").join(half, S, "left")
            .select(*S, "rest_hr", "challenge_hr", "hr_rise", "recovery_half_time_s", "recovery_end_hr"))


def rest_readings(beats: DataFrame, phases: DataFrame) -> DataFrame:
    """60 s readings from the rest phase without its first minute, for a baseline.

    Sessions with at least 30 intervals get variability windows; the others get heart-rate-only windows
    with at least 20 samples.
    """
    rest = phases.filter("phase = 'rest'").groupBy(*S).agg(
        (F.min("start_ms") + 60000).alias("_from"), F.min_by("end_ms", "start_ms").alias("_to"))
    b = beats.join(rest, S).filter((F.col("t_ms") >= F.col("_from")) & (F.col("t_ms") < F.col("_to")))
    many = b.groupBy(*S).agg(F.count("rr_ms").alias("_n")).filter("_n >= 30").select(*S)
    placed = assign_windows(b, "t_ms", origin=F.col("_from")).filter(F.col("win_start") + 60000 <= F.col("_to"))
    rr = placed.filter("rr_ms IS NOT NULL").join(many, S, "left_semi")
    beat = (beat_features(rr.select(*S, "win_start", "t_ms", "rr_ms"), [*S, "win_start"], ["t_ms"])
            .filter("hr_mean IS NOT NULL").select(*S, "win_start", "hr_mean", "rmssd", "sdnn"))
    only = (placed.join(many, S, "left_anti").groupBy(*S, "win_start")
            .agg(F.count("*").alias("_n"), F.avg(F.when(F.col("hr").between(30, 220), F.col("hr"))).alias("hr_mean"))
            .filter("_n >= 20").drop("_n"))
    return beat.unionByName(only, allowMissingColumns=True)


def smoothed_hr(beats: DataFrame, span_ms: int = 5000) -> DataFrame:
    """Trailing mean of the instantaneous heart rate at every beat (t - span, t], for charts."""
    chunk = F.floor(F.col("t_ms") / F.lit(float(span_ms)))
    lent = (beats.withColumn("_hr", instant_hr()).withColumn("_own", chunk)
            .withColumn("_home", F.explode(F.array(F.col("_own"), F.col("_own") + 1))))
    w = Window.partitionBy(*S, "_home").orderBy("t_ms").rangeBetween(-(span_ms - 1), Window.currentRow)
    return lent.withColumn("hr_smooth", F.avg("_hr").over(w)).filter("_own = _home").drop("_own", "_home", "_hr")


def recent_median_hr(beats: DataFrame, owner: list[str], last: int = 5, **ordered) -> DataFrame:
    """Heart rate from the upper median of the last `last` intervals."""
    from pulsegrid.functions.scalar import upper_middle

    o = Ordered(beats.filter("rr_ms IS NOT NULL"), owner, ["t_ms"], **ordered).around(last - 1, 0, lambda w: {
        "_near": F.collect_list(60000.0 / F.col("rr_ms")).over(w.rowsBetween(-(last - 1), 0))})
    return o.rows.withColumn("live_hr", upper_middle(F.col("_near"))).drop("_near")


def labelled_runs(runs: DataFrame, activity: str | None = None) -> DataFrame:
    """Completed runs at rest (0) and in the challenge (1)."""
    out = runs.filter(F.col("phase").isin("rest", "challenge") & F.col("completed"))
    if activity:
        out = out.filter(F.col("activity") == activity)
    return out.withColumn("y", F.when(F.col("phase") == "challenge", 1).otherwise(0))


def assemble_phases(steps: DataFrame, stops: DataFrame, **ordered) -> DataFrame:
    """Phases from a step log. steps: session, seq, phase, kind, start_ms; stops: session, stop_ms.

    A step ends where the next one starts; the last one ends at the stop. The steps of a phase stay rows of
    the log, found by (session, phase).
    """
    o = Ordered(steps, S, ["seq"], **ordered).around(0, 1, lambda w: {"_next": F.lead("start_ms").over(w)})
    s = o.rows.join(stops, S, "left").withColumn("end_ms", F.coalesce("_next", "stop_ms"))
    return s.groupBy(*S, "phase").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n_steps"),
        F.min_by("kind", "seq").alias("first_kind"))


def probe_changes(runs: DataFrame) -> DataFrame:
    """Relative change of the probe activity from rest to challenge, and the sentence for it.

    runs: session, phase, started_ms, activity, metrics. The first follow-dot or typing run of each phase
    counts; both must be the same activity.
    """
    from pulsegrid.operators.activities import headline_table

    probe = runs.filter(F.col("activity").isin("follow-dot", "typing"))
    row = F.struct("activity", "metrics")
    both = probe.groupBy(*S).agg(
        F.min_by(F.when(F.col("phase") == "rest", row), F.when(F.col("phase") == "rest", F.col("started_ms"))).alias("a"),
        F.min_by(F.when(F.col("phase") == "challenge", row), F.when(F.col("phase") == "challenge", F.col("started_ms"))).alias("b"))
    same = both.filter(F.col("a.activity") == F.col("b.activity")).withColumn("activity", F.col("a.activity"))
    h = F.broadcast(headline_table(runs.sparkSession))  # 27 fixed rows
    x, y = F.expr("try_element_at(a.metrics, key)"), F.expr("try_element_at(b.metrics, key)")
    diffs = same.join(h, "activity").withColumn("rel", F.try_divide(y - x, F.abs(x)))
    big = F.when(F.abs("rel") >= 0.1, F.struct(
        (-F.abs("rel")).alias("o"), F.col("rank").alias("r"),
        F.concat(F.lower("label"), F.lit(" "), round_up(F.abs("rel") * 100).cast("int").cast("string"),
                 F.when(F.col("rel") > 0, "% higher").otherwise("% lower")).alias("w")))
    what = F.when(F.col("activity") == "typing", "typing").otherwise("tracking")
    g = diffs.groupBy(*S, "activity").agg(F.array_sort(F.collect_list(big)).alias("_big"))
    parts = F.array_join(F.transform(F.slice("_big", 1, 2), lambda b: b["w"]), ", ")
    text = (F.when(F.size("_big") == 0, F.concat(F.lit("Your "), what, F.lit(" was about the same under challenge as at rest.")))
            .otherwise(F.concat(F.lit("Under challenge, your "), what, F.lit(" changed: "), parts, F.lit(" than at rest."))))
    return g.select(*S, text.alias("probe_text"))


def summary_text(numbers: DataFrame, probes: DataFrame, info: DataFrame) -> DataFrame:
    """Plain sentences for a session. info: session, device (NULL = none), aborted, last_phase."""
    whole = lambda c: round_up(c).cast("int").cast("string")
    d = info.join(numbers, S, "left").join(probes, S, "left")
    rise, rest, ch = F.col("hr_rise"), F.col("rest_hr"), F.col("challenge_hr")
    measured = rise.isNotNull()
    head = (F.when(~measured & F.col("device").isNull(), "No heart-rate device was connected, so only the activities were measured.")
            .when(~measured, F.concat(F.lit("Too few beats came through from "), F.col("device"), F.lit(" to compare the phases.")))
            .when(rise >= 3, F.concat(F.lit("Your heart rate rose "), whole(rise), F.lit(" bpm during the challenge, from "),
                                      whole(rest), F.lit(" at rest to "), whole(ch), F.lit(".")))
            .when(rise <= -3, F.concat(F.lit("Your heart rate was "), whole(-rise), F.lit(" bpm lower during the challenge than at rest ("),
                                       whole(ch), F.lit(" against "), whole(rest), F.lit(").")))
            .otherwise(F.concat(F.lit("Your heart rate barely changed during the challenge ("), whole(rest), F.lit(" at rest, "),
                                whole(ch), F.lit(" during)."))))
    end = F.col("recovery_end_hr")
    back = (F.when(measured & F.col("recovery_half_time_s").isNotNull(), F.concat(
        F.lit("It came halfway back down "), F.col("recovery_half_time_s").cast("int").cast("string"), F.lit(" seconds into paced breathing.")))
        .when(measured & (rise >= 3) & end.isNotNull(), F.concat(
            F.lit("By the end of paced breathing it was "), whole(end), F.lit(", "),
            F.when(end - rest > 3, "still above").otherwise("back near"), F.lit(" your resting level."))))
    stop = F.when(F.col("aborted"), F.concat(F.lit("You stopped during the "), F.coalesce(F.col("last_phase"), F.lit("session")),
                                             F.lit(". That is fine; the parts you did are kept.")))
    return d.select(*S, F.concat_ws(" ", head, back, F.col("probe_text"), stop).alias("summary"))


def clip_to_percentiles(df: DataFrame, key: list[str], value: str, low: float = 0.03, high: float = 0.97, **ordered) -> DataFrame:
    """Clip a series to its robust range (floor-index percentiles)."""
    from pulsegrid.operators.ordered import grouped_quantiles

    q = grouped_quantiles(df, key, value, {"_lo": ("lower", low), "_hi": ("lower", high)}, **ordered)
    return df.join(q, key).withColumn(f"{value}_shown", F.least(F.greatest(F.col(value), F.col("_lo")), F.col("_hi"))).drop("_lo", "_hi")


def personal_rows(runs: DataFrame) -> DataFrame:
    """Labelled runs with their activity's model features as an array, in the fixed order of the activity."""
    cond = F.lit(None).cast("array<double>")
    for activity, feats in K.PERSONAL_FEATURES.items():
        cells = F.array(*[F.expr(f"try_element_at(metrics, '{f}')") for f in feats])
        cond = F.when(F.col("activity") == activity, cells).otherwise(cond)
    return runs.withColumn("x", cond)
