"""The older per-signal scoring rules: typing and mouse windows, oxygen windows, count-window features, the
tanh score, and the face rule with its hysteresis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.scalar import round_up, tanh_score  # noqa: F401
from pulsegrid.operators.joins import asof_nearest, earliest_of_time
from pulsegrid.operators.ordered import Ordered, grouped_quantiles, sized, sized_together
from pulsegrid.operators.windows import count_windows


def typing_mouse_windows(keys: DataFrame, moves: DataFrame, labels: DataFrame, owner: list[str], window_ms: int = 300_000,
                         **ordered) -> DataFrame:
    """Fixed windows from the later of the two first events to the earlier of the two last ones.

    keys: owner, seq, press_ms, release_ms; moves: owner, t_ms, speed; labels: owner, label_id, label_ms, stress.
    A window needs two presses and two moves; its label is the one nearest to its start. The window that would
    start at the last edge is left out.
    """
    ordered = sized_together([keys, labels], owner, **ordered)
    k = keys.groupBy(*owner).agg(F.min("press_ms").alias("_k0"), F.max("press_ms").alias("_k1"))
    m = moves.groupBy(*owner).agg(F.min("t_ms").alias("_m0"), F.max("t_ms").alias("_m1"))
    ends = (k.join(m, owner).withColumn("_t0", F.greatest("_k0", "_m0"))
            .withColumn("_last", F.floor((F.least("_k1", "_m1") - F.col("_t0")) / F.lit(float(window_ms))))
            .select(*owner, "_t0", "_last"))

    def placed(d: DataFrame, t: str) -> DataFrame:
        win = F.floor((F.col(t) - F.col("_t0")) / F.lit(float(window_ms)))
        return d.join(ends, owner).withColumn("win", win).filter((F.col("win") >= 0) & (F.col("win") < F.col("_last")))

    pk = placed(keys, "press_ms")
    gaps = Ordered(pk, [*owner, "win"], ["press_ms", "seq"], **ordered).around(
        1, 0, lambda w: {"_gap": (F.col("press_ms") - F.lag("press_ms").over(w)) / 1000.0}).rows
    ka = gaps.groupBy(*owner, "win").agg(
        F.count("*").alias("_nk"), F.avg("_gap").alias("avg_iki"), F.stddev_samp("_gap").alias("std_iki"),
        F.avg((F.col("release_ms") - F.col("press_ms")) / 1000.0).alias("avg_hold")).filter("_nk >= 2")
    ma = placed(moves, "t_ms").groupBy(*owner, "win").agg(
        F.count("*").alias("_nm"), F.avg("speed").alias("avg_speed"), F.stddev_samp("speed").alias("std_speed")).filter("_nm >= 2")
    w = ka.join(ma, [*owner, "win"]).join(ends, owner).withColumn("win_ms", F.col("_t0") + F.col("win") * window_ms)
    lab = earliest_of_time(labels, owner, "label_ms", "label_id", ["stress"])
    out = asof_nearest(w, lab, owner, t="win_ms", left_id="win", right_t="label_ms", right_id="label_id", values=["stress"], **ordered)
    return out.select(*owner, "win", "win_ms", "avg_iki", "std_iki", "avg_hold", "avg_speed", "std_speed", "stress")


def behaviour_score(features: DataFrame, z: Column, alpha: Column, beta: Column, scale: Column, center: float = 0.5) -> DataFrame:
    """Live behaviour score; 0 when there were fewer than two events."""
    return features.withColumn("score", F.when(F.col("n_events") < 2, 0.0).otherwise(tanh_score(z, alpha, beta, F.lit(center), scale)))


def oxygen_windows(values: DataFrame, owner: list[str], order: list[str], value: str, *, size: int = 60, step: int = 30,
                   threshold: float = 94, **ordered) -> DataFrame:
    """Mean, SD and share below the threshold of count windows; a window with a missing value is dropped."""
    w = count_windows(values, owner, order, size=size, step=step, **ordered)
    agg = w.groupBy(*owner, "win").agg(
        F.count(value).alias("_n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
        F.avg((F.col(value) < threshold).cast("double")).alias("dip_share")).filter(F.col("_n") == size).drop("_n")
    return agg.withColumn("label", (F.col("mean") < threshold).cast("int"))


def rmssd_windows(intervals: DataFrame, owner: list[str], order: list[str], ibi: str, at: str, *, size: int = 20, step: int = 5,
                  **ordered) -> DataFrame:
    """RMSSD of `size` consecutive intervals every `step`, and the position of the middle one (`center`)."""
    ordered = sized(intervals, owner, **ordered)
    d = Ordered(intervals, owner, order, **ordered).around(1, 0, lambda w: {"_d": F.col(ibi) - F.lag(ibi).over(w)}).rows
    w = count_windows(d, owner, order, size=size, step=step, **ordered)
    inside = F.when(F.col("pos") > F.col("win") * step, F.col("_d"))
    return w.groupBy(*owner, "win").agg(
        F.sqrt(F.avg(inside * inside)).alias("rmssd"), F.max(F.when(F.col("pos") == F.col("win") * step + size // 2, F.col(at))).alias("center"))


def window_label_rounded(df: DataFrame, key: list[str], y: str) -> DataFrame:
    """Majority label of a window as its mean rounded half to even."""
    return df.groupBy(*key).agg(F.bround(F.avg(F.col(y).cast("double"))).cast("int").alias("label"))


def tanh_scores(df: DataFrame, by: list[str], x: str, p: str, is_train: str, center: float = 0.5, **ordered) -> DataFrame:
    """Score rows as tanh(scale (alpha z + beta - center)).

    z is x standardised on the training rows, alpha and beta the least-squares line from z to the model's
    probability, and scale is 2 over the 95th percentile of the training rows' distance from the center.
    """
    tr = F.col(is_train)
    stats = df.groupBy(*by).agg(F.avg(F.when(tr, F.col(x))).alias("_m"), F.stddev_pop(F.when(tr, F.col(x))).alias("_s"))
    z = df.join(stats, by).withColumn("z", (F.col(x) - F.col("_m")) / F.col("_s")).drop("_m", "_s")
    line = z.filter(tr).groupBy(*by).agg(F.regr_slope(p, "z").alias("alpha"), F.regr_intercept(p, "z").alias("beta"))
    z = z.join(line, by).withColumn("logit", F.col("alpha") * F.col("z") + F.col("beta"))
    far = grouped_quantiles(z.filter(tr).withColumn("_a", F.abs(F.col("logit") - center)), by, "_a", {"_q": ("linear", 0.95)}, **ordered)
    return (z.join(far, by).withColumn("scale", F.lit(2.0) / F.col("_q"))
            .withColumn("score", F.tanh(F.col("scale") * (F.col("logit") - center))).drop("_q"))


def label_text(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Scored rows with the labels spelled out."""
    name = lambda c: F.when(F.col(c) == 1, "Stress").otherwise("Non-Stress")
    return df.withColumn("true_label", name(y)).withColumn("predicted_label", name(pred))


def blink_rate(frames: DataFrame, owner: list[str], t: str, closed: str, span_ms: int = 30_000, **ordered) -> DataFrame:
    """Blink onsets (crossing into closed) and the blinks per minute over the last 30 s.

    The number of onsets in (t - span, t] is a running count minus the running count at t - span, so no frame
    of a long recording is ever held together.
    """
    ordered = sized(frames, owner, **ordered)
    o = Ordered(frames, owner, [t], **ordered).around(1, 0, lambda w: {
        "blink": F.when(F.col(closed) & ~F.coalesce(F.lag(closed).over(w), F.lit(False)), 1).otherwise(0)})
    counted = o.running({"_c": ("sum", F.col("blink"))}).rows
    marks = counted.select(*owner, F.col(t).alias("_t"), F.lit(0).alias("_side"), F.col("_c").alias("_v"), F.lit(None).cast("long").alias("_at"))
    asks = counted.select(*owner, (F.col(t) - span_ms).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_v"), F.col(t).alias("_at"))
    seen = Ordered(marks.unionByName(asks), owner, ["_t", "_side"], **ordered).running({"_before": ("last", F.col("_v"))}).rows
    before = seen.filter("_side = 1").select(*owner, F.col("_at").alias(t), "_before")
    return (counted.join(before, [*owner, t]).withColumn("blink_rate", (F.col("_c") - F.coalesce("_before", F.lit(0))) * 2)
            .drop("_c", "_before"))


def face_scores(frames: DataFrame, baseline: DataFrame, owner: list[str], flagged: tuple[str, ...] = ("angry", "fear", "sad", "disgust")) -> DataFrame:
    """Rule score of face-geometry rows: eye drop, brow drop, blink rise and an emotion flag; stressed above 0.45."""
    b = baseline.select(*owner, F.col("eye").alias("_eye"), F.col("brow").alias("_brow"), F.col("blink").alias("_blink"))
    d = frames.join(b, owner)
    eye = (F.col("_eye") - F.col("eye_open")) / F.col("_eye")
    brow = (F.col("_brow") - F.col("brow_gap")) / F.col("_brow")
    rise = F.greatest(F.lit(0.0), (F.col("blink_rate") - F.col("_blink")) / F.col("_blink"))
    emotion = F.when(F.col("emotion").isin(*flagged), 1.0).otherwise(0.0)
    return (d.withColumn("stress_score", eye * 0.35 + brow * 0.35 + rise * 0.15 + emotion * 0.15)
            .withColumn("stressed", F.col("stress_score") > 0.45).drop("_eye", "_brow", "_blink"))


def hysteresis(df: DataFrame, owner: list[str], order: list[str], flag: str, high: int = 15, **ordered) -> DataFrame:
    """Counter up one when flagged, down one (not below 0) otherwise; STRESSED from `high`, CALM at 0, else hold.

    With S the running sum of the steps, the counter is S minus the lowest S so far (at most 0).
    """
    ordered = sized(df, owner, **ordered)
    o = Ordered(df, owner, order, **ordered).running({"_s": ("sum", F.when(F.col(flag), 1).otherwise(-1))})
    o = o.running({"_low": ("min", F.col("_s"))})
    o = o.transform(lambda d: d.withColumn("counter", F.col("_s") - F.least(F.lit(0), F.col("_low"))))
    o = o.transform(lambda d: d.withColumn("_state", F.when(F.col("counter") >= high, "STRESSED").when(F.col("counter") == 0, "CALM")))
    return o.running({"state": ("last", F.col("_state"))}).rows.drop("_s", "_low", "_state")


def held_hr(peaks: DataFrame, samples: DataFrame, owner: list[str], peak: str, idx: str, fs: float, **ordered) -> DataFrame:
    """Heart rate of each beat interval, interpolated to every sample (ends held)."""
    from pulsegrid.operators.joins import interpolate_at

    ordered = sized(peaks, owner, **ordered)
    hr = Ordered(peaks, owner, [peak], **ordered).around(1, 0, lambda w: {"hr": fs * 60.0 / (F.col(peak) - F.lag(peak).over(w))}).rows
    return interpolate_at(samples, hr.filter("hr IS NOT NULL"), owner, t=idx, sample_t=peak, values=["hr"], max_gap=None)
