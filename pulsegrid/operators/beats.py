"""Beat intervals: times, cleaning and features (heart rate and variability)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid import constants as K
from pulsegrid.functions.scalar import middle, round_up
from pulsegrid.operators.ordered import Ordered, grouped_quantiles, sized, sized_together
from pulsegrid.operators.windows import assign_windows, complete_windows
from pulsegrid.session import checkpointed


def beat_times(df: DataFrame, owner: list[str], order: list[str], rr: str, t0: Column | None = None,
               name: str = "t_ms", **ordered) -> DataFrame:
    """End time of every interval: t0 plus the running sum."""
    rows = Ordered(df, owner, order, **ordered).running({name: ("sum", F.col(rr))}).rows
    return rows if t0 is None else rows.withColumn(name, F.col(name) + t0)


def in_range(rr: Column) -> Column:
    return F.coalesce(rr.between(K.RR_LOW_MS, K.RR_HIGH_MS) & ~F.isnan(rr.cast("double")), F.lit(False))


def clean_rr(df: DataFrame, key: list[str], order: list[str], rr: str = "rr_ms", *, relative: float = K.RR_MAX_DEVIATION, neighbours: int = K.RR_NEIGHBOURS, **ordered) -> DataFrame:
    """Flag intervals to keep (`kept`): in range, and within `relative` of the median of up to `neighbours`
    in-range intervals on each side. With fewer than two neighbours the interval is kept."""
    def look(w):
        near = F.concat(
            F.collect_list(rr).over(w.rowsBetween(-neighbours, -1)),
            F.collect_list(rr).over(w.rowsBetween(1, neighbours)))
        return {"_near": near}

    flagged = df.withColumn("_in", in_range(F.col(rr)))
    o = Ordered(flagged, [*key, "_in"], order, **ordered).around(neighbours, neighbours, look)
    ranked = o.rows.withColumn("_near", F.sort_array("_near")).withColumn("_med", middle(F.col("_near")))
    ok = (F.size("_near") < 2) | (F.abs(F.col(rr) - F.col("_med")) <= F.col("_med") * relative)
    return ranked.withColumn("kept", F.col("_in") & ok).drop("_near", "_med", "_in")


def successive(df: DataFrame, key: list[str], order: list[str], rr: str, **ordered) -> DataFrame:
    """`dd`: difference to the previous interval when both it and this one were kept."""
    o = Ordered(df, key, order, **ordered).around(1, 0, lambda w: {
        "dd": F.when(F.col("kept") & F.lag("kept").over(w), F.col(rr) - F.lag(rr).over(w))})
    return o.rows


def beat_features(df: DataFrame, key: list[str], order: list[str], rr: str = "rr_ms", *,
                  duration_s: float | None = K.WINDOW_S, bounded: bool = True, gated: bool = True,
                  fits: bool | None = None, **ordered) -> DataFrame:
    """Features of live or imported intervals per key.

    bounded=True is for keys that contain one window: an end time in milliseconds cannot repeat within an
    owner, so a 60 s window has at most 60 000 intervals. Whole-history keys use bounded=False, where order
    statistics come from value counts; `fits` tells whether every key is known to fit a block. `duration_s=None` takes the sum of the intervals as duration.
    """
    part = df.repartition(*[F.col(k) for k in key]) if bounded else df
    known = {} if fits is None else {"bounded": fits}
    step = {"bounded": True} if bounded else sized(df, key, growth=1, **known, **ordered)
    kept = clean_rr(part, key, order, rr, **step)
    pairs = successive(kept, key, order, rr, **step)
    clean = F.when(F.col("kept"), F.col(rr).cast("double"))
    aggs = [
        F.count("*").alias("n_beats"), F.count(clean).alias("n_clean"), F.avg(clean).alias("_mean"),
        F.stddev_samp(clean).alias("_sd"), F.count("dd").alias("_pairs"),
        F.avg(F.col("dd").cast("double") * F.col("dd")).alias("_msd"),
        (F.sum(F.when(~F.isnan(F.col(rr).cast("double")), F.col(rr))) / 1000.0).alias("_sum_s"),
    ]
    if bounded:
        agg = pairs.groupBy(*key).agg(*aggs, F.median(clean).alias("_median"))
    else:
        med = grouped_quantiles(pairs.withColumn("_c", clean), key, "_c", {"_median": ("linear", 0.5)}, **step)
        agg = pairs.groupBy(*key).agg(*aggs).join(med, key, "left") if key else pairs.agg(*aggs).crossJoin(med)
    if not gated:
        enough = F.col("n_clean") >= K.MIN_CLEAN_BEATS
        return agg.select(
            *key, F.when(enough, 60000.0 / F.col("_mean")).alias("hr_mean"),
            F.when(enough, F.sqrt("_msd")).alias("rmssd"), F.when(enough, F.col("_sd")).alias("sdnn"),
            F.when(enough, F.col("n_clean")).alias("n"),
            F.when(enough, F.col("n_beats") - F.col("n_clean")).alias("dropped"))
    seconds = F.col("_sum_s") if duration_s is None else F.lit(float(duration_s))
    expected = seconds * 1000 / F.col("_median")
    coverage = F.when(F.col("n_clean") < 3, F.lit(0.0)).otherwise(
        F.coalesce(F.least(F.try_divide(F.col("n_clean"), expected), F.lit(1.5)), F.lit(0.0)))
    out = agg.withColumn("coverage", coverage).withColumn(
        "hr_valid", F.col("coverage") >= K.HR_COVERAGE).withColumn(
        "hrv_valid", (F.col("coverage") >= K.HRV_COVERAGE) & (F.col("_pairs") >= K.HRV_PAIRS))
    return out.select(
        *key,
        F.when(F.col("hr_valid"), 60000.0 / F.col("_mean")).alias("hr_mean"),
        F.when(F.col("hrv_valid"), F.sqrt("_msd")).alias("rmssd"),
        F.when(F.col("hrv_valid"), F.col("_sd")).alias("sdnn"),
        "n_beats", "n_clean", "coverage",
        ((F.col("n_beats") - F.col("n_clean")) / F.col("n_beats")).alias("rejected"),
        "hr_valid", "hrv_valid")


def array_features(rows: Column, duration_s: float) -> Column:
    """hr_mean, rmssd, sdnn, n_beats, n_clean, coverage, rejected of one window that is an array of structs (t, v): the rules of
    `clean_rr` and `beat_features` for rows that are together already, as in the state of a stream."""
    k = K.RR_NEIGHBOURS
    placed = F.transform(F.array_sort(rows), lambda r, i: F.struct(i.alias("i"), r["v"].alias("v")))
    ranged = F.filter(placed, lambda r: in_range(r["v"]))

    def judged(all_: Column) -> Column:
        def one(r: Column, i: Column) -> Column:
            near = F.concat(F.slice(all_, F.greatest(i - k + 1, F.lit(1)), F.least(i, F.lit(k))), F.slice(all_, i + 2, F.lit(k)))
            med = middle(F.sort_array(F.transform(near, lambda x: x["v"])))
            return F.struct(r["i"].alias("i"), r["v"].alias("v"), ((F.size(near) < 2) | (F.abs(r["v"] - med) <= med * K.RR_MAX_DEVIATION)).alias("kept"))
        return F.filter(F.transform(all_, one), lambda r: r["kept"])

    def mean(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda s, v: s + v, lambda s: F.try_divide(s, F.size(values)))

    def told(clean: Column, n: Column) -> Column:
        values = F.transform(clean, lambda r: r["v"])
        steps = F.zip_with(F.slice(clean, F.lit(2), F.greatest(F.size(clean) - 1, F.lit(0))), F.slice(clean, F.lit(1), F.greatest(F.size(clean) - 1, F.lit(0))),
                           lambda b, a: F.when(b["i"] == a["i"] + 1, b["v"] - a["v"]))
        steps = F.filter(steps, lambda d: d.isNotNull())
        enough = F.size(clean) >= 3
        share = F.least(F.size(clean) / (F.lit(duration_s * 1000.0) / middle(F.sort_array(values))), F.lit(1.5))
        coverage = F.when(enough, share).otherwise(0.0)
        hrv = enough & (coverage >= K.HRV_COVERAGE) & (F.size(steps) >= K.HRV_PAIRS)
        m = mean(values)
        spread = F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, v: s + (v - m) * (v - m)) / (F.size(values) - 1))
        return F.struct(
            F.when(enough & (coverage >= K.HR_COVERAGE), 60000 / m).alias("hr_mean"), F.when(hrv, F.sqrt(mean(F.transform(steps, lambda d: d * d)))).alias("rmssd"),
            F.when(hrv, spread).alias("sdnn"), n.cast("long").alias("n_beats"), F.size(clean).cast("long").alias("n_clean"), coverage.alias("coverage"),
            F.when(n > 0, (n - F.size(clean)) / n).otherwise(0.0).alias("rejected"))

    # named once each: an array that is used in many places would be built again in each of them
    named = F.transform(F.array(ranged), judged)
    return F.get(F.transform(named, lambda clean: told(clean, F.size(rows))), 0)


def beat_quality(df: DataFrame) -> DataFrame:
    """good / fair / poor with a plain reason."""
    share = F.concat(round_up(F.col("rejected") * 100).cast("int").cast("string"),
                     F.lit("% of beats looked wrong and were left out"))
    few = F.col("n_clean") < 3
    good = (F.col("coverage") >= 0.9) & (F.col("rejected") <= 0.05)
    fair = (F.col("coverage") >= K.HRV_COVERAGE) & (F.col("rejected") <= 0.2)
    quality = F.when(few, "poor").when(good, "good").when(fair, "fair").otherwise("poor")
    why = (F.when(few, "Too few clean beats").when(good, F.lit(None))
           .when(fair, F.when(F.col("rejected") > 0.05, share).otherwise("Some beats were missed"))
           .when(F.col("coverage") < K.HRV_COVERAGE, "Many beats were missed").otherwise(share))
    return df.withColumn("quality", quality).withColumn("why", why)


def window_features(beats: DataFrame, owner: list[str], t: str = "t_ms", rr: str = "rr_ms", *,
                    window_s: int = K.WINDOW_S, stride_s: int = K.STRIDE_S, origin: Column | None = None) -> DataFrame:
    """Features of every window that lies inside an owner's recording."""
    placed = assign_windows(beats.select(*owner, t, rr), t, window_ms=window_s * 1000,
                            stride_ms=stride_s * 1000, origin=origin)
    feats = beat_features(placed, [*owner, "win_start"], [t], rr, duration_s=window_s)
    return complete_windows(feats, beats, owner, t, window_ms=window_s * 1000)


def resting_hr(windows: DataFrame, owner: list[str], hr: str = "hr_mean", **ordered) -> DataFrame:
    """Mean of the lowest quarter (at least one) of window heart rates, to 0.1."""
    ordered = sized(windows, owner, growth=1, **ordered)
    ok = windows.filter(F.col(hr).between(30, 220)).groupBy(*owner, hr).agg(F.count("*").alias("_n"))
    seen = Ordered(ok, owner, [hr], **ordered).running({"_upto": ("sum", F.col("_n"))}).rows
    total = ok.groupBy(*owner).agg(F.greatest(F.floor(F.sum("_n") / F.lit(4)), F.lit(1)).alias("_k"))
    taken = F.greatest(F.least(F.col("_upto"), F.col("_k")) - (F.col("_upto") - F.col("_n")), F.lit(0))
    return (seen.join(total, owner).groupBy(*owner)
            .agg(round_up(F.sum(F.col(hr) * taken) / F.max("_k"), 1).alias("resting_hr")))


def resting_hr_from_beats(beats: DataFrame, owner: list[str], t: str = "t_ms", rr: str = "rr_ms") -> DataFrame:
    """Resting heart rate from windows; owners without a usable window get the heart rate of their whole series."""
    step = sized(beats, owner, growth=1)
    found = checkpointed(resting_hr(window_features(beats, owner, t, rr), owner, **step))  # one row per owner
    rest = beats.join(found.select(*owner), owner, "left_anti")
    whole = beat_features(rest, owner, [t], rr, duration_s=None, bounded=False, fits=step["bounded"])
    return found.unionByName(whole.select(*owner, round_up(F.col("hr_mean"), 1).alias("resting_hr")))


# -- training rules (seconds) -------------------------------------------------------------------------

def clean_ibi(df: DataFrame, key: list[str], order: str, ibi: str) -> DataFrame:
    """Flag training intervals (seconds) to keep, one window per key (bounded by its length).

    Range first, then distance from the window's median, then neighbours that jump: of the two, the one
    farther from the median goes (the later one on a tie). An interval that went does not count as a neighbour.

    Where a jump makes the later one go, whether it is one depends on the interval before being there still. In a row of such
    intervals every second one is: the first goes, so the second has no neighbour and stays, and so on. All else is settled by the
    neighbours alone, so the rule is a place in a row of intervals and no fold.
    """
    w = Window.partitionBy(*key)
    line = w.orderBy(order)
    x = F.col(ibi)
    ranged = x.between(K.IBI_LOW_S, K.IBI_HIGH_S)
    part = df.repartition(*[F.col(k) for k in key]).withColumns({
        "_med": F.median(F.when(ranged, x)).over(w), "_enough": F.count(F.when(ranged, 1)).over(w) >= 3})
    part = part.withColumn("_dev", F.abs(x - F.col("_med"))).withColumn(
        "_near", F.coalesce(ranged & (~F.col("_enough") | (F.col("_dev") <= F.col("_med") * K.IBI_MAX_FROM_MEDIAN)), F.lit(False)))
    before = F.lag(ibi).over(line)
    jump = F.col("_enough") & F.col("_near") & F.lag("_near", 1, False).over(line) & (F.abs(x - before) > before * K.IBI_MAX_CHANGE)
    later = F.col("_dev") >= F.lag("_dev").over(line)
    part = part.withColumns({"_i": F.row_number().over(line), "_later": F.coalesce(jump & later, F.lit(False)), "_earlier": F.coalesce(jump & ~later, F.lit(False))})
    place = F.col("_i") - F.max(F.when(~F.col("_later"), F.col("_i"))).over(line)      # in a row of later ones, from 1; 0 outside
    kept = F.col("_near") & (place % 2 == 0) & ~F.lead("_earlier", 1, False).over(line)
    return part.select(*key, order, ibi, kept.alias("kept"))


def training_features(df: DataFrame, key: list[str], order: str, ibi: str = "ibi_s",
                      window_s: float = K.WINDOW_S) -> DataFrame:
    """Features of training windows from their intervals in seconds."""
    kept = successive(clean_ibi(df, key, order, ibi), key, [order], ibi, bounded=True)
    clean = F.when(F.col("kept"), F.col(ibi))
    agg = kept.groupBy(*key).agg(
        F.count(clean).alias("_n"), F.avg(clean).alias("_mean"), F.stddev_samp(clean).alias("_sd"),
        F.median(clean).alias("_median"), F.count("dd").alias("_pairs"), F.avg(F.col("dd") * F.col("dd")).alias("_msd"),
        F.avg((F.abs("dd") > 0.05).cast("double")).alias("_big"))
    agg = agg.withColumn("beat_coverage", F.when(
        F.col("_n") >= 3, F.col("_n") * F.col("_median") / F.lit(float(window_s))).otherwise(0.0))
    hr_ok = F.col("beat_coverage") >= K.HR_COVERAGE
    hrv_ok = (F.col("beat_coverage") >= K.HRV_COVERAGE) & (F.col("_pairs") >= K.HRV_PAIRS)
    return agg.select(
        *key, F.when(hr_ok, 60.0 / F.col("_mean")).alias("hr_mean"),
        F.when(hrv_ok, F.sqrt("_msd") * 1000).alias("rmssd"), F.when(hrv_ok, F.col("_sd") * 1000).alias("sdnn"),
        F.when(hrv_ok, F.col("_big") * 100).alias("pnn50"),
        F.when(F.col("_n") >= 3, F.col("_n")).otherwise(0).alias("n_beats"), "beat_coverage",
        hr_ok.alias("hr_valid"), hrv_ok.alias("hrv_valid"))


def rolling_rr_hr(df: DataFrame, owner: list[str], t: str, rr: str, *, span_ms: int = 10_000,
                  least: int = 5) -> DataFrame:
    """Heart rate from the mean of the intervals of the last `span_ms`, if there are enough.

    The trailing frame of one row never reaches further than the span, so owners are cut into span-long
    chunks and each chunk borrows the chunk before it.
    """
    chunk = F.floor(F.col(t) / F.lit(float(span_ms)))
    lent = (df.withColumn("_own", chunk)
            .withColumn("_home", F.explode(F.array(F.col("_own"), F.col("_own") + 1))))
    w = (Window.partitionBy(*owner, "_home").orderBy(t)
         .rangeBetween(-(span_ms - 1), Window.currentRow))
    n = F.count(rr).over(w)
    return (lent.withColumn("device_hr", F.when(n >= least, 60000.0 / F.avg(rr).over(w)))
            .filter("_own = _home").drop("_own", "_home"))


def break_markers(beats: DataFrame, samples: DataFrame, owner: list[str], *, t: str = "t_ms", bad: str = "bad",
                  rr: str = "rr_ms", **ordered) -> DataFrame:
    """Drop intervals that span a bad sample: prefix sums of `bad`, compared at the two beats."""
    ordered = sized_together([samples, beats], owner, **ordered)
    both = (samples.select(*owner, F.col(t), F.lit(0).alias("_side"), F.col(bad).cast("int").alias("_bad"))
            .unionByName(beats.select(*owner, F.col(t), F.lit(1).alias("_side"), F.lit(0).alias("_bad"))))
    upto = Ordered(both, owner, [t, "_side"], **ordered).running({"_upto": ("sum", F.col("_bad"))}).rows
    at = upto.filter("_side = 1").drop("_bad", "_side")
    o = Ordered(at, owner, [t], **ordered).around(1, 0, lambda w: {
        "_pt": F.lag(t).over(w), "_pu": F.lag("_upto").over(w)})
    # a bad sample exactly at the earlier beat is inside the closed span
    at_beat = samples.filter(F.col(bad)).select(*owner, F.col(t).alias("_pt"), F.lit(1).alias("_at")).distinct()
    out = o.rows.join(at_beat, [*owner, "_pt"], "left").filter(F.col("_pt").isNotNull())
    spoiled = F.col("_upto") - F.col("_pu") + F.coalesce("_at", F.lit(0)) > 0
    return out.select(*owner, t, F.when(~spoiled, F.col(t) - F.col("_pt")).alias(rr))
