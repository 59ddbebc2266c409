"""Apply signal models to calibrated features and fuse the signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid import constants as K
from pulsegrid.functions.scalar import LOGIT_LIMIT, clip, sigmoid, to_score


def has_signal(signal: str, prefix: str = "") -> Column:
    """All model features of the signal are present."""
    cond = F.lit(True)
    for f in K.SIGNAL_FEATURES[signal]:
        cond = cond & F.col(f"{prefix}{f}").isNotNull()
    return cond


def signal_logit(signal: str, *, coef: dict[str, float] = K.MODEL_COEF,
                 intercept: dict[str, float] = K.MODEL_INTERCEPT, prefix: str = "z_") -> Column:
    """Weighted sum of the z values; a missing z counts as 0. Coefficients fold into the projection."""
    total = F.lit(intercept[signal])
    for f in K.SIGNAL_FEATURES[signal]:
        total = total + F.lit(coef[f]) * F.coalesce(F.col(f"{prefix}{f}"), F.lit(0.0))
    return total


def contributions(signal: str, coef: dict[str, float] = K.MODEL_COEF, prefix: str = "z_") -> Column:
    """Array of (feature, z, coef, value) for one signal."""
    cells = []
    for f in K.SIGNAL_FEATURES[signal]:
        z = F.coalesce(F.col(f"{prefix}{f}"), F.lit(0.0))
        cells.append(F.struct(F.lit(f).alias("feature"), z.alias("z"), F.lit(coef[f]).alias("coef"),
                              (z * F.lit(coef[f])).alias("value")))
    return F.array(*cells)


def score_signals(df: DataFrame, eligible: dict[str, Column] | None = None, signals: list[str] = K.SIGNALS,
                  **model) -> DataFrame:
    """Add logit_, p_ and score_ columns per signal; NULL where the signal is not eligible.

    Without `eligible`, a signal needs all its z values.
    """
    for s in signals:
        ok = eligible[s] if eligible else has_signal(s, "z_")
        df = df.withColumn(f"logit_{s}", F.when(ok, signal_logit(s, **model)))
    return df.withColumns({
        **{f"p_{s}": sigmoid(F.col(f"logit_{s}")) for s in signals},
        **{f"score_{s}": to_score(sigmoid(F.col(f"logit_{s}"))) for s in signals}})


def fused_logit(logits: list[Column], include: list[Column] | None = None, *, empty: str = "null") -> Column:
    """Mean of the clipped logits that are present and included. With none: NULL, or 0 for empty='zero'."""
    if include:
        logits = [F.when(i, x) for x, i in zip(logits, include)]
    cut = [clip(x, -LOGIT_LIMIT, LOGIT_LIMIT) for x in logits]
    n = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in cut), F.lit(0))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cut), F.lit(0.0))
    mean = F.try_divide(total, n)
    return F.coalesce(mean, F.lit(0.0)) if empty == "zero" else mean


def fuse(df: DataFrame, signals: list[str] = K.SIGNALS, include: dict[str, Column] | None = None, *,
         empty: str = "null") -> DataFrame:
    """Add fused_logit, fused_p and fused."""
    logit = fused_logit([F.col(f"logit_{s}") for s in signals],
                        [include[s] for s in signals] if include else None, empty=empty)
    return (df.withColumn("fused_logit", logit).withColumn("fused_p", sigmoid(F.col("fused_logit")))
            .withColumn("fused", to_score(F.col("fused_p"))))


def hrv_trusted(source: str = "source", quality: str = "quality") -> Column:
    """Variability counts unless it came from a camera reading that was not good."""
    return has_signal("hrv") & ((F.col(source) != "camera") | (F.col(quality) == "good"))


def usable_signals(df: DataFrame, baseline: DataFrame | None = None, user: str = "user_id") -> DataFrame:
    """Per reading and signal: used or not, with a plain reason. `baseline` has user, n and n_<signal>,
    the number of its readings that carry the signal, plus n_readings."""
    if baseline is not None:
        df = df.join(baseline, user, "left")
    cells = []
    for s in K.SIGNALS:
        present = has_signal(s)
        if s in ("eda", "temp"):
            absent = F.lit("It needs a wearable that measures it, such as an Empatica E4.")
        elif s == "hr":
            absent = F.lit("Too few clean beats to read a heart rate.")
        else:
            absent = (F.when(F.col("source") == "manual", "Nothing was measured.")
                      .otherwise("Too few clean beats in a row to read it."))
        reason = F.when(~present, absent)
        if s == "hrv":
            reason = reason.when(~hrv_trusted(), F.concat(
                F.lit("Needs a good signal; the camera's was "), F.col("quality"),
                F.lit(". Heart rate still counts.")))
        if baseline is not None:
            carries = (F.col(f"n_{s}") > 0) & (F.col(f"n_{s}") >= F.least(F.lit(2), F.col("n_readings")))
            reason = reason.when(F.coalesce((F.col("n") >= K.BASELINE_DAYS) & ~carries, F.lit(False)),
                                 "Your baseline has no resting reading of it yet.")
        cells.append(F.struct(F.lit(s).alias("signal"), reason.isNull().alias("used"), reason.alias("reason")))
    out = df.withColumn("_s", F.explode(F.array(*cells)))
    return out.withColumn("signal", F.col("_s.signal")).withColumn("used", F.col("_s.used")).withColumn(
        "reason", F.col("_s.reason")).drop("_s")


def baseline_carries(readings: DataFrame, user: str) -> DataFrame:
    """How many resting readings of each user carry each signal."""
    return readings.groupBy(user).agg(
        F.count("*").alias("n_readings"),
        *[F.count(F.when(hrv_trusted() if s == "hrv" else has_signal(s), 1)).alias(f"n_{s}") for s in K.SIGNALS])


def score_readings(readings: DataFrame, stats: DataFrame, carries: DataFrame, user: str = "user_id") -> DataFrame:
    """Score readings against each user's ready baseline.

    `stats` comes from calibrate.baselines, `carries` from baseline_carries. No ready baseline: all scores
    NULL. Signals that may not be used stay NULL and do not enter the fused score.
    """
    feats = K.MODEL_FEATURES
    df = readings.join(stats, user, "left").join(carries, user, "left")
    ready = F.coalesce(F.col("n") >= K.BASELINE_DAYS, F.lit(False))
    trusted = hrv_trusted()
    z = {}
    for f in feats:
        value = F.when(trusted, F.col(f)) if f in K.SIGNAL_FEATURES["hrv"] else F.col(f)
        z[f"z_{f}"] = (value - F.col(f"mean_{f}")) / F.col(f"sd_{f}")
    eligible = {}
    for s in K.SIGNALS:
        carried = (F.col(f"n_{s}") > 0) & (F.col(f"n_{s}") >= F.least(F.lit(2), F.col("n_readings")))
        eligible[s] = ready & (trusted if s == "hrv" else has_signal(s)) & F.coalesce(carried, F.lit(False))
    out = fuse(score_signals(df.withColumns(z), eligible))
    return out.withColumn("has_baseline", ready).drop(
        *[f"{p}_{f}" for f in feats for p in ("mean", "sd")], "n_readings", *[f"n_{s}" for s in K.SIGNALS])


def override(df: DataFrame, values: DataFrame, key: list[str], features: list[str]) -> DataFrame:
    """What-if: replace chosen feature values where `values` (one row per key) gives one."""
    other = values.withColumnsRenamed({f: f"_o_{f}" for f in features})
    return (df.join(other, key, "left")
            .withColumns({f: F.coalesce(F.col(f"_o_{f}"), F.col(f)) for f in features})
            .drop(*[f"_o_{f}" for f in features]))


def leading_signal(fused: str = "fused_logit", signals: list[str] = K.SIGNALS) -> Column:
    """Signal pulling hardest in the direction of the fused score; ties keep display order."""
    direction = F.when(F.col(fused) < 0, -1.0).otherwise(1.0)
    cells = [F.struct((direction * F.col(f"logit_{s}")).alias("v"), F.lit(-i).alias("o"), F.lit(s).alias("s"))
             for i, s in enumerate(signals)]
    present = F.filter(F.array(*cells), lambda c: c["v"].isNotNull())
    return F.when(F.col(fused).isNotNull(), F.array_max(present)["s"])


def score_with_models(z_long: DataFrame, models: DataFrame, key: list[str]) -> DataFrame:
    """Score with models held in a table (signal, feature, coef, intercept): one join and one aggregate.

    Rows are dealt out by key alone. By feature all rows of one would meet in a task, and adding up before the exchange would hold nearly all
    groups of a file in one, for they have a few rows each. A number of parts that is not named would be merged again after the exchange.
    """
    parts = int(z_long.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = z_long.repartition(parts, *key).join(F.broadcast(models), "feature")
    return (joined.groupBy(*key, "signal")
            .agg((F.sum(F.col("coef") * F.coalesce(F.col("z"), F.lit(0.0))) + F.max("intercept")).alias("logit"))
            .withColumn("p", sigmoid(F.col("logit"))).withColumn("score", to_score(F.col("p"))))


def model_table(spark) -> DataFrame:
    """The published models as a table of nine rows."""
    rows = [(s, f, K.MODEL_COEF[f], K.MODEL_INTERCEPT[s]) for s in K.SIGNALS for f in K.SIGNAL_FEATURES[s]]
    return spark.createDataFrame(rows, "signal string, feature string, coef double, intercept double")


def parity(df: DataFrame, p: str, expected: str, by: list[str] = [], tolerance: float = 1e-6) -> DataFrame:
    """Largest difference from reference probabilities, per group."""
    return (df.groupBy(*by).agg(F.count("*").alias("n"), F.max(F.abs(F.col(p) - F.col(expected))).alias("max_diff"))
            .withColumn("ok", F.col("max_diff") < tolerance))


def baseline_taken_today(readings: DataFrame, now: Column, user: str = "user_id", started: str = "started_at") -> DataFrame:
    """Per user, whether one of the resting readings is from today."""
    return readings.groupBy(user).agg(F.max((F.to_date(started) == F.to_date(now)).cast("int")).cast("boolean").alias("today"))


def last_finished_window(t_s: Column, window_s: int = K.WINDOW_S, stride_s: int = K.STRIDE_S) -> Column:
    """Start of the newest window that has ended by `t_s`; NULL before the first one ends."""
    k = F.floor((t_s - window_s) / F.lit(float(stride_s)))
    return F.when(k >= 0, k * stride_s)


def recent(df: DataFrame, owner: list[str], t_ms: str, seconds: float) -> DataFrame:
    """Rows of the last seconds before each owner's newest row."""
    newest = df.groupBy(*owner).agg(F.max(t_ms).alias("_end"))
    return df.join(newest, owner).filter(F.col(t_ms) >= F.col("_end") - seconds * 1000).drop("_end")
