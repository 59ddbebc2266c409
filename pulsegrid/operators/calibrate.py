"""Calibration of features against a person's own rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.constants import REST_S, SD_FLOOR, WINDOW_S
from pulsegrid.functions.scalar import z_score


def reference_mask(df: DataFrame, owner: list[str], t: str, label: str, *, mode: str = "rest5",
                   rest_s: float = REST_S, window_s: float = WINDOW_S, unit: float = 1.0) -> DataFrame:
    """Add `is_ref`: which windows define the owner's calibration.

    none - no window; baseline - all windows with label 1; rest5 - those that end within the first
    `rest_s` seconds of the owner's label-1 windows. `unit` is the number of `t` units in a second.
    """
    base = F.col(label) == 1
    if mode == "none":
        return df.withColumn("is_ref", F.lit(False))
    if mode == "baseline":
        return df.withColumn("is_ref", base)
    if mode != "rest5":
        raise ValueError(mode)
    first = df.groupBy(*owner).agg(F.min(F.when(base, F.col(t))).alias("_t0"))
    inside = F.col(t) + window_s * unit <= F.col("_t0") + rest_s * unit + 1e-9
    return (df.join(first, owner, "left")
            .withColumn("is_ref", F.coalesce(base & inside, F.lit(False))).drop("_t0"))


def owner_stats(df: DataFrame, owner: list[str], features: list[str], ref: Column | None = None,
                floors: dict[str, float] = SD_FLOOR) -> DataFrame:
    """Mean and floored sample SD per owner over reference rows, one aggregate for all features.

    NULL mean and SD without reference values; the floor with one value.
    """
    pick = (lambda f: F.col(f)) if ref is None else (lambda f: F.when(ref, F.col(f)))
    aggs = []
    for f in features:
        sd = F.greatest(F.coalesce(F.stddev_samp(pick(f)), F.lit(0.0)), F.lit(floors.get(f, 0.0)))
        aggs += [F.avg(pick(f)).alias(f"mean_{f}"), F.when(F.count(pick(f)) > 0, sd).alias(f"sd_{f}")]
    return df.groupBy(*owner).agg(*aggs)


def stats_long(stats: DataFrame, owner: list[str], features: list[str]) -> DataFrame:
    """(owner, feature, mean, sd) rows."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"mean_{f}").alias("mean"),
                               F.col(f"sd_{f}").alias("sd")) for f in features])
    return stats.select(*owner, F.inline(cells))


def zscores(df: DataFrame, stats: DataFrame, owner: list[str], features: list[str]) -> DataFrame:
    """Add z_<feature>; NULL when the value or the calibration is missing."""
    out = df.join(stats, owner, "left").withColumns(
        {f"z_{f}": z_score(F.col(f), F.col(f"mean_{f}"), F.col(f"sd_{f}")) for f in features})
    return out.drop(*[f"{p}_{f}" for f in features for p in ("mean", "sd")])


def baselines(readings: DataFrame, user: str, features: list[str], *, count: str = "days",
              started: str = "started_at") -> DataFrame:
    """Baseline per user from resting readings; `n` is distinct days, or rows when count='windows'.

    Distinct days are counted after one row per (user, day), which keeps a heavy user off a single task.
    """
    stats = owner_stats(readings, [user], features)
    if count == "windows":
        n = readings.groupBy(user).agg(F.count("*").alias("n"))
    else:
        n = (readings.groupBy(user, F.to_date(started).alias("_d")).agg(F.lit(1).alias("_x"))
             .groupBy(user).agg(F.count("*").alias("n")))
    return stats.join(n, user)


def resting_values(readings: DataFrame, stats: DataFrame, user: str, features: list[str]) -> DataFrame:
    """Resting value per feature: the calibrated mean for beat features, else the plain mean."""
    plain = readings.groupBy(user).agg(*[F.avg(f).alias(f"_p_{f}") for f in features])
    beat = {"hr_mean", "rmssd", "sdnn"}
    return plain.join(stats, user, "left").select(user, *[
        F.when(F.col(f"_p_{f}").isNotNull(), F.col(f"mean_{f}") if f in beat else F.col(f"_p_{f}"))
        .alias(f"rest_{f}") for f in features])


def typical_constants(df: DataFrame, owner: list[str], condition: str, features: list[str], ref: Column) -> DataFrame:
    """Per feature: median over owners of rest mean and SD, and of (condition median - rest mean).

    The inner median is per owner and condition, the outer one over owners; both use exact quantiles
    from value counts. Owners with fewer than two rows do not count.
    """
    from pulsegrid.operators.ordered import grouped_quantiles

    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    long = (df.withColumn("_ref", ref).select(*owner, condition, "_ref", F.inline(cells))
            .filter(F.col("value").isNotNull()))
    rest = (long.filter("_ref").groupBy(*owner, "feature")
            .agg(F.avg("value").alias("rest_mean"), F.stddev_samp("value").alias("rest_sd"), F.count("*").alias("n"))
            .filter("n >= 2").drop("n"))
    med = grouped_quantiles(long, [*owner, condition, "feature"], "value", {"med": ("linear", 0.5)})
    sizes = long.groupBy(*owner, condition, "feature").agg(F.count("*").alias("n")).filter("n >= 2").drop("n")
    shift = (med.join(sizes, [*owner, condition, "feature"], "left_semi").join(rest, [*owner, "feature"])
             .withColumn("shift", F.col("med") - F.col("rest_mean")))
    r_mean = grouped_quantiles(rest, ["feature"], "rest_mean", {"mean": ("linear", 0.5)})
    r_sd = grouped_quantiles(rest, ["feature"], "rest_sd", {"sd": ("linear", 0.5)})
    s = grouped_quantiles(shift, ["feature", condition], "shift", {"shift": ("linear", 0.5)})
    return s.join(r_mean, "feature").join(r_sd, "feature")
