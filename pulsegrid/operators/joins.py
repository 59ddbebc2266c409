"""As-of, interpolating and interval joins without nested loops or cross joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.ordered import Ordered, sized_together


def _merged(left: DataFrame, right: DataFrame, by: list[str], t: str, right_t: str, values: list[str],
            left_id: str) -> DataFrame:
    """Both sides in one table; `_side` 0 is right. Right rows keep `values` in a struct."""
    cell = F.struct(F.col(right_t).alias("t"), F.col("_tie").alias("tie"), *[F.col(v) for v in values])
    r = right.select(*by, F.col(right_t).alias("_t"), F.lit(0).alias("_side"), F.col("_tie"),
                     cell.alias("_r"))
    le = left.select(*by, F.col(t).alias("_t"), F.lit(1).alias("_side"), F.col(left_id).alias("_tie"))
    return r.unionByName(le, allowMissingColumns=True)


def asof_nearest(left: DataFrame, right: DataFrame, by: list[str], *, t: str, left_id: str, right_t: str,
                 right_id: str, values: list[str], tolerance: float | None = None, **ordered) -> DataFrame:
    """For every left row the right row nearest in time (earlier one on a tie), with the signed gap.

    Both sides are merged and ordered by time; the nearest row is the last one at or before, or the first
    one after. `left_id` and `right_id` are unique within an owner. Left rows with no right row keep NULLs.
    With `tolerance` only gaps strictly below it match.
    """
    both = _merged(left, right.withColumn("_tie", F.col(right_id)), by, t, right_t, values, left_id)
    o = Ordered(both, by, ["_t", "_side", "_tie"], **ordered)
    o = o.running({"_before": ("last", F.col("_r"))}).running({"_after": ("last", F.col("_r"))}, reverse=True)
    gap_b = F.col("_t") - F.col("_before.t")
    gap_a = F.col("_after.t") - F.col("_t")
    pick = F.when(F.col("_after").isNull() | (gap_b <= gap_a), F.col("_before")).otherwise(F.col("_after"))
    near = (o.rows.filter("_side = 1").withColumn("_m", pick)
            .select(*by, F.col("_tie").alias(left_id), F.col("_m.t").alias(right_t),
                    (F.col("_t") - F.col("_m.t")).alias("gap"), *[F.col(f"_m.{v}").alias(v) for v in values]))
    if tolerance is not None:
        hit = F.abs("gap") < tolerance
        near = near.withColumns({c: F.when(hit, F.col(c)) for c in [right_t, *values, "gap"]})
    return left.join(near, [*by, left_id], "left")


def earliest_of_time(right: DataFrame, by: list[str], t: str, order: str, values: list[str]) -> DataFrame:
    """One row per time: the first in `order`, so that ties in an as-of join keep the earliest row."""
    return right.groupBy(*by, t).agg(
        F.min(order).alias(order), *[F.min_by(v, order).alias(v) for v in values])


def interpolate_at(grid: DataFrame, samples: DataFrame, by: list[str], *, t: str, sample_t: str,
                   values: list[str], max_gap: float | None = 250, keep: list[str] = [], **ordered) -> DataFrame:
    """Linear value at every grid time from the previous and next sample; ends are held. `keep` names grid columns that stay.

    `valid` is true when the two samples lie within `max_gap`; at the last sample its own step counts. Grid and sample times are unique per owner.
    """
    ordered = sized_together([samples, grid], by, **ordered)
    cell = F.struct(F.col(sample_t).cast("double").alias("t"), F.col("_back").alias("back"),
                    *[F.col(v).cast("double").alias(v) for v in values])
    stepped = Ordered(samples, by, [sample_t], **ordered).around(
        1, 0, lambda w: {"_back": F.col(sample_t) - F.lag(sample_t).over(w)}).rows
    s = stepped.select(*by, F.col(sample_t).cast("double").alias("_t"), F.lit(0).alias("_side"), cell.alias("_s"))
    g = grid.select(*by, F.col(t).cast("double").alias("_t"), F.lit(1).alias("_side"), F.col(t).alias("_grid"), *keep)
    both = s.unionByName(g, allowMissingColumns=True)
    o = Ordered(both, by, ["_t", "_side"], **ordered)
    o = o.running({"_a": ("last", F.col("_s"))}).running({"_b": ("last", F.col("_s"))}, reverse=True)
    span = F.col("_b.t") - F.col("_a.t")
    u = F.try_divide(F.col("_t") - F.col("_a.t"), span)

    def value(v: str) -> Column:
        a, b = F.col(f"_a.{v}"), F.col(f"_b.{v}")
        return (F.when(F.col("_a").isNull(), b).when(F.col("_b").isNull() | (span == 0), a)
                .otherwise(a + (b - a) * u)).alias(v)

    cols = [*keep, F.col("_grid").alias(t), *[value(v) for v in values]]
    if max_gap is not None:
        cols.append(F.coalesce(F.coalesce(span, F.col("_a.back")) <= max_gap, F.lit(False)).alias("valid"))
    return o.rows.filter("_side = 1").select(*by, *cols)


def uniform_grid(samples: DataFrame, by: list[str], t: str, hz: float, name: str = "grid_t") -> DataFrame:
    """Times t0, t0 + 1000/hz, ... up to the owner's last sample; explode runs per owner row."""
    ends = samples.groupBy(*by).agg(F.min(t).cast("double").alias("_t0"), F.max(t).cast("double").alias("_t1"))
    n = F.floor((F.col("_t1") - F.col("_t0")) * F.lit(float(hz)) / 1000.0)
    # two explodes keep a very long owner from building one array of all its grid points
    step = 100_000
    blocks = ends.withColumn("_n", n).withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_n") / F.lit(float(step))))))
    lo = F.col("_b") * step
    return (blocks.repartition(*[F.col(k) for k in by], F.col("_b"))
            .withColumn("grid_idx", F.explode(F.sequence(lo, F.least(F.col("_n"), lo + (step - 1)))))
            .select(*by, "grid_idx", (F.col("_t0") + F.col("grid_idx") * 1000.0 / F.lit(float(hz))).alias(name)))


def in_interval(points: DataFrame, spans: DataFrame, by: list[str], *, t: str, start: str, end: str) -> DataFrame:
    """Points within half-open intervals of the same owner: equi-join on the owner plus a range test.

    For owners with a handful of intervals (the phases of a session).
    """
    return points.join(spans, by).filter((F.col(t) >= F.col(start)) & (F.col(t) < F.col(end)))


def bucketed_interval(points: DataFrame, spans: DataFrame, by: list[str], *, t: str, start: str, end: str,
                      bucket: float) -> DataFrame:
    """As `in_interval` for owners with many intervals: intervals are spread over time buckets of about
    their own length, so a point only meets intervals of its bucket."""
    b = F.lit(float(bucket))
    spread = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / b), F.floor(F.col(end) / b))))
    placed = points.withColumn("_b", F.floor(F.col(t) / b))
    return (placed.join(spread, [*by, "_b"])
            .filter((F.col(t) >= F.col(start)) & (F.col(t) < F.col(end))).drop("_b"))


def near_stats(ticks: DataFrame, samples: DataFrame, by: list[str], *, t: str, sample_t: str, value: str,
               span: float, **ordered) -> DataFrame:
    """Count and SD of the samples within +-span of every tick.

    Running counts, sums and squares of the samples are read at both ends of each tick's interval and
    subtracted, so no (tick, sample) pairs are made. Values are centred on the owner's mean first to keep the
    squares small.
    """
    ordered = sized_together([samples, ticks, ticks], by, **ordered)
    mean = samples.groupBy(*by).agg(F.avg(value).alias("_mean"))
    v = F.col(value) - F.col("_mean")
    s = samples.filter(F.col(value).isNotNull()).join(mean, by).select(
        *by, F.col(sample_t).cast("double").alias("_t"), F.lit(1).alias("_side"), v.alias("_v"))
    tick = ticks.select(*by, F.col(t).alias("_tick")).distinct()
    ends = tick.select(*by, "_tick", F.inline(F.array(
        F.struct((F.col("_tick") - span).cast("double").alias("_t"), F.lit(0).alias("_side")),
        F.struct((F.col("_tick") + span).cast("double").alias("_t"), F.lit(2).alias("_side")))))
    both = s.withColumn("_id", F.monotonically_increasing_id()).unionByName(
        ends.withColumn("_id", F.lit(0).cast("long")), allowMissingColumns=True)
    o = Ordered(both, by, ["_t", "_side", "_id"], **ordered).running({
        "_n": ("sum", F.when(F.col("_side") == 1, 1).otherwise(0)), "_s": ("sum", F.coalesce("_v", F.lit(0.0))),
        "_q": ("sum", F.coalesce(F.col("_v") * F.col("_v"), F.lit(0.0)))})
    at = lambda c: F.max(F.when(F.col("_side") == 2, F.col(c))) - F.max(F.when(F.col("_side") == 0, F.col(c)))
    d = o.rows.filter("_side <> 1").groupBy(*by, "_tick").agg(at("_n").alias("n_near"), at("_s").alias("_s"), at("_q").alias("_q"))
    var = (F.col("_q") - F.col("_s") * F.col("_s") / F.col("n_near")) / (F.col("n_near") - 1)
    return d.filter("n_near > 0").select(*by, F.col("_tick").alias(t), "n_near",
                                         F.when(F.col("n_near") > 1, F.sqrt(F.greatest(var, F.lit(0.0)))).alias("sd_near"))
