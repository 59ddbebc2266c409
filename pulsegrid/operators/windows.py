"""Time windows, count windows, labels per window, runs of windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.constants import KEPT_LABELS, MIN_LABEL_SHARE, STRIDE_S, WINDOW_S
from pulsegrid.operators.ordered import Ordered


def window_starts(t: Column, origin: Column, window: int, stride: int) -> Column:
    """Array of the starts (origin + k * stride, k >= 0) of the half-open windows that hold `t`."""
    offset = t - origin
    last = F.floor(offset / F.lit(float(stride)))
    first = F.greatest(F.floor((offset - window) / F.lit(float(stride))) + 1, F.lit(0))
    return F.when(last >= first, F.transform(F.sequence(first, last), lambda k: origin + k * stride))


def assign_windows(df: DataFrame, t: str, *, window_ms: int = WINDOW_S * 1000, stride_ms: int = STRIDE_S * 1000,
                   origin: Column | None = None, name: str = "win_start") -> DataFrame:
    """One row per (row, window it falls in): at most ceil(window / stride) copies, no join."""
    start = F.lit(0).cast("long") if origin is None else origin
    return df.withColumn(name, F.explode(window_starts(F.col(t), start, window_ms, stride_ms)))


def complete_windows(windows: DataFrame, rows: DataFrame, owner: list[str], t: str, *,
                     window_ms: int = WINDOW_S * 1000, name: str = "win_start") -> DataFrame:
    """Keep windows that end no later than the owner's last row. Runs on the aggregated side."""
    ends = rows.groupBy(*owner).agg(F.max(t).alias("_to"))
    return (windows.join(ends, owner)
            .filter(F.col(name) + window_ms <= F.col("_to")).drop("_to"))


def majority_label(df: DataFrame, key: list[str], label: str, *, min_share: float = MIN_LABEL_SHARE,
                   keep: tuple[int, ...] = KEPT_LABELS) -> DataFrame:
    """Most frequent label of each key (smallest label on a tie) and its share, if large enough."""
    counts = df.groupBy(*key, label).agg(F.count("*").alias("n"))
    best = counts.groupBy(*key).agg(
        F.max_by(label, F.struct(F.col("n"), -F.col(label))).alias("label"),
        (F.max("n") / F.sum("n").cast("double")).alias("label_frac"))
    return best.filter((F.col("label_frac") >= min_share) & F.col("label").isin(*keep))


def label_at_rate(samples: DataFrame, labels: DataFrame, owner: list[str], *, idx: str, fs: float, label_fs: float,
                  label_idx: str, label: str) -> DataFrame:
    """Label of the source sample nearest to the centre of each sample: an equi-join on the index."""
    last = labels.groupBy(*owner).agg(F.max(label_idx).alias("_last"))
    src = F.floor((F.col(idx) + 0.5) / F.lit(float(fs)) * F.lit(float(label_fs)))
    placed = samples.join(last, owner).withColumn(label_idx, F.least(src, F.col("_last"))).drop("_last")
    return placed.join(labels.select(*owner, label_idx, label), [*owner, label_idx], "left")


def label_over_span(labels: DataFrame, owner: list[str], *, idx: str, fs: float, label_fs: float,
                    label: str) -> DataFrame:
    """Majority label over the source span of each target sample, by computed bucket.

    Spans start at the rounded position (half to even) of each target sample in the source.
    """
    width = F.lit(float(label_fs) / float(fs))
    guess = F.floor((F.col(idx) + 0.5) / width)
    bucket = guess - F.when(F.rint(guess * width) > F.col(idx), 1).otherwise(0)
    return majority_label(labels.withColumn("target_idx", bucket), [*owner, "target_idx"], label,
                          min_share=0.0, keep=(0, 1, 2, 3, 4, 5, 6, 7))


def count_windows(df: DataFrame, owner: list[str], order: list[str], *, size: int, step: int, **ordered) -> DataFrame:
    """Windows of `size` consecutive rows every `step` rows; the window starting at n - size is left out.

    Adds `win` (window number) and `pos` (0-based row position). Group by owner and `win` afterwards.
    """
    rows = Ordered(df, owner, order, **ordered).number("_pos").rows.withColumn("pos", F.col("_pos") - 1).drop("_pos")
    sizes = df.groupBy(*owner).agg(F.count("*").alias("_n"))
    first = F.greatest(F.floor((F.col("pos") - size) / F.lit(float(step))) + 1, F.lit(0))
    last = F.floor(F.col("pos") / F.lit(float(step)))
    return (rows.join(sizes, owner)
            .withColumn("win", F.explode(F.when(last >= first, F.sequence(first, last))))
            .filter(F.col("win") * step < F.col("_n") - size).drop("_n"))


def runs_of_rows(df: DataFrame, owner: list[str], t: str, *, step: int, **ordered) -> DataFrame:
    """Contiguous runs: a gap larger than `step` starts a new run (start, end, n per run)."""
    o = Ordered(df, owner, [t], **ordered).around(1, 0, lambda w: {"_prev": F.lag(t).over(w)})
    o = o.transform(lambda d: d.withColumn(
        "_new", F.when(F.col("_prev").isNull() | (F.col(t) - F.col("_prev") > step), 1).otherwise(0)))
    o = o.running({"run": ("sum", F.col("_new"))})
    return o.rows.groupBy(*owner, "run").agg(
        F.min(t).alias("run_start"), F.max(t).alias("run_end"), F.count("*").alias("n"))


def standardise(df: DataFrame, owner: list[str], columns: list[str]) -> DataFrame:
    """Per-owner z with the population SD: two small aggregates joined back, not a window over the owner."""
    stats = df.groupBy(*owner).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    return (df.join(stats, owner)
            .withColumns({f"z_{c}": F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")) for c in columns})
            .drop(*[f"_m_{c}" for c in columns], *[f"_s_{c}" for c in columns]))
