"""Live beats, packets and change feeds as Structured Streaming jobs.

Watermarks take the place of the in-memory buffers: a delay is how long a late row may still count. Operators whose output
depends on what was emitted before (changes of quality, retry markers, held back beats) are in `replay`.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pulsegrid import constants as K
from pulsegrid.operators.beats import array_features
from pulsegrid.session import checkpointed
from pulsegrid.streaming.spans import features

# how long rows are kept for late arrivals, per kind of live data
RETENTION = {"beats": "20 minutes", "frames": "90 seconds", "acceleration": "5 minutes"}


# -- windows ------------------------------------------------------------------------------------------

def stream_windows(beats: DataFrame, owner: str = "owner", ts: str = "ts", rr: str = "rr_ms", *, watermark: str = RETENTION["beats"],
                   window_s: int = K.WINDOW_S, stride_s: int = K.STRIDE_S) -> DataFrame:
    """Sliding-window features of a beat stream. Order inside a window is restored before cleaning."""
    w = (beats.withWatermark(ts, watermark).groupBy(owner, F.window(ts, f"{window_s} seconds", f"{stride_s} seconds").alias("w"))
         .agg(F.collect_list(F.struct(F.unix_micros(ts).alias("t"), F.col(rr).cast("double").alias("v"))).alias("_rows")))
    return w.select(owner, F.col("w.start").alias("win_start"), F.col("w.end").alias("win_end"), array_features(F.col("_rows"), window_s).alias("f")).select(
        owner, "win_start", "win_end", "f.*")


def tumbling(rows: DataFrame, keys: list[str], ts: str, width: str, aggs: list[Column], *, watermark: str = RETENTION["beats"]) -> DataFrame:
    """Tumbling windows over a stream: minute means, 5 s bins, hourly counters."""
    return (rows.withWatermark(ts, watermark).groupBy(*keys, F.window(ts, width).alias("w")).agg(*aggs)
            .withColumn("win_start", F.col("w.start")).withColumn("win_end", F.col("w.end")).drop("w"))


def hr_bins(beats: DataFrame, owner: str, ts: str, rr: str, hr: str, width: str = "5 seconds", *,
            watermark: str = RETENTION["beats"]) -> DataFrame:
    v = F.when(F.col(rr) > 0, 60000.0 / F.col(rr)).otherwise(F.col(hr))
    ok = beats.withColumn("_v", v).filter((F.col("_v") > 30) & (F.col("_v") < 220))
    return tumbling(ok, [owner], ts, width, [F.avg("_v").alias("hr"), F.count("*").alias("n")], watermark=watermark)


def bounded_readings(beats: DataFrame, starts: DataFrame, owner: str = "owner", duration_s: int = 60, *, watermark: str = "2 minutes") -> DataFrame:
    """Beats that belong to a reading: within `duration_s` of its start event, by an interval join of two streams.

    starts: owner, start_ts; beats: owner, ts, rr_ms. `readings` makes one row per reading of this.
    """
    b = beats.withWatermark("ts", watermark).alias("b")
    s = starts.withWatermark("start_ts", watermark).alias("s")
    on = (F.col(f"b.{owner}") == F.col(f"s.{owner}")) & (F.col("b.ts") >= F.col("s.start_ts")) & (
        F.col("b.ts") < F.col("s.start_ts") + F.expr(f"INTERVAL {duration_s} SECONDS"))
    return b.join(s, on).select(F.col(f"s.{owner}").alias(owner), "s.start_ts", "b.ts", "b.rr_ms")


def readings(beats: DataFrame, starts: DataFrame, owner: str = "owner", duration_s: int = 60, *, watermark: str = "2 minutes") -> DataFrame:
    """One row of features per reading, once the watermark has passed its start and its beats.

    The beats of a reading lie in the block of time its start lies in or in the next one. So each pair of blocks is put together once, and
    its readings are spans over its beats; a beat is held twice, however many readings overlap.
    """
    b = beats.withWatermark("ts", watermark).select(F.col(owner), F.col("ts").alias("_ts"), F.col("rr_ms").cast("double").alias("_v"), F.lit(False).alias("_start"))
    s = starts.withWatermark("start_ts", watermark).select(F.col(owner), F.col("start_ts").alias("_ts"), F.lit(None).cast("double").alias("_v"), F.lit(True).alias("_start"))
    t = F.unix_micros("_ts").alias("t")
    pairs = (b.unionByName(s).filter(F.col(owner).isNotNull()).select(owner, "_ts", "_v", "_start", F.window("_ts", f"{2 * duration_s} seconds", f"{duration_s} seconds").alias("_w"))
             .filter(~F.col("_start") | (F.col("_ts") < F.col("_w.start") + F.expr(f"INTERVAL {duration_s} SECONDS"))))
    g = pairs.groupBy(owner, "_w").agg(F.collect_list(F.when(~F.col("_start"), F.struct(t, F.coalesce("_v", F.lit(math.nan)).alias("v")))).alias("_rows"),
                                       F.collect_list(F.when(F.col("_start"), t)).alias("_starts"))
    told = g.select(owner, reading_spans(duration_s)(F.transform("_rows", lambda r: r["t"]), F.transform("_rows", lambda r: r["v"]), "_starts").alias("f"))
    r = told.select(owner, F.inline(F.arrays_zip(*[F.col(f"f.{c}").alias(c) for c in ("at", *FEATURES)])))
    return r.select(owner, F.timestamp_micros("at").alias("start_ts"), *[F.when(~F.isnan(c), F.col(c)).alias(c) if c in FEATURES[:3] else F.col(c) for c in FEATURES])


FEATURES = ["hr_mean", "rmssd", "sdnn", "n_beats", "n_clean", "coverage", "rejected"]


def reading_spans(duration_s: int) -> Callable:
    """Features of the readings that begin at `starts`, one element each, from beats (t, rr) in any order. Readings without a beat have none."""
    @F.pandas_udf(f"at array<long>, {', '.join(f'{c} array<long>' if c.startswith('n_') else f'{c} array<double>' for c in FEATURES)}")
    def told(t: pd.Series, rr: pd.Series, starts: pd.Series) -> pd.DataFrame:
        out = []
        for at, v, s in zip(t, rr, starts):
            begun, times = np.unique(np.asarray(s, np.int64), return_counts=True)       # a start that comes twice has its beats twice
            at, v = np.asarray(at, np.int64), np.asarray(v, float)
            order = np.lexsort((v, at))
            at, v = at[order], v[order]
            lo, hi = np.searchsorted(at, begun), np.searchsorted(at, begun + duration_s * 1_000_000)
            has = hi > lo
            f = features(v, lo[has], hi[has], times[has], duration_s)
            out.append((begun[has], *[f[c] for c in FEATURES]))
        return pd.DataFrame(out, columns=["at", *FEATURES])
    return told


# -- keyed state --------------------------------------------------------------------------------------

def _rows(batches: Iterator[pd.DataFrame], order: str) -> pd.DataFrame:
    frames = list(batches)
    return pd.concat(frames).sort_values(order, kind="stable") if frames else pd.DataFrame()


# display trace: seconds over which the level and the smoothed wave forget, the longest gap that counts, the gap of a first
# frame, and the step that starts anew (fixed values)
LEVEL_S, WAVE_S, GAP_S, FIRST_S, RESTART = 1.2, 0.07, 0.2, 1 / 30, 25
TRACE_STATE = "level double, wave double, last double"


def follow(state: tuple | None, t: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Wave of every frame after `state` = (level, wave, last), and the state after the last frame.

    Level and wave decay towards their targets by the time since the frame before. Only where the signal leaves the level
    by more than `RESTART` does the past end.
    """
    level, wave, last = state or (math.nan, 0.0, math.nan)
    gaps = np.minimum(np.diff(t, prepend=last) / 1000, GAP_S)
    gaps[~np.isfinite(gaps)] = FIRST_S
    keep_level, keep_wave = np.exp(-gaps / LEVEL_S).tolist(), np.exp(-gaps / WAVE_S).tolist()
    out = []
    for x, a, b in zip((-r).tolist(), keep_level, keep_wave):
        if not abs(x - level) <= RESTART:
            level, wave = x, 0.0
        level = x - (x - level) * a
        target = x - level
        wave = target - (target - wave) * b
        out.append(wave)
    return np.array(out), (level, wave, float(t[-1]) if len(t) else last)


def live_trace(frames: DataFrame, key: str = "reading") -> DataFrame:
    """Display trace of a frame stream (reading, t_ms, r)."""
    def step(k, batches, state):
        rows = _rows(batches, "t_ms")
        t = rows["t_ms"].to_numpy(float)
        v, after = follow(tuple(state.get) if state.exists else None, t, rows["r"].to_numpy(float))
        state.update(after)
        yield pd.DataFrame({key: [k[0]] * len(t), "t_ms": t, "v": v})

    key_type = frames.schema[key].dataType.simpleString()
    return frames.groupBy(key).applyInPandasWithState(step, f"{key} {key_type}, t_ms double, v double", TRACE_STATE,
                                                      "append", GroupStateTimeout.NoTimeout)


def trace(frames: DataFrame, key: str = "reading", chunk_ms: int = 60_000) -> DataFrame:
    """The same trace over stored frames, equal for every length and chunk size.

    A reading is cut into chunks of `chunk_ms`. First every chunk is followed from nothing; then, as long as some chunk's
    start differs from what its predecessor ended with, those chunks are followed again from there. The averages forget
    within seconds, so few rounds are needed, but the end does not depend on it.
    """
    kind = frames.schema[key].dataType.simpleString()
    start = frames.groupBy(key).agg(F.min("t_ms").alias("_t0"))
    d = checkpointed(frames.join(start, key).select(
        key, F.col("t_ms").cast("double").alias("t_ms"), F.col("r").cast("double").alias("r"), F.floor((F.col("t_ms") - F.col("_t0")) / F.lit(float(chunk_ms))).alias("_chunk")))
    before = Window.partitionBy(key).orderBy("_chunk")

    def run(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, tuple]:
        pdf = pdf.sort_values("t_ms", kind="stable")
        first = pdf[["level", "wave", "last"]].iloc[0]
        v, after = follow(None if pd.isna(first["last"]) else tuple(first), pdf["t_ms"].to_numpy(), pdf["r"].to_numpy())
        return pdf, v, after

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        _, _, after = run(pdf)
        return pd.DataFrame([[pdf[key].iloc[0], pdf["_chunk"].iloc[0], *after]], columns=[key, "_chunk", "level", "wave", "last"])

    def waves(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, v, _ = run(pdf)
        return pd.DataFrame({key: pdf[key], "t_ms": pdf["t_ms"], "v": v})

    none = [F.lit(None).cast("double").alias(c) for c in ("level", "wave", "last")]
    chunks = d.groupBy(key, "_chunk").agg(F.count("*").alias("_n"))
    used = checkpointed(chunks.select(key, "_chunk", *none))
    if not chunks.filter("_chunk > 0").isEmpty():
        todo, done = used, None
        while not todo.isEmpty():
            new = d.join(todo, [key, "_chunk"]).groupBy(key, "_chunk").applyInPandas(ends, f"{key} {kind}, _chunk long, {TRACE_STATE}")
            done = checkpointed(new if done is None else done.join(new, [key, "_chunk"], "left_anti").unionByName(new))
            ended = F.struct("level", "wave", "last")
            starts = done.select(key, "_chunk", F.lag(ended).over(before).alias("_s")).select(key, "_chunk", "_s.*")
            old = used.withColumnsRenamed({"level": "_a", "wave": "_b", "last": "_c"})
            todo = checkpointed(starts.join(old, [key, "_chunk"]).filter(
                ~(F.col("level").eqNullSafe(F.col("_a")) & F.col("wave").eqNullSafe(F.col("_b")) & F.col("last").eqNullSafe(F.col("_c")))
            ).select(key, "_chunk", "level", "wave", "last"))
            used = checkpointed(used.join(todo, [key, "_chunk"], "left_anti").unionByName(todo))
    return d.join(used, [key, "_chunk"]).groupBy(key, "_chunk").applyInPandas(waves, f"{key} {kind}, t_ms double, v double")


# -- batches ------------------------------------------------------------------------------------------

def score_batches(rows: DataFrame, score: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str,
                  owner: str = "owner", signal: str = "signal", ts: str = "ts", every: str | None = "15 seconds") -> StreamingQuery:
    """Every trigger: the newest row of each owner and signal is scored and handed to `sink`."""
    def run(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c not in (owner, signal)]
        newest = batch.groupBy(owner, signal).agg(F.max_by(F.struct(*rest), ts).alias("_r")).select(owner, signal, "_r.*")
        sink(score(newest), number)

    w = rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def ingest_files(spark: SparkSession, kind: str, path: str, schema: str, sink: str, checkpoint: str, options: dict[str, str] = {}) -> StreamingQuery:
    """Take new export files of a drop folder once: text, csv or json into a parquet table, exactly once per file."""
    r = spark.readStream.format(kind).options(**options)
    rows = (r if kind == "text" else r.schema(schema)).load(path).withColumn("file", F.col("_metadata.file_path"))
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", sink).trigger(availableNow=True).start()


def run_once(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything that is there now and read the result back as a table."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out").option(
        "checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
