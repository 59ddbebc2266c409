"""Signal-shape operators on uniform samples: filters, peaks, skin conductance, temperature, motion, beats.

Samples are first packed into short chunks, and a window is put together from a chunk and the ones after it,
so the shuffle moves every sample once. NumPy kernels then work on the windows of an Arrow batch together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid import constants as K
from pulsegrid.functions.scalar import norm
from pulsegrid.operators.ordered import Ordered
from pulsegrid.session import checkpointed


def moving_average(df: DataFrame, owner: list[str], order: str, value: str, *, half: int, mask: Column | None = None,
                   **ordered) -> DataFrame:
    """Centred average with shrinking edges (`trend`), value minus it (`high_pass`), rolling RMS, widened mask."""
    base = df.withColumn("_mask", F.coalesce(mask, F.lit(False)).cast("int")) if mask is not None else df.withColumn("_mask", F.lit(0))

    def look(w):
        c = w.rowsBetween(-half, half)
        return {"trend": F.avg(value).over(c), "high_pass": F.col(value) - F.avg(value).over(c),
                "rolling_rms": F.sqrt(F.avg(F.col(value) * F.col(value)).over(c)), "mask": F.max("_mask").over(c)}

    return Ordered(base, owner, [order], **ordered).around(half, half, look).rows.drop("_mask")


def local_maxima(df: DataFrame, owner: list[str], order: str, value: str, **ordered) -> DataFrame:
    """Rows above the row before and not below the row after."""
    o = Ordered(df, owner, [order], **ordered).around(1, 1, lambda w: {
        "is_peak": F.coalesce((F.col(value) > F.lag(value).over(w)) & (F.col(value) >= F.lead(value).over(w)), F.lit(False))})
    return o.rows


def window_arrays(samples: DataFrame, owner: list[str], idx: str, columns: list[str], *, fs: int, window_s: int = K.WINDOW_S,
                  stride_s: int = K.STRIDE_S, **ordered) -> DataFrame:
    """Arrays of every full window: (owner, win = index of its first sample, one array per column).

    `idx` counts samples from 0 and is unique per owner, so a chunk holds at most fs * stride samples.
    """
    size, per = fs * stride_s, window_s // stride_s
    if window_s % stride_s:
        raise ValueError("the stride must divide the window")
    cells = F.sort_array(F.collect_list(F.struct(F.col(idx).alias("_i"), *columns)))
    chunks = (samples.groupBy(*owner, F.floor(F.col(idx) / F.lit(float(size))).alias("_chunk"))
              .agg(cells.alias("_c")).filter(F.size("_c") == size))
    o = Ordered(chunks, owner, ["_chunk"], **ordered).around(0, per - 1, lambda w: {
        "_all": F.concat("_c", *[F.lead("_c", k).over(w) for k in range(1, per)]),
        "_far": F.lead("_chunk", per - 1).over(w) if per > 1 else F.col("_chunk")})
    full = o.rows.filter(F.col("_far") == F.col("_chunk") + (per - 1))
    return full.select(*owner, (F.col("_chunk") * size).alias("win"),
                       *[F.col(f"_all.{c}").cast("array<double>").alias(c) for c in columns])


def array_mean(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)


def slope_per_minute(x: Column, n: int, fs: float) -> Column:
    """Least-squares slope of n uniform samples per minute: a fixed weighted sum."""
    t = np.arange(n) / fs / 60.0
    t = t - t.mean()
    weights = F.array(*[F.lit(float(w)) for w in t / (t @ t)])
    return F.aggregate(F.zip_with(x, weights, lambda a, w: a * w), F.lit(0.0), lambda s, v: s + v)


def temp_features(df: DataFrame, column: str = "temp", *, n: int = 240, fs: float = 4) -> DataFrame:
    return df.withColumn("temp_mean", array_mean(F.col(column))).withColumn("temp_slope", slope_per_minute(F.col(column), n, fs))


def motion_features(samples: DataFrame, key: list[str], x: str = "ax", y: str = "ay", z: str = "az",
                    units_per_g: float = K.ACC_UNITS_PER_G) -> DataFrame:
    """Population SD of the acceleration magnitude per key, in g."""
    return samples.groupBy(*key).agg(F.stddev_pop(norm(F.col(x), F.col(y), F.col(z)) / units_per_g).alias("acc_std"))


# -- filters ------------------------------------------------------------------------------------------

def low_pass(fc: float, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """Second-order Butterworth low-pass (bilinear, pre-warped)."""
    return butterworth(2, None, fc, fs)[0]


def butterworth(order: int, low: float | None, high: float | None, fs: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Butterworth sections (b, a) for a low-pass (low is None), high-pass (high is None) or band-pass.

    Poles of the analogue prototype are moved to the band, mapped to z by the bilinear transform and taken in
    conjugate pairs.
    """
    k = np.arange(order)
    proto = np.exp(1j * np.pi * (2 * k + order + 1) / (2 * order))
    warp = lambda f: 2 * fs * np.tan(np.pi * f / fs)
    if low is None:
        poles, zeros = warp(high) * proto, [-1.0] * order
    elif high is None:
        poles, zeros = warp(low) / proto, [1.0] * order
    else:
        bw, w0 = warp(high) - warp(low), np.sqrt(warp(high) * warp(low))
        half = proto * bw / 2
        root = np.sqrt(half ** 2 - w0 ** 2 + 0j)
        poles, zeros = np.concatenate([half + root, half - root]), [1.0] * order + [-1.0] * order
    zp = (2 * fs + poles) / (2 * fs - poles)
    pairs = [p for p in zp if p.imag > 1e-12]
    real = sorted(p.real for p in zp if abs(p.imag) <= 1e-12)
    dens = [np.array([1.0, -2 * p.real, abs(p) ** 2]) for p in sorted(pairs, key=abs)]
    dens += [np.poly(real[i:i + 2]).real for i in range(0, len(real), 2)]
    zeros = sorted(zeros)
    nums = []
    for i in range(len(dens)):
        mine = [zeros[i], zeros[-1 - i]] if len(zeros) >= 2 * len(dens) else zeros[2 * i:2 * i + 2]
        nums.append(np.poly(mine).real)
    # unit gain at the reference frequency of the band
    ref = 0.0 if low is None else np.pi if high is None else 2 * np.arctan(np.sqrt(warp(high) * warp(low)) / (2 * fs))
    zr = np.exp(1j * ref)
    gain = 1.0
    for b, a in zip(nums, dens):
        gain *= abs(np.polyval(b, zr) / np.polyval(a, zr)) if len(b) == len(a) else abs(
            np.polyval(b, zr) / zr ** (len(b) - len(a)) / np.polyval(a, zr))
    nums[0] = nums[0] / gain
    return list(zip(nums, dens))


def _run(sections, x: np.ndarray, start: bool) -> np.ndarray:
    """Filter the rows of x (windows x time); `start` begins in the steady state of each row's first value."""
    scale = x[:, 0].copy()
    for b, a in sections:
        b, a = np.pad(b, (0, 3 - len(b))), np.pad(a, (0, 3 - len(a)))
        z1 = np.zeros(len(x))
        z2 = np.zeros(len(x))
        dc = b.sum() / a.sum()
        if start:
            z2 = (b[2] - a[2] * dc) * scale
            z1 = (b[1] - a[1] * dc) * scale + z2
            scale = scale * dc
        y = np.empty_like(x)
        for i in range(x.shape[1]):
            xi = x[:, i]
            yi = b[0] * xi + z1
            z1 = b[1] * xi - a[1] * yi + z2
            z2 = b[2] * xi - a[2] * yi
            y[:, i] = yi
        x = y
    return x


def zero_phase(sections, x: np.ndarray, pad: int | None = None, steady: bool = True) -> np.ndarray:
    """Forward and backward filtering with odd extension; default padding is three times the filter length."""
    if pad is None:
        pad = 3 * (2 * len(sections) + 1)
    pad = min(pad, x.shape[1] - 1)
    left = 2 * x[:, :1] - x[:, pad:0:-1]
    right = 2 * x[:, -1:] - x[:, -2:-pad - 2:-1]
    ext = np.concatenate([left, x, right], axis=1)
    fwd = _run(sections, ext, steady)[:, ::-1]
    back = _run(sections, np.ascontiguousarray(fwd), steady)[:, ::-1]
    return back[:, pad:pad + x.shape[1]]


# -- peaks --------------------------------------------------------------------------------------------

def find_peaks(x: np.ndarray, *, distance: float = 1, prominence: float | None = None, height: float | None = None
               ) -> tuple[np.ndarray, np.ndarray]:
    """Peak positions and prominences of one short signal.

    A plateau counts by its middle. Peaks closer than `distance` to a higher one go first (the later one wins
    among equals), then low prominences.
    """
    n = len(x)
    edge = np.flatnonzero(np.diff(x) != 0)
    if len(edge) < 2:
        return np.array([], dtype=int), np.array([])
    first = np.r_[0, edge + 1]           # starts of runs of equal values
    last = np.r_[edge, n - 1]
    v = x[first]
    up = np.r_[False, v[1:] > v[:-1]]
    down = np.r_[v[1:] < v[:-1], False]
    top = np.flatnonzero(up & down)
    peaks = (first[top] + last[top]) // 2
    if height is not None:
        peaks = peaks[x[peaks] >= height]
    gap = int(np.ceil(distance))
    if gap > 1 and len(peaks) > 1:
        alive = np.ones(len(peaks), bool)
        for j in np.lexsort((np.arange(len(peaks)), x[peaks]))[::-1]:
            if alive[j]:
                close = np.abs(peaks - peaks[j]) < gap
                close[j] = False
                alive &= ~close
        peaks = peaks[alive]
    prom = np.empty(len(peaks))
    for k, p in enumerate(peaks):
        higher = np.flatnonzero(x > x[p])
        cut = np.searchsorted(higher, p)
        lo = higher[cut - 1] + 1 if cut > 0 else 0
        hi = higher[cut] if cut < len(higher) else n
        prom[k] = x[p] - max(x[lo:p + 1].min(), x[p:hi].min())
    if prominence is not None:
        keep = prom >= prominence
        peaks, prom = peaks[keep], prom[keep]
    return peaks, prom


def _stack(s: pd.Series) -> np.ndarray:
    return np.array(s.to_list(), dtype=float)


def _by_length(s: pd.Series):
    """Rows of the same length together, so that they can be filtered as one matrix."""
    lengths = s.map(len)
    for n, idx in lengths.groupby(lengths).groups.items():
        yield n, list(idx)


SMOOTH = butterworth(2, None, 1.0, 4)
TONIC = butterworth(2, None, 0.05, 4)


def eda_kernel(x: np.ndarray, fs: float, window_s: float) -> pd.DataFrame:
    smooth = zero_phase(SMOOTH, x, pad=9)
    tonic = zero_phase(TONIC, smooth, pad=9)
    t = np.arange(x.shape[1]) / fs / 60
    t = t - t.mean()
    count, amp = np.zeros(len(x)), np.zeros(len(x))
    for i, row in enumerate(smooth - tonic):
        _, prom = find_peaks(row, distance=fs, prominence=K.SCR_MIN_US)
        count[i], amp[i] = len(prom) * 60.0 / window_s, prom.mean() if len(prom) else 0.0
    return pd.DataFrame({"eda_tonic": tonic.mean(axis=1), "eda_slope": tonic @ (t / (t @ t)), "scr_count": count, "scr_amp": amp})


def eda_features(df: DataFrame, column: str = "eda", *, fs: float = K.EDA_HZ, window_s: float | None = None) -> DataFrame:
    """Tonic level and slope, responses per minute and their mean size, from an array column."""
    names = ["eda_tonic", "eda_slope", "scr_count", "scr_amp"]

    @F.pandas_udf("eda_tonic double, eda_slope double, scr_count double, scr_amp double")
    def kernel(arrays: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame(np.nan, index=range(len(arrays)), columns=names)
        arrays = arrays.reset_index(drop=True)
        for n, idx in _by_length(arrays):
            if n > 9:
                out.loc[idx] = eda_kernel(_stack(arrays.iloc[idx]), fs, window_s or n / fs).to_numpy()
        return out

    return df.withColumn("_f", kernel(F.col(column))).select("*", *[F.nanvl(F.col(f"_f.{c}"), F.lit(None)).alias(c) for c in names]).drop("_f")


def tonic_weights(n: int = 240, fs: float = K.EDA_HZ) -> tuple[np.ndarray, np.ndarray]:
    """Weights that turn a window of n samples into its tonic mean and slope per minute: both filters are linear in
    the samples, so their effect on each unit sample gives the weights."""
    rows = zero_phase(TONIC, zero_phase(SMOOTH, np.eye(n), pad=9), pad=9)
    t = np.arange(n) / fs / 60
    t = t - t.mean()
    return rows.mean(axis=1), rows @ (t / (t @ t))


def tonic_features(df: DataFrame, column: str = "eda", *, n: int = 240, fs: float = K.EDA_HZ) -> DataFrame:
    """Tonic mean and slope of full windows as two weighted sums, without Python in the tasks."""
    def dot(w: np.ndarray) -> Column:
        weights = F.array(*[F.lit(float(x)) for x in w])
        return F.aggregate(F.zip_with(F.col(column), weights, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)

    mean, slope = tonic_weights(n, fs)
    return df.withColumn("eda_tonic", dot(mean)).withColumn("eda_slope", dot(slope))


# above these a figure counts as motion (fixed values)
MOTION_LIMITS = {"z": float(K.MOTION_Z), "wrist": K.MOTION_WRIST_G, "chest": K.MOTION_CHEST_G, "camera": K.MOTION_SHARE}
PULSE_BAND = butterworth(3, 0.7, 3.5, K.PULSE_HZ)


def upstroke_times(x: np.ndarray, fs: int) -> np.ndarray:
    """Beat times (samples) of one filtered pulse window: where the wave rises fastest in the quarter second up to every peak, between
    samples by a parabola through the slope there and on both sides."""
    low, high = np.quantile(x, [0.25, 0.75])
    if not high > low:
        return np.zeros(0)
    peaks = find_peaks(x, distance=int(K.IBI_LOW_S * fs), prominence=0.3 * (high - low))[0]
    slope = np.gradient(x)
    # one row per peak; what lies before the window is lower than any slope
    lead = int(0.25 * fs)
    rises = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(lead, -np.inf), slope]), lead + 1)[peaks]
    steepest = peaks - lead + rises.argmax(axis=1)
    return steepest + vertex(slope, steepest)


def vertex(y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Offset of the extremum of the parabola through y at `at` and its neighbours, at most half a sample; 0 at the ends and where
    the three lie on a line."""
    around = np.pad(y, 1, mode="edge")[at[:, None] + np.arange(3)]
    half_rise, bend = (around[:, 2] - around[:, 0]) / 2, around @ [1.0, -2.0, 1.0]
    usable = (bend != 0) & (at > 0) & (at < len(y) - 1)
    return np.where(usable, -half_rise / np.where(usable, bend, 1.0), 0.0).clip(-0.5, 0.5)


def pulse_beats(df: DataFrame, column: str = "bvp", fs: int = K.PULSE_HZ, name: str = "beat_s") -> DataFrame:
    """Beat times in seconds within each pulse window."""
    band = PULSE_BAND if fs == K.PULSE_HZ else butterworth(3, 0.7, 3.5, fs)

    @F.pandas_udf("array<double>")
    def kernel(arrays: pd.Series) -> pd.Series:
        arrays = arrays.reset_index(drop=True)
        out = pd.Series([[] for _ in range(len(arrays))])
        for n, idx in _by_length(arrays):
            if n > 21:
                for i, row in zip(idx, zero_phase(band, _stack(arrays.iloc[idx]))):
                    out[i] = [float(v) for v in upstroke_times(row, fs) / fs]
        return out

    return df.withColumn(name, kernel(F.col(column)))


def pulse_features(df: DataFrame, key: list[str], column: str = "bvp", fs: int = K.PULSE_HZ) -> DataFrame:
    """Heart rate and variability of pulse windows (a window with fewer than four beats has none)."""
    from pulsegrid.operators.beats import training_features

    beats = pulse_beats(df, column, fs).select(*key, "beat_s")
    t = F.col("beat_s")
    ibi = F.zip_with(F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0))), lambda a, b: a - b)
    rows = beats.filter(F.size("beat_s") >= 4).select(*key, F.posexplode(ibi).alias("_k", "ibi_s"))
    feats = training_features(rows, key, "_k")
    return (beats.select(*key).join(feats, key, "left")
            .withColumns({"n_beats": F.coalesce("n_beats", F.lit(0)), "beat_coverage": F.coalesce("beat_coverage", F.lit(0.0)),
                          "hr_valid": F.coalesce("hr_valid", F.lit(False)), "hrv_valid": F.coalesce("hrv_valid", F.lit(False))}))


def simple_beats(df: DataFrame, column: str, fs: int, *, above_mean: bool, name: str = "beat_idx") -> DataFrame:
    """Peaks at least 0.6 s apart in an array column, optionally only those above the array's mean."""
    @F.pandas_udf("array<long>")
    def kernel(arrays: pd.Series) -> pd.Series:
        def one(a):
            a = np.asarray(a, dtype=float)
            return find_peaks(a, distance=fs * 0.6, height=a.mean() if above_mean else None)[0].tolist()
        return arrays.map(one)

    return df.withColumn(name, kernel(F.col(column)))


def ecg_r_peaks(samples: DataFrame, owner: list[str], idx: str, value: str, *, fs: int = 700, block_s: int = 10, **ordered) -> DataFrame:
    """R-peak positions (sample index) of long ECG recordings.

    Band-pass 5-20 Hz over every recording as a whole (`filters.zero_phase_blocks`; a gap in the index ends a recording), polarity by the
    larger 99.5th percentile of the owner, height threshold per 10 s block, peaks at least 0.3 s apart also across block edges.
    """
    from pulsegrid.operators.filters import zero_phase_blocks
    from pulsegrid.operators.ordered import grouped_quantiles

    f = zero_phase_blocks(samples, owner, idx, value, butterworth(3, 5.0, 20.0, fs), block=fs * block_s, **ordered)
    f = checkpointed(f)  # read once for the polarity, once for the peaks
    flat = f.select(*owner, F.explode("x").alias("v")).withColumn("v", F.round("v", 6))
    q = grouped_quantiles(flat, owner, "v", {"_hi": ("linear", 0.995), "_lo": ("linear", 0.005)}, **ordered)
    signed = f.join(q, owner).withColumn("_flip", -F.col("_lo") > F.col("_hi"))

    @F.pandas_udf("array<long>")
    def peaks(arrays: pd.Series, flip: pd.Series, start: pd.Series) -> pd.Series:
        out = []
        for a, neg, first in zip(arrays, flip, start):
            x = -np.asarray(a, float) if neg else np.asarray(a, float)
            p = [] if len(x) < fs else find_peaks(x, height=0.4 * np.percentile(x, 99.5), distance=int(0.3 * fs))[0]
            out.append([int(v) + int(first) for v in p])
        return pd.Series(out)

    found = signed.select(*owner, F.explode(peaks("x", "_flip", "start")).alias("peak"))
    return merge_detections(found, owner, "peak", int(0.3 * fs), **ordered)


def merge_detections(found: DataFrame, owner: list[str], at: str, gap: int, **ordered) -> DataFrame:
    """Union of block-wise detections: equal ones once, and none closer than `gap` to the one before."""
    o = Ordered(found.distinct(), owner, [at], **ordered).around(1, 0, lambda w: {"_prev": F.lag(at).over(w)})
    return o.rows.filter(F.col("_prev").isNull() | (F.col(at) - F.col("_prev") >= gap)).drop("_prev")


def motion_flag(kind: Column, value: Column) -> Column:
    """Whether a motion figure counts as moving: the calibrated deviation (`z`), the spread of the acceleration at the wrist or the
    chest in g, or the share of spoilt camera samples. NULL for other kinds and missing figures."""
    limit = F.lit(None).cast("double")
    for name, least in MOTION_LIMITS.items():
        limit = F.when(kind == name, F.lit(least)).otherwise(limit)
    return value > limit
