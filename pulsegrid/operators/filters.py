"""Exact zero-phase filtering of recordings of any length, block by block.

A recursive filter carries a few numbers from sample to sample. Over a block their end is an affine function of their start: a matrix
that depends on the block's length alone, times the start, plus what the block gives from rest. So every block is run from rest at
once, a prefix scan over the blocks composes the ends to the true starts, and every block is run again from its own. The backward
pass does the same from the right. The result equals one pass over the whole recording for every block size.

A recording is a run of consecutive sample numbers; where numbers are missing a new one begins. Its ends are extended oddly, as in
`signals.zero_phase`.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.ordered import Ordered, sized
from pulsegrid.session import checkpointed

SCAN = 256      # blocks composed at a time


def _six(sections) -> list[tuple]:
    return [tuple(np.pad(b, (0, 3 - len(b)))) + tuple(np.pad(a, (0, 3 - len(a)))) for b, a in sections]


def run_from(six: list[tuple], x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filter the rows of x from the states z (rows x 2 per section); outputs and end states."""
    ends = np.empty_like(z)
    for k, (b0, b1, b2, _, a1, a2) in enumerate(six):
        p, q = z[:, 2 * k].copy(), z[:, 2 * k + 1].copy()
        y = np.empty_like(x)
        for i in range(x.shape[1]):
            u = x[:, i]
            v = b0 * u + p
            p, q = b1 * u - a1 * v + q, b2 * u - a2 * v
            y[:, i] = v
        ends[:, 2 * k], ends[:, 2 * k + 1] = p, q
        x = y
    return x, ends


def steady(six: list[tuple]) -> np.ndarray:
    """The state that a constant input of 1 leaves unchanged."""
    out, level = [], 1.0
    for b0, b1, b2, _, a1, a2 in six:
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        low = (b2 - a2 * gain) * level
        out += [(b1 - a1 * gain) * level + low, low]
        level *= gain
    return np.array(out)


@lru_cache(64)
def carry(six: tuple, n: int) -> np.ndarray:
    """What n samples of silence make of a state: the matrix of a block's affine function."""
    size = 2 * len(six)
    return run_from(list(six), np.zeros((size, n)), np.eye(size))[1].T


def zero_phase_blocks(samples: DataFrame, owner: list[str], idx: str, value: str, sections, *, block: int, **ordered) -> DataFrame:
    """(owner, start, x): filtered samples in arrays of about `block` consecutive ones, the first with number `start`."""
    six = tuple(_six(sections))
    size, pad = 2 * len(six), 3 * (2 * len(six) + 1)
    if block < 2 * pad:
        raise ValueError("a block is longer than the extension of an end")
    ordered = sized(samples, owner, **ordered)
    o = Ordered(samples.select(*owner, F.col(idx).cast("long").alias("_i"), F.col(value).cast("double").alias("_v")), owner, ["_i"], **ordered)
    o = o.around(1, 0, lambda w: {"_new": F.coalesce(F.col("_i") - F.lag("_i").over(w) != 1, F.lit(True))})
    rows = o.running({"_seg": ("max", F.when(F.col("_new"), F.col("_i")))}).rows
    key = [*owner, "_seg"]
    cell = F.transform(F.sort_array(F.collect_list(F.struct("_i", "_v"))), lambda s: s["_v"])
    blocks = checkpointed(rows.groupBy(*key, F.floor((F.col("_i") - F.col("_seg")) / block).alias("_b")).agg(cell.alias("x")))
    last = blocks.groupBy(*key).agg(F.max("_b").alias("_last"), F.sum(F.size("x")).alias("_len"))
    blocks = blocks.join(last, key).filter(F.col("_len") > pad)
    # the extension of the right end reaches into the block before
    near = Ordered(blocks, key, ["_b"], **ordered).around(1, 0, lambda w: {"_before": F.lag(F.slice("x", F.greatest(F.size("x") - pad, F.lit(1)), F.lit(pad + 1))).over(w)})
    blocks = near.rows.withColumn("_before", F.when(F.col("_b") == F.col("_last"), F.col("_before"))).drop("_len")
    first, final = F.col("_b") == 0, F.col("_b") == F.col("_last")

    def batched(x: list[np.ndarray], z: list[np.ndarray]) -> tuple[list, list]:
        """`run_from` for rows of unlike lengths."""
        out, ends = [None] * len(x), [None] * len(x)
        for n in {len(v) for v in x}:
            at = [i for i, v in enumerate(x) if len(v) == n]
            y, e = run_from(list(six), np.stack([x[i] for i in at]), np.stack([z[i] for i in at]))
            for i, a, b in zip(at, y, e):
                out[i], ends[i] = a, b
        return out, ends

    rest = np.zeros(size)

    @F.pandas_udf("array<double>")
    def end_forward(x: pd.Series, is_first: pd.Series) -> pd.Series:
        ext = [np.r_[2 * v[0] - v[pad:0:-1], v] if f else v for v, f in zip(x, is_first)]
        return pd.Series([e.tolist() for e in batched(ext, [steady(six) * v[0] if f else rest for v, f in zip(ext, is_first)])[1]])

    @F.pandas_udf("array<double>")
    def run_forward(x: pd.Series, before: pd.Series, is_first: pd.Series, is_final: pd.Series, z: pd.Series) -> pd.Series:
        ext, start = [], []
        for v, b, f, e, s in zip(x, before, is_first, is_final, z):
            tail = (v if b is None or len(v) > pad else np.r_[b, v])
            v = np.r_[v, 2 * v[-1] - tail[-2:-pad - 2:-1]] if e else v
            v = np.r_[2 * v[0] - v[pad:0:-1], v] if f else v
            ext.append(v)
            start.append(steady(six) * v[0] if f else np.asarray(s))
        return pd.Series([(y[pad:] if f else y).tolist() for y, f in zip(batched(ext, start)[0], is_first)])

    @F.pandas_udf("array<double>")
    def end_backward(y: pd.Series, is_final: pd.Series) -> pd.Series:
        back = [v[::-1] for v in y]
        return pd.Series([e.tolist() for e in batched(back, [steady(six) * v[0] if f else rest for v, f in zip(back, is_final)])[1]])

    @F.pandas_udf("array<double>")
    def run_backward(y: pd.Series, is_final: pd.Series, z: pd.Series) -> pd.Series:
        back = [v[::-1] for v in y]
        out = batched(back, [steady(six) * v[0] if f else np.asarray(s) for v, f, s in zip(back, is_final, z)])[0]
        return pd.Series([(w[pad:] if f else w)[::-1].tolist() for w, f in zip(out, is_final)])

    def starts(ends: DataFrame, step: str) -> DataFrame:
        """The state every block starts from; ends: key, _b, n, c (and `fresh`: c does not depend on a start), in the order of `step`."""
        ends = ends.withColumn("_group", F.floor(F.col(step) / SCAN))
        kinds = ", ".join(f"`{k}` {ends.schema[k].dataType.simpleString()}" for k in key)

        def composed(pdf: pd.DataFrame) -> pd.DataFrame:
            m, c = np.eye(size), np.zeros(size)
            pdf = pdf.sort_values(step)
            for n, e, fresh in zip(pdf["n"], pdf["c"], pdf["fresh"]):
                a = np.zeros((size, size)) if fresh else carry(six, int(n))
                m, c = a @ m, a @ c + np.asarray(e)
            return pd.DataFrame([[*pdf.iloc[0][key], pdf["_group"].iloc[0], m.ravel().tolist(), c.tolist()]], columns=[*key, "_group", "m", "c"])

        def scanned(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf, z, out = pdf.sort_values("_group"), np.zeros(size), []
            for m, c in zip(pdf["m"], pdf["c"]):
                out.append(z.tolist())
                z = np.asarray(m).reshape(size, size) @ z + np.asarray(c)
            return pd.DataFrame({**{k: pdf[k] for k in key}, "_group": pdf["_group"], "z": out})

        def spread(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(step)
            z, out = np.asarray(pdf["z"].iloc[0]), []
            for n, e, fresh in zip(pdf["n"], pdf["c"], pdf["fresh"]):
                out.append(z.tolist())
                z = (0 if fresh else carry(six, int(n)) @ z) + np.asarray(e)
            return pd.DataFrame({**{k: pdf[k] for k in key}, "_b": pdf["_b"], "z": out})

        groups = ends.groupBy(*key, "_group").applyInPandas(composed, f"{kinds}, _group long, m array<double>, c array<double>")
        at = groups.groupBy(*key).applyInPandas(scanned, f"{kinds}, _group long, z array<double>")      # one row per SCAN blocks
        return ends.join(at, [*key, "_group"]).groupBy(*key, "_group").applyInPandas(spread, f"{kinds}, _b long, z array<double>")

    n = F.size("x")
    ends = blocks.select(*key, "_b", n.alias("n"), end_forward("x", first).alias("c"), first.alias("fresh"))
    forward = blocks.join(starts(ends, "_b"), [*key, "_b"])
    y = checkpointed(forward.select(*key, "_b", "_last", n.alias("n"), run_forward("x", "_before", first, final, "z").alias("y")))
    ends = y.select(*key, "_b", (F.col("_last") - F.col("_b")).alias("_back"), "n", end_backward("y", final).alias("c"), final.alias("fresh"))
    done = y.join(starts(ends, "_back"), [*key, "_b"])
    return done.select(*owner, (F.col("_seg") + F.col("_b") * block).alias("start"), run_backward("y", final, "z").alias("x"))
