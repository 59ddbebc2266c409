"""Whole flows over the driver's views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.operators import beats as B
from pulsegrid.operators import calibrate as C
from pulsegrid.operators import score as S
from pulsegrid.operators import windows as W
from pulsegrid.plans import tables as T

BEAT_FEATURES = ["hr_mean", "rmssd", "sdnn"]


def beat_window_features(beats: DataFrame) -> DataFrame:
    return B.window_features(beats, ["subject"])


def beat_scores(spark: SparkSession, sf: str, stage: str = "scores", subjects: int = 15) -> DataFrame:
    """Windows of beat features, calibrated on the subject's first rest windows, scored and fused.

    `stage='reference'` stops after the reference windows are marked.
    """
    beats = T.beats(spark, sf, subjects)
    feats = beat_window_features(beats)
    labels = W.majority_label(W.assign_windows(beats, "t_ms"), ["subject", "win_start"], "cond")
    labelled = feats.join(labels, ["subject", "win_start"])
    ref = C.reference_mask(labelled, ["subject"], "win_start", "label", unit=1000)
    if stage == "reference":
        return ref
    stats = C.owner_stats(ref, ["subject"], BEAT_FEATURES, ref["is_ref"])
    z = C.zscores(ref.filter("NOT is_ref"), stats, ["subject"], BEAT_FEATURES)
    return S.fuse(S.score_signals(z, signals=["hr", "hrv"]), signals=["hr", "hrv"])
