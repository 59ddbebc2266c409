"""Event-time replay: operators on live rows whose output depends on the rows alone, not on batches or clocks.

Rows of a key wait in map state until the watermark has passed them and are then played in order of time; what is due when
nothing comes (a silence, a retry) is an event-time timer. A row later than the watermark is dropped, as everywhere in a stream. State per
key is what waits inside the watermark's delay and the few values each operator names; nothing is kept by the processing clock.

The operators need the RocksDB state store (`with_rocks`).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from pulsegrid import constants as K
from pulsegrid.streaming.spans import qualities

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DELAY = "20 seconds"


@contextmanager
def with_rocks(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


# rows taken from the input before they are stored, rows of a stored piece, and rows played together
STORE_ROWS, PIECE_ROWS, PLAY_ROWS = 200_000, 5_000, 20_000
ARROW = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


def packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


class Replay(StatefulProcessor):
    """Plays a key's rows in order of `t_ms` once the watermark has passed them.

    Rows wait in pieces of some thousand rows that are next to each other in time. They are played from the earliest piece on, and of the
    waiting rows only those are in memory whose pieces overlap in time, so a batch may hold any number of a key's rows in any order.

    Subclasses give `rows` (schema of a waiting row, t_ms first), `state` (schema of the values kept) and `play`, which gets a key's rows
    in one or in many calls.
    """

    rows: str
    state: str

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "start_ms long, number long", "rows binary")
        self.kept = handle.getValueState("kept", self.state)
        self.numbers = handle.getValueState("numbers", "next long")
        self.schema = pa.schema([(f.split()[0], ARROW[f.split()[1]]) for f in self.rows.split(", ")])

    def store(self, rows: pa.Table) -> None:
        t = rows["t_ms"].to_numpy()
        order = np.argsort(t, kind="stable")
        rows, t = rows.take(pa.array(order)).combine_chunks(), t[order]
        number = self.numbers.get()[0] if self.numbers.exists() else 0
        at = 0
        while at < len(t):
            self.waiting.updateValue((int(t[at]), number), (packed(rows.slice(at, PIECE_ROWS)),))
            at, number = at + PIECE_ROWS, number + 1
        self.numbers.update((number,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        taken, n, last = [], 0, None
        for pdf in rows:
            taken.append(pa.Table.from_pandas(pdf[self.schema.names], self.schema, preserve_index=False))
            n += len(pdf)
            if len(pdf):
                last = max(int(pdf["t_ms"].max()), last if last is not None else int(pdf["t_ms"].max()))
            if n >= STORE_ROWS:
                self.store(pa.concat_tables(taken))
                taken, n = [], 0
        if n:
            self.store(pa.concat_tables(taken))
        if last is not None:
            self.handle.registerTimer(last)
        return iter(())

    def due(self, upto: int) -> Iterator[tuple[pa.Table, int]]:
        """Waiting rows up to a time in portions one after the other, and up to when each portion is complete."""
        pieces = sorted(k for k in ((int(a), int(b)) for a, b in self.waiting.keys()) if k[0] <= upto)
        held, n = [], 0
        for i, piece in enumerate(pieces):
            held.append(pa.ipc.open_stream(bytes(self.waiting.getValue(piece)[0])).read_all())
            self.waiting.removeKey(piece)
            n += len(held[-1])
            until = upto if i + 1 == len(pieces) else pieces[i + 1][0] - 1
            if n < PLAY_ROWS and until < upto:
                continue
            rows = pa.concat_tables(held)
            now = pc.less_equal(rows["t_ms"], until)
            portion, rows = rows.filter(now), rows.filter(pc.invert(now))
            held, n = [rows], len(rows)
            if len(portion):
                yield portion, until
        if n:
            self.store(pa.concat_tables(held))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = int(timerValues.getCurrentWatermarkInMs())
        state, wake, played = tuple(self.kept.get()) if self.kept.exists() else None, None, None
        for portion, until in self.due(upto):
            order = [(c, "ascending") for c in self.schema.names]
            rows = portion.take(pc.sort_indices(portion, sort_keys=order, null_placement="at_start"))
            state, out, wake = self.play(state, rows.to_pandas(), until)
            played = until
            if len(out):
                yield self.told(key, out)
        if played != upto:      # what comes due without a row
            state, out, wake = self.play(state, self.schema.empty_table().to_pandas(), upto)
            if len(out):
                yield self.told(key, out)
        if state is not None:
            self.kept.update(state)
        if wake is not None and wake > upto:
            self.handle.registerTimer(int(wake))

    def told(self, key: tuple, out: pd.DataFrame) -> pd.DataFrame:
        for name, value in zip(self.keys, key):
            out.insert(0, name, value)
        return out

    def play(self, state: tuple | None, rows: pd.DataFrame, upto: int) -> tuple[tuple | None, pd.DataFrame, int | None]:
        """State after `rows` (in order, NULL first; all there are up to the time `upto`), their output, and when to be called again."""
        raise NotImplementedError

    def close(self) -> None:
        pass


def replayed(rows: DataFrame, key: str, ts: str, processor: Replay, output: str, delay: str) -> DataFrame:
    """Run a processor over `rows`, which have `key`, the event time `ts` and the processor's columns."""
    processor.keys = [key]
    kind = rows.schema[key].dataType.simpleString()
    return rows.withWatermark(ts, delay).groupBy(key).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=f"{key} {kind}, {output}", outputMode="Append", timeMode="EventTime")


def timed(rows: DataFrame, t_ms: str, name: str = "_at") -> DataFrame:
    """Adds the event time of a column of milliseconds."""
    return rows.withColumn(name, F.timestamp_millis(F.col(t_ms).cast("long")))


# -- phases -------------------------------------------------------------------------------------------

class Phases(Replay):
    rows, state = "t_ms long, phase string", "phase string, start_ms long"

    def play(self, state, rows, upto):
        phase, start = state or (None, None)
        p = pd.concat([pd.DataFrame([(start, phase)], columns=["t_ms", "phase"]), rows], ignore_index=True) if phase is not None else rows
        turn = p[p["phase"].ne(p["phase"].shift())]                     # rows that begin something else
        ended = turn["t_ms"].shift(-1)
        done = ended.notna() & ~turn["phase"].isin(["stop", "end"])
        out = pd.DataFrame({"phase": turn["phase"], "start_ms": turn["t_ms"], "end_ms": ended, "aborted": turn["phase"].shift(-1).eq("stop")})[done]
        last = (turn["phase"].iloc[-1], int(turn["t_ms"].iloc[-1])) if len(turn) else state
        return last, out.astype({"start_ms": "int64", "end_ms": "int64"}), None


def phase_intervals(events: DataFrame, session: str = "session", delay: str = DELAY) -> DataFrame:
    """Phase intervals from step events (session, t_ms, phase; 'end' closes the open phase, 'stop' closes it as aborted).

    A phase is emitted when the next one starts; the same phase again changes nothing.
    """
    return replayed(timed(events.select(session, F.col("t_ms").cast("long").alias("t_ms"), "phase"), "t_ms"), session, "_at", Phases(),
                    "phase string, start_ms long, end_ms long, aborted boolean", delay)


# -- packets of a device ------------------------------------------------------------------------------

def _changes(t: np.ndarray, what: np.ndarray, shown: str) -> np.ndarray:
    """Places at which the value differs from the one before."""
    return np.flatnonzero(what != np.concatenate([[shown], what[:-1]])) if len(t) else np.zeros(0, int)


class Quality(Replay):
    rows, state = "t_ms long, rr_ms double, contact boolean", "t array<long>, rr array<double>, last long, shown string"

    def __init__(self, trailing_s: int, silent_ms: int):
        self.trailing_s, self.silent_ms = trailing_s, silent_ms

    def play(self, state, rows, upto):
        old_t, old_rr, last, shown = state or ([], [], None, "")
        t, rr = rows["t_ms"].to_numpy(np.int64), rows["rr_ms"].to_numpy(float)
        lost = np.array([c is False or c is np.False_ for c in rows["contact"]], bool)
        # intervals count while they are recent, unless contact was lost
        has = np.isfinite(rr) & ~lost
        at, values = np.r_[np.array(old_t, np.int64), t[has]], np.r_[np.array(old_rr, float), rr[has]]
        lo = np.searchsorted(at, t - self.trailing_s * 1000, "right")
        hi = len(old_t) + np.cumsum(has)
        what = qualities(values, lo, hi, self.trailing_s)
        what[lost] = "poor"
        # a silence is poor from `silent_ms` after the packet before it
        ends = np.r_[[] if last is None else [last], t].astype(np.int64)
        until = np.r_[ends[1:], upto] if len(ends) else ends
        silent = ends[until - ends > self.silent_ms] + self.silent_ms
        when, what = np.r_[t, silent], np.r_[what, np.full(len(silent), "poor", object)]
        order = np.lexsort((what.astype(str), when))
        when, what = when[order], what[order]
        new = _changes(when, what, shown)
        last = int(ends[-1]) if len(ends) else None
        keep = at > (last or 0) - self.trailing_s * 1000
        after = (at[keep].tolist(), values[keep].tolist(), last, str(what[-1]) if len(what) else shown)
        wake = None if last is None else last + self.silent_ms + 1
        return (after if last is not None else None), pd.DataFrame({"t_ms": when[new], "quality": what[new]}), wake


def live_quality(packets: DataFrame, device: str = "device", *, trailing_s: int = 20, silent_ms: int = 4000, delay: str = DELAY) -> DataFrame:
    """Signal quality over the trailing seconds, one row per change; poor without contact and once more than `silent_ms` have
    passed without a packet. packets: device, t_ms, rr_ms (NULL = rate only), contact; one row per interval."""
    rows = packets.select(device, F.col("t_ms").cast("long").alias("t_ms"), F.col("rr_ms").cast("double").alias("rr_ms"), "contact")
    return replayed(timed(rows, "t_ms"), device, "_at", Quality(trailing_s, silent_ms), "t_ms long, quality string", delay)


class Device(Replay):
    rows, state = "t_ms long, rr_ms double, contact boolean, battery long", "contact string, has_rr boolean, battery long"

    def play(self, state, rows, upto):
        contact, has_rr, battery = state or (None, None, None)
        told = pd.DataFrame({
            "t_ms": rows["t_ms"], "contact": rows["contact"].map(lambda c: None if c is None else str(bool(c)).lower()),
            "has_rr": np.logical_or.accumulate(rows["rr_ms"].notna().to_numpy()) | bool(has_rr), "battery": rows["battery"].astype("Int64").ffill()})
        if battery is not None:
            told["battery"] = told["battery"].fillna(battery)
        if not len(told):
            return state, told, None
        names = ["contact", "has_rr", "battery"]
        whole = told[names].astype(object).where(told[names].notna(), "")
        first = pd.DataFrame([[("" if v is None else v) for v in (contact, has_rr, battery)]], columns=names)
        before = pd.concat([first, whole.iloc[:-1]], ignore_index=True)
        new = (whole.reset_index(drop=True) != before).any(axis=1).to_numpy() | (np.arange(len(told)) == 0) & (state is None)
        last = whole.iloc[-1]
        after = (last["contact"] or None, bool(last["has_rr"]), None if last["battery"] == "" else int(last["battery"]))
        out = told[new].assign(contact=lambda d: d["contact"].map({"true": True, "false": False}))
        return after, out.astype({"battery": "Int64", "contact": "boolean"}), None


def device_state(packets: DataFrame, device: str = "device", *, delay: str = DELAY) -> DataFrame:
    """Contact, whether intervals were ever sent, and the battery level last told, one row per change.

    packets: device, t_ms, rr_ms, contact, battery (NULL: not told in this packet)."""
    rows = packets.select(device, F.col("t_ms").cast("long").alias("t_ms"), F.col("rr_ms").cast("double").alias("rr_ms"), "contact", F.col("battery").cast("long").alias("battery"))
    return replayed(timed(rows, "t_ms"), device, "_at", Device(), "t_ms long, contact boolean, has_rr boolean, battery long", delay)


# seconds between attempts to reach a device again (fixed values)
RETRY_S = (1, 2, 4, 8, 16)


class Gaps(Replay):
    rows, state = "t_ms long", "last long, told int"

    def __init__(self, silent_ms: int, retry_s: tuple):
        self.after = silent_ms + np.cumsum([0, *(s * 1000 for s in retry_s)])      # of the attempts, and of giving up

    def play(self, state, rows, upto):
        last, told = state or (None, 0)
        t = rows["t_ms"].to_numpy(np.int64)
        ends = np.r_[[] if last is None else [last], t].astype(np.int64)
        out = []
        for i, start in enumerate(ends):
            until = ends[i + 1] if i + 1 < len(ends) else upto + 1
            due = int(np.searchsorted(start + self.after, until))           # what has come before the next packet
            known = told if i == 0 and last is not None else 0
            out += [(int(start + self.after[k]), "gone" if k == len(self.after) - 1 else "retry", min(k + 1, len(self.after) - 1)) for k in range(known, due)]
            if i + 1 < len(ends) and due:
                out.append((int(until), "back", min(due, len(self.after) - 1)))
            told = due
        if not len(ends):
            return state, pd.DataFrame(out), None
        wake = int(ends[-1] + self.after[told]) if told < len(self.after) else None
        return (int(ends[-1]), told), pd.DataFrame(out, columns=["t_ms", "event", "attempt"]), wake


def connection_gaps(packets: DataFrame, device: str = "device", *, silent_ms: int = 4000, retry_s: tuple = RETRY_S, delay: str = DELAY) -> DataFrame:
    """After `silent_ms` without a packet a retry marker, more of them at growing delays, then `gone`; the next packet is `back`
    with the number of attempts made. packets: device, t_ms."""
    return replayed(timed(packets.select(device, F.col("t_ms").cast("long").alias("t_ms")), "t_ms"), device, "_at", Gaps(silent_ms, retry_s),
                    "t_ms long, event string, attempt int", delay)


# how far back rows of a kind are kept: milliseconds, or a number of rows (fixed values)
KEEP_MS = {"beats": 1_200_000, "frames": 90_000, "acceleration": 300_000}
KEEP_ROWS = {"samples": 15, "keystrokes": 10}


class Kept(Replay):
    rows, state = "t_ms long, kind string", "t array<long>, kind array<string>"

    def play(self, state, rows, upto):
        old_t, old_kind = state or ([], [])
        t = np.r_[np.array(old_t, np.int64), rows["t_ms"].to_numpy(np.int64)]
        kind = np.array([*old_kind, *rows["kind"]], object)
        out, stay = [], np.zeros(len(t), bool)
        for name in pd.unique(kind):
            mine = np.flatnonzero(kind == name)
            if name in KEEP_MS:
                first = np.searchsorted(t[mine], t[mine] - KEEP_MS[name])
            else:
                first = np.maximum(np.arange(len(mine)) - KEEP_ROWS.get(name, 1) + 1, 0)
            new = mine >= len(old_t)
            n = np.arange(len(mine)) - first + 1
            out.append(pd.DataFrame({"t_ms": t[mine], "kind": name, "n_kept": n, "oldest_ms": t[mine][first]})[new])
            stay[mine[first[-1]:]] = True
        return (t[stay].tolist(), kind[stay].tolist()), pd.concat(out) if out else rows, None


def retained(rows: DataFrame, key: str = "device", *, delay: str = DELAY) -> DataFrame:
    """How many rows of its kind a row finds in the buffer, itself included, and the oldest of them.

    rows: device, t_ms, kind. The buffer holds what `KEEP_MS` and `KEEP_ROWS` say of the kind (of others the newest row), so state is
    as long as that and not as the stream."""
    return replayed(timed(rows.select(key, F.col("t_ms").cast("long").alias("t_ms"), "kind"), "t_ms"), key, "_at", Kept(),
                    "t_ms long, kind string, n_kept long, oldest_ms long", delay)


# -- beats as they are shown --------------------------------------------------------------------------

class Shown(Replay):
    rows, state = "t_ms long, beat_ms double", "last double, rates array<double>"

    def __init__(self, apart_ms: float, hold_ms: float, rates: int):
        self.apart_ms, self.hold_ms, self.n = apart_ms, hold_ms, rates

    def play(self, state, rows, upto):
        last, rates = state or (None, [])
        told = rows[rows["beat_ms"] <= rows["t_ms"] - self.hold_ms]["beat_ms"].to_numpy(float)
        # the first later report that is far enough from a beat is where the running maximum passes it
        peak = np.maximum.accumulate(told) if len(told) else told
        onward = np.searchsorted(peak, told + self.apart_ms, "right")
        at, taken = 0 if last is None else int(np.searchsorted(peak, last + self.apart_ms, "right")), []
        while at < len(told):
            taken.append(at)
            at = int(onward[at])
        beats = told[taken]
        gap = np.diff(np.r_[np.nan if last is None else last, beats])
        fits = (gap >= K.RR_LOW_MS) & (gap <= K.RR_HIGH_MS)
        all_ = np.r_[np.array(rates, float), 60000 / gap[fits]]
        upto_here = len(rates) + np.cumsum(fits)
        rate = [np.sort(all_[max(0, k - self.n):k])[min(k, self.n) // 2] if k else np.nan for k in upto_here]
        out = pd.DataFrame({"t_ms": beats, "rr_ms": np.where(fits, gap, np.nan), "hr": rate})[upto_here > 0] if len(beats) else rows.iloc[:0]
        if not len(beats):
            return state, out, None
        return (float(beats[-1]), all_[-self.n:].tolist()), out, None


def held_back_beats(detections: DataFrame, key: str = "reading", *, apart_ms: float = 250, hold_ms: float = 350, rates: int = 5, delay: str = DELAY) -> DataFrame:
    """Beats to show from detections that are repeated with every look: those at least `hold_ms` older than the look and more than
    `apart_ms` after the beat shown before. The interval counts within the usual range; the rate is the upper median of the last few.

    detections: reading, t_ms (a beat), now_ms (the look)."""
    rows = detections.select(key, F.col("now_ms").cast("long").alias("t_ms"), F.col("t_ms").cast("double").alias("beat_ms"))
    return replayed(timed(rows, "t_ms"), key, "_at", Shown(apart_ms, hold_ms, rates), "t_ms double, rr_ms double, hr double", delay)
