"""Clean intervals of many overlapping spans over one row of intervals.

Whether an interval is kept depends on up to K.RR_NEIGHBOURS others on each side. In a longer span only its outermost intervals have
fewer of them than in the whole row, so flags, counts and sums of the whole row serve all spans and each span looks at its ends alone.
"""

from __future__ import annotations

import math

import numpy as np

from pulsegrid import constants as K

k = K.RR_NEIGHBOURS
AROUND = np.r_[-k:0, 1:k + 1]
AT_ONCE = 100_000       # intervals whose neighbours are laid out together


def fits(v: np.ndarray, j: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which of the intervals `v[j]`, all in range, are close to the middle of their neighbours at places `lo` to `hi - 1`; kept with less than two."""
    out = np.empty(len(j), bool)
    for a in range(0, len(j), AT_ONCE):
        s = slice(a, a + AT_ONCE)
        at = j[s, None] + AROUND
        there = (at >= lo[s, None]) & (at < hi[s, None])
        near = np.sort(np.where(there, v[np.clip(at, 0, len(v) - 1)], np.nan), axis=1)      # those not there come last
        n, row = there.sum(1), np.arange(len(at))
        middle = (near[row, np.maximum(n - 1, 0) // 2] + near[row, np.minimum(n // 2, 2 * k - 1)]) / 2
        out[s] = (n < 2) | (np.abs(v[j[s]] - middle) <= K.RR_MAX_DEVIATION * middle)
    return out


def _sums(*columns: np.ndarray) -> np.ndarray:
    """Running sums from 0, a column each; differences of them keep more digits than a double has."""
    return np.concatenate([np.zeros((1, len(columns)), np.longdouble), np.cumsum(np.column_stack(columns), axis=0, dtype=np.longdouble)])


class Spans:
    """Spans [a, b) over the intervals `rr`, in order; one out of range or not a number counts as an interval and is not kept.

    `place` tells which intervals follow each other (by 1); their places in the row, if not given.
    """

    def __init__(self, rr: np.ndarray, place: np.ndarray | None = None):
        inside = (rr >= K.RR_LOW_MS) & (rr <= K.RR_HIGH_MS)
        self.v, self.upto = rr[inside], np.r_[0, np.cumsum(inside)]
        self.follows = np.diff(np.flatnonzero(inside) if place is None else place[inside]) == 1
        n = len(self.v)
        self.kept = fits(self.v, np.arange(n), np.zeros(n, int), np.full(n, n))
        self.centre = float(self.v.mean()) if n else 0.0

    def ends(self, a: np.ndarray, b: np.ndarray) -> None:
        """Look at the ends of the spans. Short ones have no middle and are left to `short`."""
        self.p, self.q = self.upto[a], self.upto[b]
        self.short = np.flatnonzero(self.q - self.p <= 2 * k)
        self.long = np.flatnonzero(self.q - self.p > 2 * k)
        n, e = len(self.v), np.arange(k)
        first, self.of_p = np.unique(self.p[self.long], return_inverse=True)
        last, self.of_q = np.unique(self.q[self.long], return_inverse=True)
        self.first, self.last = first, last
        j = first[:, None] + e
        self.left = fits(self.v, j.ravel(), np.repeat(first, k), np.full(j.size, n)).reshape(j.shape)
        j = last[:, None] - k + e
        self.right = fits(self.v, j.ravel(), np.zeros(j.size, int), np.repeat(last, k)).reshape(j.shape)

    def counts(self) -> np.ndarray:
        """Kept intervals of every span."""
        out = np.zeros(len(self.p), int)
        upto = np.r_[0, np.cumsum(self.kept)]
        out[self.long] = self.left.sum(1)[self.of_p] + upto[self.q[self.long] - k] - upto[self.p[self.long] + k] + self.right.sum(1)[self.of_q]
        out[self.short] = [len(self._brief(i)[0]) for i in self.short]
        return out

    def values(self, spans: np.ndarray) -> list[np.ndarray]:
        """The kept intervals of some spans."""
        where = np.flatnonzero(self.kept)
        number = np.full(len(self.p), -1)
        number[self.long] = np.arange(len(self.long))
        out = []
        for i in spans:
            if number[i] < 0:
                out.append(self._brief(i)[0])
                continue
            p, q, x, y = self.p[i], self.q[i], self.of_p[number[i]], self.of_q[number[i]]
            lo, hi = np.searchsorted(where, [p + k, q - k])
            out.append(np.concatenate([self.v[p:p + k][self.left[x]], self.v[where[lo:hi]], self.v[q - k:q][self.right[y]]]))
        return out

    def _brief(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Kept intervals of a short span, and steps from one kept to the next where they follow each other."""
        p, q = self.p[i], self.q[i]
        kept = fits(self.v, np.arange(p, q), np.full(q - p, p), np.full(q - p, q))
        v = self.v[p:q]
        return v[kept], np.diff(v)[kept[1:] & kept[:-1] & self.follows[p:max(p, q - 1)]]

    def sums(self) -> np.ndarray:
        """Per span: kept intervals, the sum and the sum of squares of their distances from `centre`, steps, the sum of their squares."""
        off, step = self.v - self.centre, np.diff(self.v)
        one = _sums(self.kept, np.where(self.kept, off, 0), np.where(self.kept, off * off, 0))
        both = self.kept[1:] & self.kept[:-1] & self.follows
        two = _sums(both, np.where(both, step * step, 0))
        p, q = self.p[self.long], self.q[self.long]
        out = np.zeros((len(self.p), 5))
        out[self.long] = np.c_[one[q - k] - one[p + k], two[q - k - 1] - two[p + k]]
        for starts, flags, of, pairs in (
                (self.first, np.c_[self.left, self.kept[np.minimum(self.first + k, len(self.v) - 1)]] if len(self.first) else None, self.of_p, 0),
                (self.last - k - 1, np.c_[self.kept[self.last - k - 1], self.right] if len(self.last) else None, self.of_q, 1)):
            if flags is None:
                continue
            # the interval next to the end is kept as in the whole row and counted there already; the step to it is not
            mine = flags[:, 1:] if pairs else flags[:, :-1]
            at = starts[:, None] + np.arange(k) + pairs
            x = np.where(mine, self.v[at] - self.centre, 0)
            pair = starts[:, None] + np.arange(k)
            there = flags[:, 1:] & flags[:, :-1] & self.follows[pair]
            d = np.where(there, self.v[pair + 1] - self.v[pair], 0)
            out[self.long] += np.c_[mine.sum(1), x.sum(1), (x * x).sum(1), there.sum(1), (d * d).sum(1)][of]
        for i in self.short:
            v, d = self._brief(i)
            x = v - self.centre
            out[i] = len(v), x.sum(), (x * x).sum(), len(d), (d * d).sum()
        return out


def qualities(rr: np.ndarray, a: np.ndarray, b: np.ndarray, seconds: float) -> np.ndarray:
    """Signal quality of the intervals of every span, which lasts `seconds`: how much of the time clean ones cover, and how many
    were not clean; fair without intervals (a device that sends rates only)."""
    s = Spans(rr)
    s.ends(a, b)
    clean, n = s.counts(), b - a
    cover = np.full(len(n), math.inf)
    # so many clean intervals cover the time however short they are
    few = np.flatnonzero((clean >= 3) & (clean * K.RR_LOW_MS <= seconds * 1000))
    cover[few] = [len(v) * np.median(v) / (seconds * 1000) for v in s.values(few)]
    rejected = 1 - clean / np.maximum(n, 1)
    return np.select([n == 0, clean < 3, (cover >= 0.9) & (rejected <= 0.05), (cover >= K.HRV_COVERAGE) & (rejected <= 0.2)], ["fair", "poor", "good", "fair"], "poor").astype(object)


def features(rr: np.ndarray, a: np.ndarray, b: np.ndarray, times: np.ndarray, seconds: float) -> dict[str, np.ndarray]:
    """The features of `array_features` of every span; NaN for NULL. A span that was asked for `times` times has each of its intervals so often.

    Copies of an interval follow each other. From 2 * K.RR_NEIGHBOURS copies on only the first and the last one have others' copies around
    them, so more copies between are all kept and need not be laid out.
    """
    out = {c: np.full(len(a), math.nan) for c in ("hr_mean", "rmssd", "sdnn", "coverage", "rejected")}
    n_clean, laid = np.zeros(len(a), np.int64), np.minimum(times, 2 * k)
    upto = np.r_[0, np.cumsum((rr >= K.RR_LOW_MS) & (rr <= K.RR_HIGH_MS))]
    for m in np.unique(laid):
        mine = np.flatnonzero(laid == m)
        s = Spans(np.repeat(rr, m))
        s.ends(a[mine] * m, b[mine] * m)
        count, total, square, steps, steps2 = s.sums().T
        # copies that were not laid out: all kept, each a step of 0
        more = times[mine] - m
        if more.any():
            v = rr[(rr >= K.RR_LOW_MS) & (rr <= K.RR_HIGH_MS)] - s.centre
            whole = _sums(v, v * v)
            add = whole[upto[b[mine]]] - whole[upto[a[mine]]]
            each = upto[b[mine]] - upto[a[mine]]
            count, total, square, steps = count + more * each, total + more * add[:, 0], square + more * add[:, 1], steps + more * each
        cover = np.where(count >= 3, 1.5, 0.0)
        few = np.flatnonzero((count >= 3) & (count * K.RR_LOW_MS <= 1.5 * seconds * 1000))
        for i, v in zip(few, s.values(few)):
            if more[i]:
                v = np.r_[v, np.repeat(s.v[s.p[i]:s.q[i]:m], more[i])]
            cover[i] = min(len(v) / (seconds * 1000 / np.median(v)), 1.5)
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = total / count
            out["hr_mean"][mine] = np.where((count >= 3) & (cover >= K.HR_COVERAGE), 60000 / (mean + s.centre), math.nan)
            hrv = (count >= 3) & (cover >= K.HRV_COVERAGE) & (steps >= K.HRV_PAIRS)
            out["rmssd"][mine] = np.where(hrv, np.sqrt(steps2 / steps), math.nan)
            spread = square - total * mean
            # where little is left of large sums, the distances are taken from the mean itself
            for i in np.flatnonzero(hrv & (spread < 1e-6 * square)):
                v, others = s.values([i])[0], s.v[s.p[i]:s.q[i]:m]
                middle = (v.sum() + more[i] * others.sum()) / count[i]
                spread[i] = ((v - middle) ** 2).sum() + more[i] * ((others - middle) ** 2).sum()
            out["sdnn"][mine] = np.where(hrv, np.sqrt(np.maximum(spread, 0) / (count - 1)), math.nan)
        out["coverage"][mine] = cover
        n_clean[mine] = np.rint(count)
    n = (b - a) * times
    out["rejected"] = np.where(n > 0, (n - n_clean) / np.maximum(n, 1), 0.0)
    return {**out, "n_beats": n, "n_clean": n_clean}
