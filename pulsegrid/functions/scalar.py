"""Numeric and date column builders."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulsegrid.constants import P_CLIP

LOGIT_LIMIT = math.log((1 - P_CLIP) / P_CLIP)


def sigmoid(x: Column) -> Column:
    """1 / (1 + e^-x); e^-x may overflow to infinity, which gives 0."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def logit(p: Column) -> Column:
    q = clip(p, P_CLIP, 1 - P_CLIP)
    return F.log(q / (F.lit(1.0) - q))


def to_score(p: Column) -> Column:
    """Probability to a score in -1..1."""
    return p * 2 - 1


def z_score(x: Column, mean: Column, sd: Column) -> Column:
    return (x - mean) / sd


def clip(x: Column, low: float, high: float) -> Column:
    """NULL stays NULL (`greatest` and `least` alone would skip it)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def round_up(x: Column, digits: int = 0) -> Column:
    """Round half towards plus infinity."""
    scale = float(10 ** digits)
    return F.floor(x * scale + 0.5) / F.lit(scale)


def round_even(x: Column, digits: int = 4) -> Column:
    """Round half to even; NULL stays NULL."""
    return F.bround(x, digits)


def round_significant(x: Column, digits: int = 5) -> Column:
    """Keep `digits` significant digits."""
    power = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.rint(x * power) / power)


def tanh_score(z: Column, alpha: Column, beta: Column, center: Column, scale: Column) -> Column:
    return F.tanh(scale * (alpha * z + beta - center))


def parabolic_offset(left: Column, peak: Column, right: Column) -> Column:
    """Sub-sample position of a peak from its two neighbours, within half a sample."""
    bend = left - peak * 2 + right
    return F.when(bend == 0, F.lit(0.0)).otherwise(clip(F.try_divide((left - right) * 0.5, bend), -0.5, 0.5))


def middle(ordered: Column) -> Column:
    """Median of a sorted array of numbers; NULL when empty."""
    n = F.size(ordered)
    half = F.floor(n / F.lit(2)).cast("int")
    low = F.get(ordered, F.greatest(half - 1, F.lit(0)))
    high = F.get(ordered, half)
    return F.when(n % 2 == 1, high).otherwise((low + high) / 2)


def upper_middle(values: Column) -> Column:
    """Element n // 2 of the sorted array."""
    ordered = F.sort_array(values)
    return F.get(ordered, F.floor(F.size(ordered) / F.lit(2)).cast("int"))


def norm(*axes: Column) -> Column:
    total = axes[0] * axes[0]
    for a in axes[1:]:
        total = total + a * a
    return F.sqrt(total)


def week_start(ts: Column) -> Column:
    """Monday of the week."""
    return F.to_date(F.date_trunc("week", ts))


def local_day(ts: Column, zone: str = "UTC") -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def relative_day(day: Column, today: Column) -> Column:
    """Today, Yesterday, a weekday name within the last week, else day and month."""
    ago = F.datediff(today, day)
    return (F.when(ago == 0, "Today").when(ago == 1, "Yesterday")
            .when((ago > 1) & (ago < 7), F.date_format(day, "EEEE"))
            .otherwise(F.date_format(day, "d MMM")))


def signed(x: Column, digits: int = 2) -> Column:
    """Fixed decimals with a plus or a real minus sign; zero has no sign."""
    text = F.format_string(f"%.{digits}f", F.abs(x).cast("double"))
    return F.when(text.cast("double") == 0, text).otherwise(F.concat(F.when(x < 0, "−").otherwise("+"), text))


def key_of(identifier: Column) -> Column:
    """Stable one-way key of an identifier."""
    return F.sha2(identifier.cast("string"), 256)


def seal(value: Column, key: Column, iv: Column, record_id: Column, kind: Column) -> Column:
    """AES-GCM bound to the record it belongs to; the 12-byte IV leads the ciphertext."""
    return F.aes_encrypt(value, key, F.lit("GCM"), F.lit("DEFAULT"), iv, F.concat_ws("|", record_id, kind))


def unseal(sealed: Column, key: Column, record_id: Column, kind: Column) -> Column:
    return F.aes_decrypt(sealed, key, F.lit("GCM"), F.lit("DEFAULT"), F.concat_ws("|", record_id, kind))
