"""Words for scores and features: plain column expressions. The sentences are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulsegrid import constants as K
from pulsegrid.functions.scalar import round_up, signed
from pulsegrid.operators.score import leading_signal


def level(score: Column) -> Column:
    return (F.when(score >= 0.4, "stressed").when(score >= 0.1, "raised").when(score > -0.25, "borderline")
            .when(score.isNotNull(), "calm"))


def tone(score: Column) -> Column:
    return F.when(score >= 0.1, "stress").when(score <= -0.25, "calm").otherwise("")


def feeling_word(feeling: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(w) for w in K.FEELINGS]), F.when(feeling > 0, feeling).cast("int"))


def fixed(x: Column, digits: int = 0) -> Column:
    """Fixed decimals with a real minus sign and no negative zero."""
    text = F.format_string(f"%.{digits}f", F.abs(F.round(x, 9)).cast("double"))
    return F.when((x < 0) & (text.cast("double") != 0), F.concat(F.lit("−"), text)).otherwise(text)


def whole(x: Column) -> Column:
    return round_up(x).cast("long").cast("string")


def lean(score: Column) -> Column:
    return (F.when(score >= 0.6, "a strong push towards stress").when(score >= 0.2, "a push towards stress")
            .when(score > -0.2, "close to neutral").otherwise("reads as calm"))


def feeling_sentence(feeling: Column, fused: Column) -> Column:
    word = F.lower(feeling_word(feeling))
    felt = F.when(feeling <= 2, -1).when(feeling >= 4, 1).otherwise(0)
    read = F.when(tone(fused) == "stress", 1).when(tone(fused) == "calm", -1).otherwise(0)
    said = F.concat(F.lit("You said you feel "), word)
    plain = F.concat(said, F.lit("."))
    return (F.when(fused.isNull(), plain).when((felt != 0) & (felt == read), F.concat(said, F.lit(", which matches.")))
            .when((felt != 0) & (read != 0), F.concat(said, F.lit(", but your body reads the other way. Worth noticing, not a verdict.")))
            .otherwise(plain))


def describe_signal(signal: str, rest: str = "rest_") -> tuple[Column, Column]:
    """(value text, text against rest) of a reading's signal, as shown in the app."""
    if signal in ("hr", "hrv"):
        f, unit, dead = ("hr_mean", "bpm", 2) if signal == "hr" else ("rmssd", "ms", 3)
        v, r = F.col(f), F.col(f"{rest}{f}")
        gap = v - r
        text = F.when(F.abs(gap) < dead, F.concat(F.lit("About your resting "), whole(r))).otherwise(F.concat(
            whole(F.abs(gap)), F.when(gap > 0, " above").otherwise(" below"), F.lit(" your resting "), whole(r)))
        return F.concat(whole(v), F.lit(f" {unit}")), F.when(r.isNotNull(), text)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    if signal == "eda":
        return (F.concat(fixed(zero("eda_tonic"), 2), F.lit(" µS")), F.concat(whole(zero("scr_count")), F.lit(" responses a minute")))
    return (F.concat(fixed(zero("temp_mean"), 1), F.lit(" °C")),
            F.concat(F.when(zero("temp_slope") >= 0, "Warming ").otherwise("Cooling "), fixed(F.abs(zero("temp_slope")), 2), F.lit(" °C a minute")))


def signal_line(signal: str) -> Column:
    """One line per signal for the note. Needs score_<signal>, the raw features and mean_<feature>."""
    score = F.col(f"score_{signal}")
    end = F.concat(F.lit(": "), lean(score), F.lit(" (weak signal)." if signal in K.WEAK_SIGNALS else "."))
    if signal == "hr":
        gap = F.col("hr_mean") - F.col("mean_hr_mean")
        rel = F.when(F.abs(gap) < 1.5, "about your resting level").otherwise(
            F.concat(fixed(F.abs(gap)), F.when(gap > 0, " above").otherwise(" below"), F.lit(" rest")))
        text = F.concat(F.lit("Heart rate "), fixed(F.col("hr_mean")), F.lit(" bpm, "), rel, end)
        return F.coalesce(F.when(score.isNotNull(), text), F.lit("Heart rate: too few clean beats in this window, so the pen is lifted."))
    if signal == "hrv":
        text = F.concat(F.lit("RMSSD "), fixed(F.col("rmssd")), F.lit(" ms against "), fixed(F.col("mean_rmssd")), F.lit(" at rest"), end)
        return F.coalesce(F.when(score.isNotNull(), text), F.lit("Heart-rate variability: too few clean beats in this window, so the pen is lifted."))
    if signal == "eda":
        gap = F.col("eda_tonic") - F.col("mean_eda_tonic")
        near = F.when(F.abs(gap) < 0.1, "near its resting level").otherwise(F.concat(signed(gap, 2), F.lit(" µS from rest")))
        n = round_up(F.col("scr_count")).cast("long")
        text = F.concat(F.lit("Skin conductance "), near, F.lit(", "), n.cast("string"), F.when(n == 1, " response a minute").otherwise(" responses a minute"), end)
        return F.coalesce(F.when(score.isNotNull(), text), F.lit("Skin conductance: no reading in this window."))
    slope = F.col("temp_slope")
    trend = F.when(F.abs(slope) < 0.02, "steady").when(slope < 0, "cooling").otherwise("warming")
    text = F.concat(F.lit("Hand temperature "), trend, F.lit(" ("), signed(slope, 2), F.lit(" °C/min)"), end)
    return F.coalesce(F.when(score.isNotNull(), text), F.lit("Skin temperature: no reading in this window."))


def narrative(motion: Column, signals: list[str] = K.SIGNALS) -> tuple[Column, Column, Column]:
    """(summary, caveat, tip) from fused, fused_logit, logit_<signal>, hr_mean and mean_hr_mean."""
    fused, up = F.col("fused"), F.col("fused_logit") > 0
    lead = leading_signal("fused_logit", signals)
    gap = F.greatest(F.col("hr_mean") - F.col("mean_hr_mean"), F.lit(0.0))
    clause = (F.when(lead == "hr", F.when(up, F.concat(F.lit("heart rate "), fixed(gap), F.lit(" bpm above your resting level"))).otherwise("a heart rate close to rest"))
              .when(lead == "eda", F.when(up, "skin conductance rising with frequent sweat responses").otherwise("quiet skin conductance"))
              .when(lead == "temp", F.when(up, "cooling hands").otherwise("steady hand temperature"))
              .when(lead == "hrv", F.when(up, "lower heart-rate variability").otherwise("heart-rate variability near rest")))
    by = F.coalesce(F.concat(F.lit(", led by "), clause), F.lit(""))
    lv = level(fused)
    summary = (F.when(fused.isNull(), "Every pen is lifted or has no reading, so there is nothing to fuse.")
               .when(lv == "stressed", F.concat(F.lit("Your readings point to high stress"), by, F.lit(".")))
               .when(lv == "raised", F.concat(F.lit("Your readings are somewhat raised"), by, F.lit(".")))
               .when(lv == "borderline", "Your readings are mixed, close to the line between calm and stressed.")
               .otherwise(F.concat(F.lit("Your readings look settled"), by, F.lit("."))))
    has_hr = F.col("logit_hr").isNotNull() if "hr" in signals else F.lit(False)
    caveat = F.when(motion & has_hr, "Your wrist is moving a lot. Heart rate rises with movement too, so a high reading here may be exercise, not stress.")
    name_it = "Pause for a moment and name what is making you tense; putting it into words often takes the edge off."
    tip = (F.when(fused.isNull(), "Put at least one pen back down to get a reading.")
           .when(motion & (lead == "hr") & up, "If you have just been walking or moving about, sit for a few minutes before trusting a high reading.")
           .when((lv == "stressed") & (lead == "eda"), name_it)
           .when((lv == "stressed") & (lead == "temp"), "Warm your hands and loosen your shoulders; cold hands often come with tension.")
           .when(lv == "stressed", "Try slow breathing for two minutes: in for four counts, out for six. A longer exhale slows the heart.")
           .when((lv == "raised") & (lead == "eda"), name_it)
           .when(lv == "raised", "Take a short break: stand up, look out of a window, and let your breathing slow down.")
           .when(lv == "borderline", "Nothing urgent. Check in with yourself: a glass of water and a stretch are cheap insurance.")
           .otherwise("Nothing to fix right now. This is a good moment to start something that needs focus."))
    return summary, caveat, tip


def note(measured: Column, scored: Column, baseline_n: Column, motion: Column, feeling: Column, tags: Column) -> Column:
    """The note under a check-in."""
    feel = feeling_sentence(feeling, F.col("fused"))
    tag = F.when(F.size(tags) > 0, F.concat(F.lit('You tagged it "'), F.array_join(tags, '", "'), F.lit('".')))
    summary, caveat, tip = narrative(motion)
    left = F.greatest(F.lit(0), F.lit(K.BASELINE_DAYS) - F.coalesce(baseline_n, F.lit(0)))
    first = F.coalesce(F.concat(F.lit("Heart rate "), whole(F.col("hr_mean")), F.lit(" bpm.")), F.lit("No clear heart rate in this reading."))
    wait = F.when(left > 0, F.concat(F.lit(f"Scores start once your baseline has {K.BASELINE_DAYS} resting readings on different days; "), left.cast("string"), F.lit(" to go.")))
    return (F.when(~measured, F.concat_ws(" ", F.coalesce(feel, F.lit("A check-in with no measurement.")), tag))
            .when(~scored, F.concat_ws(" ", first, wait, feel, tag)).otherwise(F.concat_ws(" ", summary, feel, tag, caveat, tip)))


def facts(by_signal: Column, hr: Column, resting: Column, rmssd: Column, feeling: Column, tags: Column) -> Column:
    """The rounded facts a written note may use; at most five tags."""
    two = lambda c: round_up(c, 2)
    return F.struct(
        two(F.col("fused")).alias("fused"), F.transform_values(by_signal, lambda k, v: round_up(v, 2)).alias("bySignal"),
        round_up(hr).alias("hr"), round_up(resting).alias("restingHr"), F.when(F.map_contains_key(by_signal, "hrv"), round_up(rmssd)).alias("rmssd"),
        feeling.alias("feeling"), F.slice(tags, 1, 5).alias("tags"),
        F.expr("CAST(array() AS ARRAY<STRUCT<id: STRING, change: STRING>>)").alias("activities"))


def prompt(facts_col: Column) -> Column:
    return F.concat(F.lit("Check-in facts (JSON): "), F.to_json(facts_col), F.lit("\nFeeling is 1 very calm to 5 very tense. Write the note."))


def facts_valid(f: str = "facts") -> Column:
    """Whether a facts row keeps to its ranges and lists; missing numbers are allowed."""
    within = lambda c, lo, hi: F.col(f"{f}.{c}").isNull() | F.col(f"{f}.{c}").between(lo, hi)
    label = lambda t, n: t.isNotNull() & (F.length(F.trim(t)) > 0) & (F.length(t) <= n) & ~t.rlike(r"[\x00-\x1f<>]")
    tags, acts = F.col(f"{f}.tags"), F.col(f"{f}.activities")
    entries = F.map_entries(F.col(f"{f}.bySignal"))
    return F.coalesce(
        within("fused", -5, 5) & within("hr", 20, 250) & within("restingHr", 20, 250) & within("rmssd", 0, 500) & within("feeling", 1, 5)
        & F.forall(entries, lambda e: e["key"].isin("hr", "hrv", "eda", "temp") & e["value"].isNotNull() & e["value"].between(-5, 5))
        & (F.size(tags) <= 10) & F.forall(tags, lambda t: label(t, 40)) & (F.size(acts) <= 8)
        & F.forall(acts, lambda a: a["id"].isin(K.ACTIVITIES) & label(a["change"], 80)), F.lit(False))


def acceptable_note(text: Column) -> Column:
    """Cleaned text of a generated note, or NULL when it breaks a rule: length, self-reference, marks, sentences."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    sentences = F.filter(F.split(t, r"(?<=[.!?])\s+"), lambda s: s != "")
    bad = (t.rlike(r"(?i)\b(as an ai|an ai\b|language model|i'm an ai|i am an ai|chatgpt|llm)\b") | t.rlike(r"[#*`]|^\s*[-•]") | (F.size(sentences) > 4))
    return F.when(F.length(t).between(20, 600) & ~bad, t)
