"""Readings scored against baselines, words and notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid import constants as K
from pulsegrid.catalog import query
from pulsegrid.catalog.beat import r6
from pulsegrid.functions import scalar as X
from pulsegrid.functions import text as W
from pulsegrid.functions.scalar import LOGIT_LIMIT
from pulsegrid.operators import calibrate as C
from pulsegrid.operators import score as S
from pulsegrid.plans import readings as R
from pulsegrid.plans import tables as T
from pulsegrid.sources import sinks

TRUST = "(rmssd IS NOT NULL AND sdnn IS NOT NULL AND (source <> 'camera' OR quality = 'good'))"
HAS = {"hr": "hr_mean IS NOT NULL", "eda": "eda_tonic IS NOT NULL", "temp": "temp_mean IS NOT NULL", "hrv": TRUST}
REST_SQL = f"""
SELECT * REPLACE (CASE WHEN {TRUST} THEN rmssd END AS rmssd, CASE WHEN {TRUST} THEN sdnn END AS sdnn)
FROM ({R.READINGS_SQL}) r WHERE quality <> 'poor' AND hr_mean IS NOT NULL AND at_rest"""
BASE_SQL = f"""
SELECT user_id, count(DISTINCT CAST(started_at AS DATE)) AS n, count(*) AS n_readings, {', '.join(f"count_if({HAS[s]}) AS n_{s}" for s in K.SIGNALS)},
 {', '.join(f"avg({f}) AS mean_{f}, CASE WHEN count({f}) > 0 THEN greatest(coalesce(stddev_samp({f}), 0), {K.SD_FLOOR[f]}e0) END AS sd_{f}" for f in K.MODEL_FEATURES)}
FROM ({REST_SQL}) r GROUP BY user_id"""


def carries(s):
    return f"(n_{s} > 0 AND n_{s} >= least(2, n_readings))"


def logit_sql(s):
    terms = " + ".join(f"{K.MODEL_COEF[f]!r}e0 * coalesce(({f} - mean_{f}) / sd_{f}, 0)" for f in K.SIGNAL_FEATURES[s])
    return f"CASE WHEN coalesce(n >= 3, FALSE) AND {HAS[s]} AND coalesce({carries(s)}, FALSE) THEN {K.MODEL_INTERCEPT[s]!r}e0 + {terms} END"


CUT = {s: f"CASE WHEN l_{s} IS NOT NULL THEN least(greatest(l_{s}, -{LOGIT_LIMIT!r}e0), {LOGIT_LIMIT!r}e0) END" for s in K.SIGNALS}
SCORED_SQL = f"""
SELECT *, ({' + '.join(f'coalesce({CUT[s]}, 0)' for s in K.SIGNALS)}) / nullif({' + '.join(f'(CASE WHEN l_{s} IS NULL THEN 0 ELSE 1 END)' for s in K.SIGNALS)}, 0) AS fl FROM (
 SELECT r.*, b.* EXCLUDE (user_id), {', '.join(f'{logit_sql(s)} AS l_{s}' for s in K.SIGNALS)} FROM ({R.READINGS_SQL}) r LEFT JOIN ({BASE_SQL}) b ON b.user_id = r.user_id) x"""


@query("reading_baselines", f"SELECT user_id, n, {', '.join(f'round(mean_{f}, 6) AS mean_{f}, round(sd_{f}, 6) AS sd_{f}' for f in K.MODEL_FEATURES)} FROM ({BASE_SQL}) b")
def _(spark, sf):
    s = C.baselines(R.rest_readings(spark, sf), "user_id", K.MODEL_FEATURES)
    return s.select("user_id", "n", *r6(*[f"{p}_{f}" for f in K.MODEL_FEATURES for p in ("mean", "sd")]))


@query("reading_baselines_by_window", f"SELECT user_id, count(*) AS n FROM ({REST_SQL}) r GROUP BY user_id")
def _(spark, sf):
    return C.baselines(R.rest_readings(spark, sf), "user_id", ["hr_mean"], count="windows").select("user_id", "n")


@query("reading_resting_values", f"""
SELECT r.user_id, CASE WHEN avg(r.hr_mean) IS NOT NULL THEN round(max(b.mean_hr_mean), 6) END AS rest_hr_mean, round(avg(r.temp_mean), 6) AS rest_temp_mean
FROM ({REST_SQL}) r JOIN ({BASE_SQL}) b ON b.user_id = r.user_id GROUP BY r.user_id""")
def _(spark, sf):
    rest = R.rest_readings(spark, sf)
    stats = C.baselines(rest, "user_id", K.MODEL_FEATURES)
    return C.resting_values(rest, stats, "user_id", ["hr_mean", "temp_mean"]).select("user_id", *r6("rest_hr_mean", "rest_temp_mean"))


@query("reading_scores", f"""
SELECT id, {', '.join(f'round(2 / (1 + exp(-l_{s})) - 1, 6) AS score_{s}' for s in K.SIGNALS)}, round(2 / (1 + exp(-fl)) - 1, 6) AS fused, coalesce(n >= 3, FALSE) AS has_baseline FROM ({SCORED_SQL}) s""")
def _(spark, sf):
    return R.scored_checkins(spark, sf).select("id", *r6(*[f"score_{s}" for s in K.SIGNALS], "fused"), "has_baseline")


def reason_sql(s):
    absent = {"eda": "'It needs a wearable that measures it, such as an Empatica E4.'", "temp": "'It needs a wearable that measures it, such as an Empatica E4.'",
              "hr": "'Too few clean beats to read a heart rate.'", "hrv": "CASE WHEN source = 'manual' THEN 'Nothing was measured.' ELSE 'Too few clean beats in a row to read it.' END"}[s]
    present = "rmssd IS NOT NULL AND sdnn IS NOT NULL" if s == "hrv" else HAS[s]
    camera = f"WHEN NOT {TRUST} THEN 'Needs a good signal; the camera''s was ' || quality || '. Heart rate still counts.'" if s == "hrv" else ""
    return f"SELECT id, '{s}' AS signal, CASE WHEN NOT ({present}) THEN {absent} {camera} WHEN n >= 3 AND NOT {carries(s)} THEN 'Your baseline has no resting reading of it yet.' END AS reason FROM j"


@query("reading_usable_signals", f"""
WITH j AS (SELECT r.*, b.* EXCLUDE (user_id) FROM ({R.READINGS_SQL}) r LEFT JOIN ({BASE_SQL}) b ON b.user_id = r.user_id)
SELECT id, signal, reason IS NULL AS used, reason FROM ({' UNION ALL '.join(reason_sql(s) for s in K.SIGNALS)}) x""")
def _(spark, sf):
    rest = R.rest_readings(spark, sf)
    base = S.baseline_carries(rest, "user_id").join(C.baselines(rest, "user_id", ["hr_mean"]).select("user_id", "n"), "user_id")
    return S.usable_signals(R.readings(spark, sf), base).select("id", "signal", "used", "reason")


@query("reading_masked_fusion", f"""
SELECT id, round(2 / (1 + exp(-f)) - 1, 6) AS fused FROM (SELECT id, (coalesce({CUT['hr']}, 0) + coalesce({CUT['eda']}, 0)) / nullif((CASE WHEN l_hr IS NULL THEN 0 ELSE 1 END) + (CASE WHEN l_eda IS NULL THEN 0 ELSE 1 END), 0) AS f FROM ({SCORED_SQL}) s) z""")
def _(spark, sf):
    d = R.scored_checkins(spark, sf).drop("fused", "fused_logit", "fused_p")
    mask = {s: F.lit(s in ("hr", "eda")) for s in K.SIGNALS}
    return S.fuse(d, include=mask).select("id", *r6("fused"))


@query("reading_what_if", f"""
SELECT id, round({K.MODEL_INTERCEPT['hr']!r}e0 + {K.MODEL_COEF['hr_mean']!r}e0 * (CASE WHEN source = 'camera' THEN 90 ELSE hr_mean END - mean_hr_mean) / sd_hr_mean, 6) AS logit_hr
FROM ({SCORED_SQL}) s WHERE n IS NOT NULL AND CASE WHEN source = 'camera' THEN 90 ELSE hr_mean END IS NOT NULL""")
def _(spark, sf):
    r = R.readings(spark, sf)
    edits = r.filter("source = 'camera'").select("id", F.lit(90.0).alias("hr_mean"))
    stats = C.baselines(R.rest_readings(spark, sf), "user_id", ["hr_mean"])
    z = C.zscores(S.override(r, edits, ["id"], ["hr_mean"]), stats, ["user_id"], ["hr_mean"])
    return S.score_signals(z, signals=["hr"]).filter("logit_hr IS NOT NULL").select("id", *r6("logit_hr"))


@query("reading_leading_signal", f"""
SELECT id, CASE greatest(v_hr, v_eda, v_temp, v_hrv) WHEN v_hr THEN 'hr' WHEN v_eda THEN 'eda' WHEN v_temp THEN 'temp' WHEN v_hrv THEN 'hrv' END AS lead FROM (
 SELECT id, {', '.join(f'CASE WHEN fl < 0 THEN -l_{s} ELSE l_{s} END AS v_{s}' for s in K.SIGNALS)} FROM ({SCORED_SQL}) s) z""")
def _(spark, sf):
    return R.scored_checkins(spark, sf).select("id", S.leading_signal().alias("lead"))


@query("note_level_words", f"""
SELECT id, CASE WHEN s >= 0.4e0 THEN 'stressed' WHEN s >= 0.1e0 THEN 'raised' WHEN s > -0.25e0 THEN 'borderline' WHEN s IS NOT NULL THEN 'calm' END AS level,
 CASE WHEN s >= 0.1e0 THEN 'stress' WHEN s <= -0.25e0 THEN 'calm' ELSE '' END AS tone,
 CASE WHEN s >= 0.6e0 THEN 'a strong push towards stress' WHEN s >= 0.2e0 THEN 'a push towards stress' WHEN s > -0.2e0 THEN 'close to neutral' ELSE 'reads as calm' END AS lean,
 ['Very calm', 'Calm', 'Neutral', 'Tense', 'Very tense'][1 + id % 5] AS feeling FROM (SELECT id, fused AS s FROM ({T.CHECKINS_SQL}) c) x""")
def _(spark, sf):
    f = F.col("fused")
    return T.checkins(spark, sf).select("id", W.level(f).alias("level"), W.tone(f).alias("tone"), W.lean(f).alias("lean"), W.feeling_word(F.col("feeling")).alias("feeling"))


@query("note_feeling_sentence", f"""
SELECT id, CASE WHEN fused IS NULL THEN said || '.' WHEN felt <> 0 AND felt = rd THEN said || ', which matches.' WHEN felt <> 0 AND rd <> 0 THEN said || ', but your body reads the other way. Worth noticing, not a verdict.' ELSE said || '.' END AS sentence
FROM (SELECT id, fused, 'You said you feel ' || lower(['Very calm', 'Calm', 'Neutral', 'Tense', 'Very tense'][feeling]) AS said, CASE WHEN feeling <= 2 THEN -1 WHEN feeling >= 4 THEN 1 ELSE 0 END AS felt,
 CASE WHEN fused >= 0.1e0 THEN 1 WHEN fused <= -0.25e0 THEN -1 ELSE 0 END AS rd FROM ({T.CHECKINS_SQL}) c) x""")
def _(spark, sf):
    return T.checkins(spark, sf).select("id", W.feeling_sentence(F.col("feeling"), F.col("fused")).alias("sentence"))


@query("note_signal_words", f"""
SELECT id, CAST(CAST(floor(hr_mean + 0.5e0) AS BIGINT) AS VARCHAR) || ' bpm' AS value,
 CASE WHEN mean_hr_mean IS NULL THEN NULL WHEN abs(hr_mean - mean_hr_mean) < 2 THEN 'About your resting ' || CAST(floor(mean_hr_mean + 0.5e0) AS BIGINT)
  ELSE CAST(floor(abs(hr_mean - mean_hr_mean) + 0.5e0) AS BIGINT) || CASE WHEN hr_mean > mean_hr_mean THEN ' above' ELSE ' below' END || ' your resting ' || CAST(floor(mean_hr_mean + 0.5e0) AS BIGINT) END AS vs_rest
FROM ({SCORED_SQL}) s""")
def _(spark, sf):
    d = R.scored_checkins(spark, sf).withColumn("rest_hr_mean", F.col("mean_hr_mean"))
    value, vs = W.describe_signal("hr")
    return d.select("id", value.alias("value"), vs.alias("vs_rest"))


def whole_sql(x):
    return f"CAST(CAST(floor(abs(round({x}, 9)) + 0.5e0) AS BIGINT) AS VARCHAR)"


def signed_sql(x):
    t = f"printf('%.2f', abs({x}))"
    return f"CASE WHEN CAST({t} AS DOUBLE) = 0 THEN {t} WHEN {x} < 0 THEN '−' || {t} ELSE '+' || {t} END"


def line_end_sql(s):
    x = f"(2 / (1 + exp(-l_{s})) - 1)"
    return (f"': ' || CASE WHEN {x} >= 0.6e0 THEN 'a strong push towards stress' WHEN {x} >= 0.2e0 THEN 'a push towards stress' WHEN {x} > -0.2e0 THEN 'close to neutral' "
            f"ELSE 'reads as calm' END || '{' (weak signal).' if s in K.WEAK_SIGNALS else '.'}'")


HR_GAP, EDA_GAP, RESPONSES = "(hr_mean - mean_hr_mean)", "(eda_tonic - mean_eda_tonic)", "CAST(floor(scr_count + 0.5e0) AS BIGINT)"


@query("note_signal_lines", f"""
SELECT id,
 coalesce(CASE WHEN l_hr IS NOT NULL THEN 'Heart rate ' || {whole_sql('hr_mean')} || ' bpm, ' || CASE WHEN abs({HR_GAP}) < 1.5e0 THEN 'about your resting level'
   ELSE {whole_sql(HR_GAP)} || CASE WHEN {HR_GAP} > 0 THEN ' above' ELSE ' below' END || ' rest' END || {line_end_sql('hr')} END,
  'Heart rate: too few clean beats in this window, so the pen is lifted.') AS hr_line,
 coalesce(CASE WHEN l_hrv IS NOT NULL THEN 'RMSSD ' || {whole_sql('rmssd')} || ' ms against ' || {whole_sql('mean_rmssd')} || ' at rest' || {line_end_sql('hrv')} END,
  'Heart-rate variability: too few clean beats in this window, so the pen is lifted.') AS hrv_line,
 coalesce(CASE WHEN l_eda IS NOT NULL THEN 'Skin conductance ' || CASE WHEN abs({EDA_GAP}) < 0.1e0 THEN 'near its resting level' ELSE {signed_sql(EDA_GAP)} || ' µS from rest' END || ', ' || {RESPONSES}
   || CASE WHEN {RESPONSES} = 1 THEN ' response a minute' ELSE ' responses a minute' END || {line_end_sql('eda')} END, 'Skin conductance: no reading in this window.') AS eda_line,
 coalesce(CASE WHEN l_temp IS NOT NULL THEN 'Hand temperature ' || CASE WHEN abs(temp_slope) < 0.02e0 THEN 'steady' WHEN temp_slope < 0 THEN 'cooling' ELSE 'warming' END || ' ('
   || {signed_sql('temp_slope')} || ' °C/min)' || {line_end_sql('temp')} END, 'Skin temperature: no reading in this window.') AS temp_line
FROM ({SCORED_SQL}) s""")
def _(spark, sf):
    return R.scored_checkins(spark, sf).select("id", *[W.signal_line(s).alias(f"{s}_line") for s in ("hr", "hrv", "eda", "temp")])


@query("note_texts")
def _(spark, sf):
    d = R.scored_checkins(spark, sf)
    text = W.note(F.col("source") != "manual", F.col("has_baseline"), F.col("n"), F.col("id") % 8 == 0, F.col("id") % 5 + 1, F.array(F.lit("work")))
    return d.select("id", text.alias("note"), W.signal_line("hr").alias("hr_line"), W.signal_line("hrv").alias("hrv_line"),
                    W.signal_line("eda").alias("eda_line"), W.signal_line("temp").alias("temp_line"))


@query("note_narrative", f"""
SELECT id, CASE WHEN s IS NULL THEN 'Every pen is lifted or has no reading, so there is nothing to fuse.' WHEN s > -0.25e0 AND s < 0.1e0 THEN 'Your readings are mixed, close to the line between calm and stressed.'
  WHEN s >= 0.4e0 THEN 'high' WHEN s >= 0.1e0 THEN 'raised' ELSE 'settled' END AS kind,
 CASE WHEN id % 8 = 0 AND l_hr IS NOT NULL THEN 'moving' END AS caveat FROM (SELECT *, 2 / (1 + exp(-fl)) - 1 AS s FROM ({SCORED_SQL}) q) z""")
def _(spark, sf):
    summary, caveat, _ = W.narrative(F.col("id") % 8 == 0)
    kind = (F.when(summary.contains("point to high"), "high").when(summary.contains("somewhat raised"), "raised").when(summary.contains("look settled"), "settled").otherwise(summary))
    return R.scored_checkins(spark, sf).select("id", kind.alias("kind"), F.when(caveat.isNotNull(), "moving").alias("caveat"))


@query("note_facts")
def _(spark, sf):
    d = R.scored_checkins(spark, sf)
    by = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(s).alias("k"), F.col(f"score_{s}").alias("v")) for s in K.SIGNALS]), lambda e: e["v"].isNotNull()))
    d = d.withColumn("facts", W.facts(by, F.col("hr_mean"), F.col("mean_hr_mean"), F.col("rmssd"), F.col("id") % 7, F.array(F.lit("work"), F.concat(F.lit("t"), F.col("id").cast("string")))))
    return d.select("id", W.facts_valid().alias("valid"), W.prompt(F.col("facts")).alias("prompt"))


@query("note_facts_check", """
SELECT event_id AS id, event_id % 7 BETWEEN 1 AND 5 AND 15 + value <= 250 AND 15 + value >= 20 AS valid FROM events""")
def _(spark, sf):
    e = T.table(spark, sf, "events").withColumn("fused", F.lit(0.5))
    by = F.create_map(F.lit("hr"), F.lit(0.25))
    f = F.struct(F.lit(0.5).alias("fused"), by.alias("bySignal"), (F.col("value") + 15).alias("hr"), F.lit(70.0).alias("restingHr"), F.lit(40.0).alias("rmssd"),
                 (F.col("event_id") % 7).alias("feeling"), F.array(F.lit("work")).alias("tags"), F.expr("CAST(array() AS ARRAY<STRUCT<id: STRING, change: STRING>>)").alias("activities"))
    return e.withColumn("facts", f).select(F.col("event_id").alias("id"), W.facts_valid().alias("valid"))


@query("note_text_filter", r"""
SELECT conv_id, turn, CASE WHEN length(t) BETWEEN 20 AND 600 AND NOT regexp_matches(t, '(?i)\b(as an ai|an ai\b|language model|i''m an ai|i am an ai|chatgpt|llm)\b')
  AND NOT regexp_matches(t, '[#*`]|^\s*[-•]') AND len(list_filter(string_split_regex(regexp_replace(t, '([.!?]) +', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')) <= 4 THEN t END AS accepted
FROM (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations WHERE role = 'assistant') c""")
def _(spark, sf):
    return T.table(spark, sf, "conversations").filter("role = 'assistant'").select("conv_id", "turn", W.acceptable_note(F.col("text")).alias("accepted"))


@query("note_checkin_export", f"""
SELECT strftime(created_at, '%Y-%m-%d') AS date, strftime(created_at, '%H:%M') AS time, CASE WHEN fused IS NULL THEN '' ELSE printf('%.3f', fused) END AS score,
 CASE WHEN fused >= 0.4e0 THEN 'stressed' WHEN fused >= 0.1e0 THEN 'raised' WHEN fused > -0.25e0 THEN 'borderline' WHEN fused IS NOT NULL THEN 'calm' ELSE '' END AS level,
 '' AS hr_score, '' AS hrv_score, CASE WHEN id % 3 = 0 THEN '' ELSE printf('%.1f', CAST(60 + id % 40 AS DOUBLE)) END AS heart_rate_bpm, '' AS rmssd_ms, '' AS sdnn_ms, '' AS signal_quality, 'manual' AS source,
 ['Very calm', 'Calm', 'Neutral', 'Tense', 'Very tense'][feeling] AS feeling, tag || '; x' AS tags, '' AS note FROM ({T.CHECKINS_SQL}) c""")
def _(spark, sf):
    null = lambda t: F.lit(None).cast(t)
    c = T.checkins(spark, sf).withColumns({
        "score_hr": null("double"), "score_hrv": null("double"), "hr_mean": F.when(F.col("id") % 3 != 0, 60.0 + F.col("id") % 40), "rmssd": null("double"), "sdnn": null("double"),
        "quality": null("string"), "source": null("string"), "tags": F.array("tag", F.lit("x")), "note": null("string")})
    return sinks.checkin_rows(c)


@query("note_user_documents", f"""
SELECT user_id, part, count(*) AS n, max(length(tag)) AS longest, min(id) AS first_id FROM (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY created_at, id) - 1) // 50 AS part FROM ({T.CHECKINS_SQL}) c) x GROUP BY user_id, part""")
def _(spark, sf):
    c = T.checkins(spark, sf)
    docs = sinks.user_documents(c, "user_id", ["created_at", "id"], ["id", "tag", "fused"], part_rows=50)
    back = docs.withColumn("d", F.from_json("document", "array<struct<id: bigint, tag: string, fused: double>>"))
    return back.select("user_id", "part", F.get("d.id", 0).alias("first_id"), F.size("d").cast("long").alias("n"), F.array_max(F.transform("d", lambda x: F.length(x["tag"]))).cast("long").alias("longest"))


@query("scalar_roundings", """
SELECT event_id AS id, floor((value - 30) * 10 + 0.5e0) / 10e0 AS half_up, round_even(value - 30, 1) AS half_even, tanh(value / 50 - 0.5e0) AS tanh_v,
       round(1 / (1 + exp(-(value / 20 - 1))), 6) AS sig FROM (SELECT event_id, CAST(floor(value * 4) AS BIGINT) / 4e0 AS value FROM events) e""")
def _(spark, sf):
    v = F.floor(F.col("value") * 4) / 4.0
    return T.table(spark, sf, "events").select(
        F.col("event_id").alias("id"), X.round_up(v - 30, 1).alias("half_up"), X.round_even(v - 30, 1).alias("half_even"), F.tanh(v / 50 - 0.5).alias("tanh_v"),
        F.round(X.sigmoid(v / 20 - 1), 6).alias("sig"))


@query("scalar_keys", "SELECT c_custkey, sha256(c_name) AS key FROM customer")
def _(spark, sf):
    return T.table(spark, sf, "customer").select("c_custkey", X.key_of(F.col("c_name")).alias("key"))


# opened again, 12 bytes of IV and 16 of tag longer, sealed differently for another record, and closed to it
@query("scalar_sealed_roundtrip", """
SELECT c_custkey, c_name AS opened, strlen(c_name) + 28 AS sealed_bytes, false AS same_elsewhere, false AS opens_elsewhere FROM customer""")
def _(spark, sf):
    c = T.table(spark, sf, "customer")
    key, kind = F.unhex(F.lit("000102030405060708090a0b0c0d0e0f101112131415161718191a1b1c1d1e1f")), F.lit("checkin")
    rid, other = F.col("c_custkey").cast("string"), (F.col("c_custkey") + 1).cast("string")
    iv = F.unhex(F.substring(F.sha2(rid, 256), 1, 24))
    sealed = c.withColumns({"s": X.seal(F.col("c_name"), key, iv, rid, kind), "o": X.seal(F.col("c_name"), key, iv, other, kind)})
    wrong = F.try_aes_decrypt("s", key, F.lit("GCM"), F.lit("DEFAULT"), F.concat_ws("|", other, kind))
    return sealed.select("c_custkey", X.unseal(F.col("s"), key, rid, kind).cast("string").alias("opened"), F.octet_length("s").alias("sealed_bytes"),
                         (F.col("s") == F.col("o")).alias("same_elsewhere"), wrong.isNotNull().alias("opens_elsewhere"))


@query("scalar_dates", """
SELECT event_id AS id, CAST(date_trunc('week', ts) AS DATE) AS week, CAST(ts AS DATE) AS day, dayname(ts) AS weekday FROM events""")
def _(spark, sf):
    t = F.col("ts").cast("timestamp")
    return T.table(spark, sf, "events").select(F.col("event_id").alias("id"), X.week_start(t).alias("week"), X.local_day(t).alias("day"), F.date_format("ts", "EEEE").alias("weekday"))


@query("reading_taken_today", f"""
SELECT user_id, count_if(CAST(started_at AS DATE) = DATE '2024-01-20') > 0 AS today FROM ({REST_SQL}) r GROUP BY user_id""")
def _(spark, sf):
    return S.baseline_taken_today(R.rest_readings(spark, sf), F.lit("2024-01-20 09:00:00").cast("timestamp"))


@query("reading_recent_rows", f"""
SELECT id FROM ({R.READINGS_SQL}) r JOIN (SELECT user_id, max(epoch_us(started_at) // 1000) AS e FROM ({R.READINGS_SQL}) q GROUP BY user_id) x USING (user_id)
WHERE epoch_us(started_at) // 1000 >= e - 86400000""")
def _(spark, sf):
    return S.recent(R.readings(spark, sf).withColumn("t_ms", T.millis("started_at")), ["user_id"], "t_ms", 86_400).select("id")


@query("reading_last_finished_window", """
SELECT event_id AS id, CASE WHEN event_id % 400 >= 60 THEN (event_id % 400 - 60) // 15 * 15 END AS win FROM events""")
def _(spark, sf):
    e = T.table(spark, sf, "events")
    return e.select(F.col("event_id").alias("id"), S.last_finished_window(F.col("event_id") % 400).alias("win"))


@query("note_window_documents")
def _(spark, sf):
    from pulsegrid.plans.flows import BEAT_FEATURES, beat_scores

    return sinks.window_documents(beat_scores(spark, sf), "subject", BEAT_FEATURES)
