"""Thresholds, model constants and names that results must agree on."""

# Windows
WINDOW_S = 60
STRIDE_S = 15
MIN_LABEL_SHARE = 0.8
KEPT_LABELS = (1, 2, 3)
CONDITIONS = {1: "baseline", 2: "stress", 3: "amusement"}
REST_S = 300

# Beat cleaning on live and imported intervals (milliseconds)
RR_LOW_MS = 300
RR_HIGH_MS = 2000
RR_MAX_DEVIATION = 0.2
RR_NEIGHBOURS = 5
HR_COVERAGE = 0.4
HRV_COVERAGE = 0.6
HRV_PAIRS = 10
MIN_CLEAN_BEATS = 10

# Beat cleaning in the training recordings (seconds)
IBI_LOW_S = 0.33
IBI_HIGH_S = 1.5
IBI_MAX_CHANGE = 0.25
IBI_MAX_FROM_MEDIAN = 0.30

# Skin conductance
SCR_MIN_US = 0.02
EDA_HZ = 4
PULSE_HZ = 64
ACC_UNITS_PER_G = 64.0

# Motion flags
MOTION_Z = 3.0
MOTION_WRIST_G = 0.075
MOTION_CHEST_G = 0.08
MOTION_SHARE = 0.1

# Signals in display order, with their model features
SIGNAL_FEATURES = {
    "hr": ["hr_mean"],
    "eda": ["eda_tonic", "eda_slope", "scr_count", "scr_amp"],
    "temp": ["temp_mean", "temp_slope"],
    "hrv": ["rmssd", "sdnn"],
}
SIGNALS = ["hr", "eda", "temp", "hrv"]
MODEL_FEATURES = [f for s in SIGNALS for f in SIGNAL_FEATURES[s]]
ALL_FEATURES = ["hr_mean", "rmssd", "sdnn", "eda_tonic", "eda_slope", "scr_count", "scr_amp",
                "temp_mean", "temp_slope", "pnn50", "acc_std"]

# Smallest spread used when calibrating, per feature
SD_FLOOR = {
    "hr_mean": 1.0, "rmssd": 3.0, "sdnn": 3.0, "pnn50": 2.0,
    "eda_tonic": 0.05, "eda_slope": 0.02, "scr_count": 0.5, "scr_amp": 0.01,
    "temp_mean": 0.05, "temp_slope": 0.02, "acc_std": 0.005,
}

# Direction in which stress is expected to move each feature
EXPECTED_SIGN = {
    "hr_mean": 1, "rmssd": -1, "sdnn": -1, "pnn50": -1,
    "eda_tonic": 1, "eda_slope": 1, "scr_count": 1, "scr_amp": 1,
    "temp_mean": -1, "temp_slope": -1,
}

# Published signal models: intercept and one coefficient per calibrated feature
MODEL_INTERCEPT = {
    "hr": -1.3159280622486673,
    "hrv": -0.11782534738686282,
    "eda": -1.123548295367242,
    "temp": -0.28045152504069293,
}
MODEL_COEF = {
    "hr_mean": 0.4196936956301051,
    "rmssd": -0.05842185632280847,
    "sdnn": -0.07182363412459139,
    "eda_tonic": 0.17312547319722596,
    "eda_slope": 0.16961898880443452,
    "scr_count": 0.29795051255554483,
    "scr_amp": 0.14501865612472625,
    "temp_mean": -0.030019551226534127,
    "temp_slope": -0.18930930603332446,
}
WEAK_SIGNALS = ("hrv", "temp")

# Grid of inverse penalties for the per-signal models
C_GRID = [0.0001, 0.0003, 0.001, 0.003, 0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0]
P_CLIP = 1e-6

# Personal baseline
BASELINE_DAYS = 3
FEELINGS = ["Very calm", "Calm", "Neutral", "Tense", "Very tense"]

# Personal activity models
PERSONAL_FEATURES = {
    "typing": ["interKeyMeanMs", "interKeyCv", "errorRate", "corrections"],
    "follow-dot": ["meanErrorPct", "jerk", "overCorrectionsPerMin"],
    "target-taps": ["timeToTapMs", "accuracyPct", "errorRadii"],
    "stroop": ["rtIncongruentMs", "interferenceMs", "errorRate"],
    "beat-the-clock": ["meanRtMs", "accuracy"],
    "paced-breathing": ["rsaBpm", "hrChange"],
    "steady-hand": ["rms", "bandShare"],
    "tap-rhythm": ["asyncSdMs", "intervalCv"],
}
ACTIVITIES = list(PERSONAL_FEATURES)

# Headline metrics: (activity, key, label, word when higher, word when lower), in display order
HEADLINE = [
    ("typing", "wpm", "Typing speed", "faster", "slower"),
    ("typing", "holdMeanMs", "Key hold", "longer holds", "shorter holds"),
    ("typing", "interKeyCv", "Rhythm unevenness", "more uneven", "more even"),
    ("typing", "corrections", "Corrections", "more corrections", "fewer corrections"),
    ("follow-dot", "meanErrorPct", "Distance off the dot", "further off", "closer"),
    ("follow-dot", "onTargetPct", "Time on the dot", "more time on", "less time on"),
    ("follow-dot", "overCorrectionsPerMin", "Over-corrections", "more over-correcting", "less over-correcting"),
    ("target-taps", "accuracyPct", "Hits", "more accurate", "less accurate"),
    ("target-taps", "timeToTapMs", "Time to tap", "slower", "quicker"),
    ("target-taps", "hesitationMs", "Pause before clicking", "more hesitant", "less hesitant"),
    ("target-taps", "overshootPct", "Overshoots", "more overshooting", "less overshooting"),
    ("stroop", "rtCongruentMs", "Matching words", "slower", "quicker"),
    ("stroop", "rtIncongruentMs", "Mismatched words", "slower", "quicker"),
    ("stroop", "interferenceMs", "Slowdown from the mismatch", "more thrown by the mismatch",
     "less thrown by the mismatch"),
    ("stroop", "errorRate", "Errors", "more errors", "fewer errors"),
    ("beat-the-clock", "problems", "Problems answered", "more answered", "fewer answered"),
    ("beat-the-clock", "accuracy", "Right", "more right", "fewer right"),
    ("beat-the-clock", "meanLevel", "Average level", "harder level", "easier level"),
    ("beat-the-clock", "meanRtMs", "Time per right answer", "slower", "quicker"),
    ("paced-breathing", "breaths", "Guided breaths", "more breaths", "fewer breaths"),
    ("paced-breathing", "rsaBpm", "Heart-rate swing per breath", "bigger swing", "smaller swing"),
    ("paced-breathing", "hrChange", "Heart rate, start to end", "rose more", "fell more"),
    ("steady-hand", "rms", "Tremor", "shakier", "steadier"),
    ("steady-hand", "peakHz", "Main tremor frequency", "faster tremor", "slower tremor"),
    ("tap-rhythm", "asyncMeanMs", "Timing against the beat", "later", "earlier"),
    ("tap-rhythm", "intervalCv", "Tap unevenness", "more uneven", "more even"),
    ("tap-rhythm", "driftMsPerTap", "Drift on your own", "slowing down", "speeding up"),
]

# Record store
RECORD_PAGE = 500
MAX_RECORD_BYTES = 64 * 1024
MAX_RECORDS = 5000
MAX_USER_BYTES = 5 * 1024 * 1024
TOMBSTONE_DAYS = 90
SIGNUPS_PER_HOUR = 20
NOTES_PER_HOUR = 10

# Imports
IMPORT_DAYS = 90
IMPORT_ROWS = 20000
