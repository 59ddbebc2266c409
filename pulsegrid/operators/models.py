"""Logistic models: population fits, leave-one-owner-out with a nested penalty search, personal models.

All fits of one kind run at the same time (`operators.newton`): rows in blocks meet fits in tiles, shares of gradients and Hessians are
added by fit, and neither rows nor fits are gathered.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid import constants as K
from pulsegrid.functions.scalar import sigmoid, to_score
from pulsegrid.operators import newton
from pulsegrid.session import checkpointed


def _owner_counts(df: DataFrame, group: str, y: str) -> pd.DataFrame:
    return (df.groupBy(group).agg(F.count(F.when(F.col(y) == 0, 1)).alias("n0"), F.count(F.when(F.col(y) == 1, 1)).alias("n1"))
            .orderBy(group).toPandas())  # one row per owner of an evaluation set


def _balanced(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    n = n0 + n1
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.column_stack([np.where(n0 > 0, n / (2 * n0), 0.0), np.where(n1 > 0, n / (2 * n1), 0.0)])


class NestedResult:
    """Chosen penalty and coefficients per held-out owner; `inner_beta[(k, i)]` saw neither owner k nor i."""

    def __init__(self, names: list, c: np.ndarray, beta: np.ndarray, inner_beta: dict, features: list[str]):
        self.names, self.c, self.beta, self.inner_beta, self.features = names, c, beta, inner_beta, features

    def coefficients(self, spark) -> DataFrame:
        rows = [(str(n), f, float(self.beta[i, j + 1]), float(self.beta[i, 0]), float(self.c[i]))
                for i, n in enumerate(self.names) for j, f in enumerate(self.features)]
        return spark.createDataFrame(rows, "fold string, feature string, coef double, intercept double, c double")


def _numbered(df: DataFrame, owner: str, names: list) -> DataFrame:
    """With `who`, the place of the owner in `names`."""
    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([StructField("_owner", df.schema[owner].dataType), StructField("who", LongType())])
    known = df.sparkSession.createDataFrame([(n.item() if hasattr(n, "item") else n, i) for i, n in enumerate(names)], schema)
    return df.join(known, df[owner].eqNullSafe(known["_owner"])).drop("_owner")


def loo_cv_all(df: DataFrame, owner: str, y: str, signals: dict[str, list[str]], *, grid: list[float] = K.C_GRID, inner: bool = True) -> dict[str, NestedResult]:
    """Leave-one-owner-out for every signal (name: its features); for every held-out owner the penalty is chosen by an inner
    leave-one-owner-out over the others (class-balanced log loss of the pooled held-out probabilities, first minimum wins).

    For evaluation sets of up to some hundreds of owners: the number of fits is about owners² x penalties x signals. The fits of all
    signals run together. Rows with a missing feature of a signal are left out of it.
    """
    spark = df.sparkSession
    per_signal, counts = None, {}
    for s, feats in signals.items():
        rows = df.dropna(subset=feats)
        counts[s] = _owner_counts(rows, owner, y)
        part = _numbered(rows, owner, list(counts[s][owner])).select(
            F.lit(s).alias("_key"), "who", F.col(y).alias("y"), F.array(*[F.col(f).cast("double") for f in feats]).alias("x"))
        per_signal = part if per_signal is None else per_signal.unionByName(part)
    blocks = newton.Blocks(per_signal)
    kinds = "_key string, fit long, out array<long>, w array<double>, pen array<double>"

    def run(cells: list[tuple]) -> dict:
        """cells: (signal, fit, left-out owners, class weights, penalty)."""
        told = [(s, k, [int(v) for v in out], [float(v) for v in w], [float(c)] * len(signals[s])) for s, k, out, w, c in cells]
        got = newton.fit(blocks, spark.createDataFrame(told, kinds)).collect()     # a few numbers per fit
        return {(r["_key"], r["fit"]): (np.array(r["beta"]), np.array(r["held"])) for r in got}

    n = {s: (c["n0"].to_numpy(float), c["n1"].to_numpy(float)) for s, c in counts.items()}
    chosen = {s: np.full(len(c), grid[0] if len(grid) == 1 else np.nan) for s, c in counts.items()}
    inner_beta: dict = {s: {} for s in signals}
    if inner and len(grid) > 1:
        cells, of = [], {}
        for s, (n0, n1) in n.items():
            m = len(n0)
            for o in range(m):
                for i in range(m):
                    a, b = n0.sum() - n0[o] - n0[i], n1.sum() - n1[o] - n1[i]
                    if i == o or a <= 0 or b <= 0:
                        continue
                    w = _balanced(np.array([a]), np.array([b]))[0]
                    for c, value in enumerate(grid):
                        of[s, (o * m + i) * len(grid) + c] = (o, i, c)
                        cells.append((s, (o * m + i) * len(grid) + c, (o, i), w, 1.0 / value))
        fitted = run(cells)
        loss = {s: np.zeros((len(n0), len(grid), 4)) for s, (n0, _) in n.items()}
        for key, (beta, held) in fitted.items():
            o, _, c = of[key]
            loss[key[0]][o, c] += held[[0, 1, 4, 5]]
        for s in signals:
            t = loss[s]
            score = (t[:, :, 0] / np.maximum(t[:, :, 2], 1e-9) + t[:, :, 1] / np.maximum(t[:, :, 3], 1e-9)) / 2
            best = score.argmin(1)
            chosen[s] = np.array(grid)[best]
            for key, (beta, _) in fitted.items():
                o, i, c = of[key]
                if key[0] == s and c == best[o]:
                    inner_beta[s][(o, i)] = beta
    outer = []
    for s, (n0, n1) in n.items():
        w = _balanced(n0.sum() - n0, n1.sum() - n1)
        outer += [(s, k, (k,), w[k], 1.0 / chosen[s][k]) for k in range(len(n0))]
    fitted = run(outer)
    return {s: NestedResult(list(counts[s][owner]), chosen[s], np.array([fitted[s, k][0] for k in range(len(counts[s]))]).reshape(len(counts[s]), -1), inner_beta[s], feats)
            for s, feats in signals.items()}


def loo_cv(df: DataFrame, owner: str, y: str, features: list[str], *, grid: list[float] = K.C_GRID, inner: bool = True) -> NestedResult:
    """`loo_cv_all` of one signal."""
    return loo_cv_all(df, owner, y, {"": features}, grid=grid, inner=inner)[""]


def held_out_scores(df: DataFrame, owner: str, result: NestedResult, name: str = "p") -> DataFrame:
    """Add the probability of the model that did not see the row's owner: one small join and a projection."""
    coefs = _owner_arrays(df, owner, list(zip(result.names, result.beta)))
    x = F.array(*[F.col(f).cast("double") for f in result.features])
    z = F.aggregate(F.zip_with(F.slice("_b", F.lit(2), F.lit(len(result.features))), x, lambda a, v: a * v), F.get("_b", 0), lambda s, t: s + t)
    return df.join(coefs, owner, "left").withColumn(name, sigmoid(z)).drop("_b")


def stacked_scores(df: DataFrame, owner: str, y: str, results: dict[str, NestedResult]) -> DataFrame:
    """Stacked fusion: a logistic model (C = 1) on inner held-out probabilities of each signal, missing = 0.5.

    For the fold that leaves out owner k, a row of owner i gets its inputs from the models that saw neither. Every fold carries
    these coefficients (one row per owner) with its fit, and its inputs are computed inside the tasks, so that no row is
    copied per fold.
    """
    spark = df.sparkSession
    names = sorted({n for r in results.values() for n in r.names})
    index = {n: i for i, n in enumerate(names)}
    m, signals = len(names), list(results)
    feats = [r.features for r in results.values()]
    ends = np.cumsum([0, *map(len, feats)]).tolist()
    stages = list(zip(ends, ends[1:]))
    first = np.full((m, m, sum(len(f) + 1 for f in feats)), np.nan)      # fold, owner of the row, coefficients of all signals
    at = 0
    for r, f in zip(results.values(), feats):
        for (o, i), v in r.inner_beta.items():
            first[index[r.names[o]], index[r.names[i]], at:at + len(f) + 1] = v
        at += len(f) + 1
    counts = _owner_counts(df, owner, y).set_index(owner).reindex(names).fillna(0)
    n0, n1 = counts["n0"].to_numpy(float), counts["n1"].to_numpy(float)
    weights = _balanced(n0.sum() - n0, n1.sum() - n1)
    rows = _numbered(df, owner, names).select(
        F.lit("").alias("_key"), "who", F.col(y).alias("y"), F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for f in feats for c in f]).alias("x"))
    told = [("", k, [k], [float(v) for v in weights[k]], [1.0] * len(signals), [None if np.isnan(v) else float(v) for v in first[k].ravel()]) for k in range(m)]
    fits = spark.createDataFrame(told, "_key string, fit long, out array<long>, w array<double>, pen array<double>, first array<double>")
    beta = {r["fit"]: r["beta"] for r in newton.fit(newton.Blocks(rows), fits, stages=stages).collect()}    # one row per owner
    coefs = _owner_arrays(df, owner, [(n, beta[i]) for i, n in enumerate(names) if i in beta])
    out = df
    for s, r in results.items():
        out = held_out_scores(out, owner, r, f"_q_{s}")
    z = F.get("_b", 0)
    for j, s in enumerate(signals):
        z = z + F.get("_b", j + 1) * F.coalesce(F.col(f"_q_{s}"), F.lit(0.5))
    return out.join(coefs, owner, "left").withColumn("stacked_p", sigmoid(z)).drop("_b", *[f"_q_{s}" for s in signals])


def _owner_arrays(df: DataFrame, owner: str, rows: list) -> DataFrame:
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    schema = StructType([StructField(owner, df.schema[owner].dataType), StructField("_b", ArrayType(DoubleType()))])
    return df.sparkSession.createDataFrame(
        [(n.item() if hasattr(n, "item") else n, [float(x) for x in b]) for n, b in rows], schema)


def fit_population(df: DataFrame, y: str, features: list[str], c: float = 1.0):
    """One L2 logistic model on all rows with balanced class weights (pyspark.ml)."""
    n = df.agg(F.count(F.when(F.col(y) == 0, 1)).alias("a"), F.count(F.when(F.col(y) == 1, 1)).alias("b")).first()
    total = n["a"] + n["b"]
    weighted = df.withColumn("_w", F.when(F.col(y) == 1, total / (2.0 * n["b"])).otherwise(total / (2.0 * n["a"])))
    data = VectorAssembler(inputCols=features, outputCol="_x").transform(weighted.withColumn("_y", F.col(y).cast("double")))
    lr = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", regParam=1.0 / (c * total), elasticNetParam=0.0,
                            standardization=False, maxIter=200, tol=1e-10)
    return lr.fit(data)


def fit_trees(df: DataFrame, y: str, features: list[str], *, rounds: int = 150, rate: float = 0.05, depth: int = 3,
              subsample: float = 0.8, seed: int = 0):
    """Boosted trees for comparison, positive class weighted by the class ratio."""
    n = df.agg(F.count(F.when(F.col(y) == 0, 1)).alias("a"), F.count(F.when(F.col(y) == 1, 1)).alias("b")).first()
    ratio = n["a"] / max(n["b"], 1)
    data = VectorAssembler(inputCols=features, outputCol="_x").transform(
        df.withColumn("_y", F.col(y).cast("double")).withColumn("_w", F.when(F.col(y) == 1, ratio).otherwise(1.0)))
    return GBTClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", maxDepth=depth, maxIter=rounds, stepSize=rate,
                         subsamplingRate=subsample, seed=seed).fit(data)


def holdout(df: DataFrame, y: str, key: Column, share: float = 0.2, seed: int = 0) -> DataFrame:
    """Deterministic stratified split: the MD5 of seed, class and key, read in hex, decides; adds `is_test`."""
    text = F.concat_ws(":", F.lit(str(seed)), F.col(y).cast("string"), key.cast("string"))
    bucket = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % 10_000
    return df.withColumn("is_test", bucket < int(share * 10_000))


# -- personal models ----------------------------------------------------------------------------------

PERSONAL_INPUTS = max(len(f) for f in K.PERSONAL_FEATURES.values())


def train_personal(runs: DataFrame, *, l2: float = 1.0, ready_ba: float = 0.7, ready_n: int = 6, user: str = "user_id",
                   session: str = "session", block_rows: int = newton.BLOCK_ROWS) -> DataFrame:
    """One model per (user, activity) from labelled runs (columns y, activity, session, metrics).

    Features present in at least 80 % of the runs (and twice) are used, rows need all of them and both classes.
    Models are checked leaving one session out; every fit scales its inputs by its own rows. Values that are not finite count as missing.

    Coefficients are a table keyed by (user, activity, left-out session); see `operators.newton`. Scales come from sums per session, so
    that "all but one session" is a difference. Inputs are scaled once per (user, activity); the scale of a fit enters through its penalty.
    """
    from pulsegrid.operators.sessions import personal_rows

    j_all = range(PERSONAL_INPUTS)
    finite = F.transform("x", lambda v: F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v))
    rows = personal_rows(runs).select(F.struct(F.col(user), F.col("activity")).alias("_key"), F.col(session).cast("string").alias("session"), "y", finite.alias("x")).filter("x IS NOT NULL")
    have = rows.groupBy("_key").agg(F.count("*").alias("_n"), *[F.count(F.get("x", F.lit(j))).alias(f"_h{j}") for j in j_all])
    used = F.filter(F.array(*[F.when(F.col(f"_h{j}") >= F.greatest(F.lit(2.0), F.lit(0.8) * F.col("_n")), F.lit(j)) for j in j_all]), lambda j: j.isNotNull())
    data = rows.join(have.select("_key", used.alias("used")).filter(F.size("used") > 0), "_key")
    data = data.withColumn("x", F.transform("used", lambda j: F.get("x", j))).filter(F.forall("x", lambda v: v.isNotNull()))
    data = checkpointed(data)

    # count, positives, sums and squares of every session, and of all of them
    cells = [("n", F.lit(1.0)), ("p", F.col("y").cast("double")), *[(f"s{j}", F.get("x", F.lit(j))) for j in j_all], *[(f"q{j}", F.get("x", F.lit(j)) ** 2) for j in j_all]]
    per_session = data.groupBy("_key", "session").agg(F.first("used").alias("used"), *[F.coalesce(F.sum(c), F.lit(0.0)).alias(n) for n, c in cells])
    per_session = checkpointed(per_session.withColumn("who", F.monotonically_increasing_id()))
    total = per_session.groupBy("_key").agg(F.first("used").alias("used"), *[F.sum(n).alias(f"t_{n}") for n, _ in cells])
    total = total.filter((F.col("t_p") > 0) & (F.col("t_p") < F.col("t_n")))

    def scale(n: Column, s: list[Column], q: list[Column]) -> Column:
        """(mean, standard deviation) of every input; 1 where values are equal but for rounding."""
        def one(j: int) -> Column:
            mean = s[j] / n
            var = q[j] / n - mean * mean
            return F.struct(mean.alias("m"), F.when(var > 1e-12 * (1 + mean * mean), F.sqrt(var)).otherwise(1.0).alias("d"))
        return F.slice(F.array(*[one(j) for j in j_all]), F.lit(1), F.size("used"))

    total = checkpointed(total.withColumn("all", scale(F.col("t_n"), [F.col(f"t_s{j}") for j in j_all], [F.col(f"t_q{j}") for j in j_all])))
    ready = (data.drop("used").join(total.select("_key", "all"), "_key")
             .join(per_session.select(F.col("_key").alias("_k"), F.col("session").alias("_s"), "who"), (F.col("_key") == F.col("_k")) & F.col("session").eqNullSafe(F.col("_s"))))
    scaled = ready.select("_key", "who", "y", F.zip_with("x", "all", lambda v, a: (v - a["m"]) / a["d"]).alias("x"))

    rest = lambda n: F.col(f"t_{n}") - F.col(n)
    without = per_session.drop("used").join(total, "_key").filter((rest("p") > 0) & (rest("p") < rest("n")))
    own = scale(rest("n"), [rest(f"s{j}") for j in j_all], [rest(f"q{j}") for j in j_all])
    one = F.array(F.lit(1.0), F.lit(1.0))
    penalty = F.zip_with("own", "all", lambda o, a: F.lit(float(l2)) * (o["d"] / a["d"]) ** 2)
    fits = without.withColumn("own", own).select("_key", F.col("who").alias("fit"), F.array("who").alias("out"), one.alias("w"), penalty.alias("pen"))
    fits = fits.unionByName(total.select("_key", F.lit(-1).cast("long").alias("fit"), F.array().cast("array<bigint>").alias("out"), one.alias("w"),
                                         F.transform("all", lambda a: F.lit(float(l2))).alias("pen")))
    got = checkpointed(newton.fit(newton.Blocks(scaled, block_rows), fits, steps=50))

    checked = got.filter("fit >= 0").groupBy("_key").agg(*[F.sum(F.get("held", F.lit(i))).alias(f"c{i}") for i in range(2, 6)])
    share = (F.col("c2") / F.col("c4") + F.col("c3") / F.col("c5")) / 2
    m = got.filter("fit = -1").join(total.select("_key", "used", "all"), "_key").join(checked, "_key", "left")
    names = F.create_map(*[c for a, f in K.PERSONAL_FEATURES.items() for c in (F.lit(a), F.array(*map(F.lit, f)))])
    coef = F.zip_with(F.slice("beta", F.lit(2), F.size("all")), "all", lambda b, a: b / a["d"])
    m = m.withColumn("coef", coef).withColumn("balanced_accuracy", F.when((F.col("c4") > 0) & (F.col("c5") > 0), F.floor(share * 1000 + 0.5) / 1000).otherwise(0.0))
    m = m.withColumn("n_held_out", F.coalesce(F.col("c4") + F.col("c5"), F.lit(0.0)).cast("long"))
    shift = F.aggregate(F.zip_with("coef", "all", lambda c, a: c * a["m"]), F.lit(0.0), lambda s, v: s + v)
    return m.select(F.col(f"_key.{user}").alias(user), F.col("_key.activity").alias("activity"),
                    F.transform("used", lambda j: F.get(F.element_at(names, F.col("_key.activity")), j)).alias("features"), "coef",
                    (F.get("beta", F.lit(0)) - shift).alias("intercept"), F.col("balanced_accuracy").cast("double").alias("balanced_accuracy"), "n_held_out",
                    ((F.col("n_held_out") >= ready_n) & (F.col("balanced_accuracy") >= ready_ba)).alias("ready"))


def score_personal(models: DataFrame, runs: DataFrame, user: str = "user_id") -> DataFrame:
    """Score runs with their owner's model; NULL when a model feature is missing."""
    z = F.aggregate(
        F.arrays_zip(F.col("features").alias("f"), F.col("coef").alias("c")), F.col("intercept"),
        lambda s, t: s + t["c"] * F.try_element_at("metrics", t["f"]))
    return (runs.join(models.select(user, "activity", "features", "coef", "intercept"), [user, "activity"], "left")
            .withColumn("score", to_score(sigmoid(z))).drop("features", "coef", "intercept"))
