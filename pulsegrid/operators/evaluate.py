"""Evaluation of scores: accuracy, ranking, agreement, condition summaries, validation against a reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid import constants as K
from pulsegrid.functions.scalar import to_score
from pulsegrid.operators.ordered import BLOCK_ROWS, Ordered, grouped_quantiles, largest_group


def _n(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def auc(df: DataFrame, by: list[str], y: str, p: str, **ordered) -> DataFrame:
    """Area under the ROC curve per group, ties counted half; NULL with a single class.

    Rows are first counted per (group, score), so the ordered part runs over distinct scores and a hot
    group never reaches one task as rows.
    """
    d = df.filter(F.col(p).isNotNull() & F.col(y).isNotNull())
    if not by:
        d, by = d.withColumn("_all", F.lit(1)), ["_all"]
        return auc(d, by, y, p, **ordered).drop("_all")
    if "bounded" not in ordered and largest_group(d, by) <= ordered.get("block_rows", BLOCK_ROWS):
        ordered["bounded"] = True  # distinct scores cannot outnumber rows
    cells = d.groupBy(*by, p).agg(_n(F.col(y) == 1).alias("_pos"), _n(F.col(y) == 0).alias("_neg"))
    o = Ordered(cells, by, [p], **ordered).running({"_below": ("sum", F.col("_neg"))}, current=False)
    below = F.coalesce(F.col("_below"), F.lit(0))
    u = F.sum(F.col("_pos") * (below + F.col("_neg") * 0.5))
    return o.rows.groupBy(*by).agg(
        F.try_divide(u, F.sum("_pos").cast("double") * F.sum("_neg")).alias("roc_auc"))


def binary_metrics(df: DataFrame, by: list[str], y: str, p: str, **ordered) -> DataFrame:
    """n, n_pos, n_neg, balanced accuracy, macro F1 and AUC per group."""
    d = df.filter(F.col(p).isNotNull())
    flag = F.col(p) >= 0.5
    pos, neg = F.col(y) == 1, F.col(y) == 0
    agg = d.groupBy(*by).agg(
        F.count("*").alias("n"), _n(pos).alias("n_pos"), _n(neg).alias("n_neg"),
        _n(pos & flag).alias("_tp"), _n(neg & flag).alias("_fp"),
        _n(pos & ~flag).alias("_fn"), _n(neg & ~flag).alias("_tn"))
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    f1 = F.coalesce(F.try_divide(F.col("_tp") * 2, F.col("_tp") * 2 + F.col("_fp") + F.col("_fn")), F.lit(0.0))
    f0 = F.coalesce(F.try_divide(F.col("_tn") * 2, F.col("_tn") * 2 + F.col("_fp") + F.col("_fn")), F.lit(0.0))
    half = (F.try_divide(F.col("_tp"), F.col("n_pos")) + F.try_divide(F.col("_tn"), F.col("n_neg"))) / 2
    out = agg.select(*by, "n", "n_pos", "n_neg", F.when(both, half).alias("balanced_accuracy"),
                     ((f1 + f0) / 2).alias("macro_f1"))
    ranked = auc(d, by, y, p, **ordered)
    return out.join(ranked, by, "left") if by else out.crossJoin(ranked)


def summarise(metrics: DataFrame, by: list[str], names: tuple[str, ...] = ("balanced_accuracy", "macro_f1", "roc_auc")
              ) -> DataFrame:
    """Mean, population SD and count of each metric over owners, as rows."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in names])
    return (metrics.select(*by, F.inline(cells)).groupBy(*by, "metric")
            .agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.count("value").alias("n_owners")))


def by_condition(df: DataFrame, condition: str, p: str, by: list[str] = []) -> DataFrame:
    """Rows, mean score and share flagged per condition."""
    d = df.filter(F.col(p).isNotNull())
    return d.groupBy(*by, condition).agg(
        F.count("*").alias("n"), F.avg(to_score(F.col(p))).alias("mean_score"),
        F.avg((F.col(p) >= 0.5).cast("double")).alias("frac_flagged"))


def balanced_log_loss(df: DataFrame, by: list[str], y: str, p: str) -> DataFrame:
    """Log loss with both classes weighted the same: the mean of the two class means."""
    q = F.least(F.greatest(F.col(p), F.lit(K.P_CLIP)), F.lit(1 - K.P_CLIP))
    d = df.filter(F.col(p).isNotNull())
    agg = d.groupBy(*by).agg(
        F.avg(F.when(F.col(y) == 1, -F.log(q))).alias("_l1"), F.avg(F.when(F.col(y) == 0, -F.log(1 - q))).alias("_l0"))
    both = (F.col("_l1") + F.col("_l0")) / 2
    return agg.select(*by, F.coalesce(both, "_l1", "_l0").alias("loss"))


def class_weights(df: DataFrame, by: list[str], y: str) -> DataFrame:
    """Negative/positive ratio and balanced weights n / (2 n_class)."""
    agg = df.groupBy(*by).agg(F.count("*").alias("n"), _n(F.col(y) == 1).alias("n_pos"), _n(F.col(y) == 0).alias("n_neg"))
    return agg.select(*by, F.try_divide("n_neg", "n_pos").alias("pos_ratio"),
                      F.try_divide(F.col("n"), F.col("n_pos") * 2).alias("w_pos"),
                      F.try_divide(F.col("n"), F.col("n_neg") * 2).alias("w_neg"))


def classification_report(df: DataFrame, y: str, p: str, by: list[str] = []) -> DataFrame:
    """Precision, recall, F1 and support per class, and accuracy, macro and weighted averages, as rows."""
    flag = F.when(F.col(p) >= 0.5, 1).otherwise(0)
    agg = df.groupBy(*by).agg(*[
        _n((F.col(y) == a) & (flag == b)).alias(f"_n{a}{b}") for a in (0, 1) for b in (0, 1)])

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    parts = {}
    for c in (0, 1):
        tp, fp, fn = F.col(f"_n{c}{c}"), F.col(f"_n{1 - c}{c}"), F.col(f"_n{c}{1 - c}")
        parts[c] = (ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tp * 2, tp * 2 + fp + fn), tp + fn)
    total = parts[0][3] + parts[1][3]

    def row(name, pr, re, f1, sup):
        return F.struct(F.lit(name).alias("class"), pr.alias("precision"), re.alias("recall"), f1.alias("f1"),
                        sup.alias("support"))

    acc = ratio(F.col("_n00") + F.col("_n11"), total)
    rows = [row(str(c), *parts[c]) for c in (0, 1)]
    rows.append(row("accuracy", acc, acc, acc, total))
    rows.append(row("macro avg", *[(parts[0][i] + parts[1][i]) / 2 for i in range(3)], total))
    rows.append(row("weighted avg", *[ratio(parts[0][i] * parts[0][3] + parts[1][i] * parts[1][3], total)
                                      for i in range(3)], total))
    return agg.select(*by, F.inline(F.array(*rows)))


def owner_condition_counts(df: DataFrame, owner: str, condition: str, labels: dict[int, str] = K.CONDITIONS) -> DataFrame:
    """Rows per owner and condition, one column per condition. The columns are known, so nothing is collected."""
    return df.groupBy(owner).agg(*[_n(F.col(condition) == k).alias(v) for k, v in labels.items()])


def below_chance(metrics: DataFrame, owner: str, by: list[str] = []) -> DataFrame:
    """Owners whose AUC is under 0.5, sorted."""
    return metrics.filter("roc_auc < 0.5").select(*by, owner, "roc_auc").orderBy(*by, owner)


def validate_pairs(df: DataFrame, owner: str, condition: str, device: str, reference: str, valid: str,
                   within: float = 5.0) -> DataFrame:
    """Device against reference per owner and condition, per owner, per condition and overall.

    One pass with grouping sets; the exact median of the reference is joined from value counts.
    """
    hit = F.col(valid) & F.col(device).isNotNull() & F.col(reference).isNotNull()
    d = df.select(F.col(owner).alias("owner"), F.col(condition).alias("condition"), F.col(valid).alias("valid"),
                  F.col(reference).cast("double").alias("ref"),
                  F.when(hit, F.col(device).cast("double")).alias("dev"))
    sets = [["owner", "condition"], ["owner"], ["condition"], []]
    err = F.when(F.col("dev").isNotNull(), F.abs(F.col("dev") - F.col("ref")))
    # groupingSets returns the grouping columns as nullable; the level tells them apart
    agg = d.groupingSets([[F.col(c) for c in s] for s in sets], F.col("owner"), F.col("condition")).agg(
        F.grouping_id().alias("level"), F.count("*").alias("n"), F.avg(F.col("valid").cast("double")).alias("valid_frac"),
        F.avg(err).alias("mae"), F.avg((err <= within).cast("double")).alias("within"),
        F.corr("dev", F.when(F.col("dev").isNotNull(), F.col("ref"))).alias("r"))
    levels = F.array(*[F.struct(
        F.lit(i).alias("level"), (F.col("owner") if "owner" in s else F.lit(None)).alias("o"),
        (F.col("condition") if "condition" in s else F.lit(None)).alias("c")) for s, i in zip(sets, (0, 1, 2, 3))])
    # every value takes part in four levels; grouped_quantiles counts equal values before the shuffle
    spread = d.filter("ref IS NOT NULL").select("ref", F.inline(levels))
    med = grouped_quantiles(spread, ["level", "o", "c"], "ref", {"median_ref": ("linear", 0.5)})
    cond = (agg["level"] == med["level"]) & agg["owner"].eqNullSafe(med["o"]) & agg["condition"].eqNullSafe(med["c"])
    return agg.join(med, cond, "left").select(
        agg["level"], agg["owner"], agg["condition"], "n", "valid_frac", "mae", "within", "r", "median_ref")


def paired_check(df: DataFrame, by: list[str], device: str, reference: str, quality: str) -> DataFrame:
    """Mean error, bias and error of good readings, with a verdict that needs five good pairs within 5 bpm."""
    diff = F.col(device) - F.col(reference)
    good = F.col(quality) == "good"
    agg = df.groupBy(*by).agg(
        F.count(diff).alias("n"), F.avg(F.abs(diff)).alias("mae"), F.avg(diff).alias("bias"),
        _n(good & diff.isNotNull()).alias("n_good"), F.avg(F.when(good, F.abs(diff))).alias("mae_good"))
    verdict = F.when(F.col("n_good") < 5, "more").when(F.col("mae_good") <= 5, "pass").otherwise("fail")
    return agg.withColumn("verdict", verdict)


def sign_agreement(coefs: DataFrame, by: list[str], feature: str = "feature", coef: str = "coef") -> DataFrame:
    """Share of folds whose coefficient has the expected sign."""
    want = F.create_map(*[x for f, s in K.EXPECTED_SIGN.items() for x in (F.lit(f), F.lit(float(s)))])
    return coefs.groupBy(*by, feature).agg(
        F.avg((F.signum(coef) == want[F.col(feature)]).cast("double")).alias("sign_match"),
        F.count("*").alias("n_folds"))


def motion_report(df: DataFrame, owner: str, condition: str, motion: str, y: str, hrv_valid: str, hr_valid: str,
                  coverage: str) -> DataFrame:
    """How movement relates to the label and to signal validity, as (measure, grp, value) rows."""
    m = F.col(motion)
    cond = F.col(condition).cast("string")
    per_owner = auc(df, [owner], y, motion)
    one = per_owner.agg(F.avg("roc_auc").alias("value")).select(F.lit("auc_mean").alias("measure"), F.lit("all").alias("grp"), "value")
    rows = [per_owner.select(F.lit("auc_owner").alias("measure"), F.col(owner).cast("string").alias("grp"),
                             F.col("roc_auc").alias("value")), one,
            auc(df, [], y, motion).select(F.lit("auc_pooled").alias("measure"), F.lit("all").alias("grp"),
                                          F.col("roc_auc").alias("value"))]
    flat = df.agg(F.corr(m, F.col(y).cast("double")).alias("r_label"),
                  F.corr(m, F.col(coverage).cast("double")).alias("r_coverage"))
    rows.append(flat.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("measure"), F.lit("all").alias("grp"), F.col(c).alias("value")) for c in ("r_label", "r_coverage")]))))
    by_c = df.groupBy(cond.alias("grp")).agg(
        F.avg(m).alias("mean"), F.avg(F.col(hrv_valid).cast("double")).alias("hrv_valid_frac"),
        F.avg(F.col(hr_valid).cast("double")).alias("hr_valid_frac"))
    rows.append(by_c.select(F.col("grp"), F.inline(F.array(*[F.struct(
        F.lit(c).alias("measure"), F.col(c).alias("value")) for c in ("mean", "hrv_valid_frac", "hr_valid_frac")])))
        .select("measure", "grp", "value"))
    med = grouped_quantiles(df.select(cond.alias("grp"), m.alias("v")), ["grp"], "v", {"value": ("linear", 0.5)})
    rows.append(med.select(F.lit("median").alias("measure"), "grp", "value"))
    val = df.select(F.when(F.col(hrv_valid), "valid").otherwise("invalid").alias("grp"), m.alias("v"))
    rows.append(grouped_quantiles(val, ["grp"], "v", {"value": ("linear", 0.5)})
                .select(F.lit("median_hrv").alias("measure"), "grp", "value"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def histogram(df: DataFrame, by: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """Density per class over equal bins; the top edge belongs to the last bin."""
    width = (high - low) / bins
    v = F.col(value)
    b = F.least(F.floor((v - low) / F.lit(width)), F.lit(bins - 1))
    inside = df.filter(v.between(low, high)).groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"))
    total = inside.groupBy(*by).agg(F.sum("n").alias("_total"))
    return inside.join(total, by).select(
        *by, "bin", "n", (F.col("n") / (F.col("_total") * F.lit(width))).alias("density"))
