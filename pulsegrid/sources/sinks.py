"""Result tables and documents."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pulsegrid import constants as K
from pulsegrid.functions.scalar import round_even, round_significant
from pulsegrid.functions.text import feeling_word, level
from pulsegrid.operators.ordered import Ordered

CHECKIN_COLUMNS = ["date", "time", "score", "level", "hr_score", "hrv_score", "heart_rate_bpm", "rmssd_ms", "sdnn_ms",
                   "signal_quality", "source", "feeling", "tags", "note"]


def checkin_rows(checkins: DataFrame) -> DataFrame:
    """The 14 text columns of the check-in export, in time order. Missing values are empty."""
    fmt = lambda c, d: F.coalesce(F.format_string(f"%.{d}f", F.col(c).cast("double")), F.lit("")) if d is not None else F.col(c)
    num = lambda c, d: F.when(F.col(c).isNull(), "").otherwise(fmt(c, d))
    return checkins.orderBy("created_at", "id").select(
        F.date_format("created_at", "yyyy-MM-dd").alias("date"), F.date_format("created_at", "HH:mm").alias("time"), num("fused", 3).alias("score"),
        F.coalesce(level(F.col("fused")), F.lit("")).alias("level"), num("score_hr", 3).alias("hr_score"), num("score_hrv", 3).alias("hrv_score"),
        num("hr_mean", 1).alias("heart_rate_bpm"), num("rmssd", 1).alias("rmssd_ms"), num("sdnn", 1).alias("sdnn_ms"),
        F.coalesce("quality", F.lit("")).alias("signal_quality"), F.coalesce("source", F.lit("manual")).alias("source"),
        F.coalesce(feeling_word(F.col("feeling")), F.lit("")).alias("feeling"), F.array_join("tags", "; ").alias("tags"), F.coalesce("note", F.lit("")).alias("note"))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header; quotes are doubled, fields are quoted where needed, times keep their microseconds."""
    w = df.write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", "")
    w.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path)


def read_features_csv(spark, path: str, schema: str) -> DataFrame:
    """A feature table back from CSV, typed by its schema; empty cells are NULL."""
    return spark.read.option("header", True).schema(schema).csv(path)


def write_partitioned(df: DataFrame, path: str, by: list[str], mode: str = "append") -> None:
    df.write.mode(mode).partitionBy(*by).parquet(path)


IMPORT = ["import_id", "source", "file", "imported_at"]


def write_import(rows: DataFrame, folder: str, import_id: str, source: str, file: str, imported_at: str) -> None:
    """One import batch: its rows with import id, source, file and time (ISO text), below a folder whose name is made of these four.
    The same import written again, also after a failure half-way, replaces itself; others are not touched."""
    told = dict(zip(IMPORT, (import_id, source, file, imported_at)))
    name = hashlib.sha256("\n".join(told.values()).encode()).hexdigest()[:32]
    rows.withColumns({k: F.lit(v) for k, v in told.items()}).write.mode("overwrite").parquet(f"{folder}/batch={name}")


def read_imports(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Rows of all import batches of a folder. schema: of the rows that were given."""
    whole = StructType([*schema.fields, *[StructField(c, StringType()) for c in IMPORT]])
    return spark.read.schema(whole).parquet(folder).drop("batch").withColumn("imported_at", F.col("imported_at").cast("timestamp"))


def user_documents(rows: DataFrame, user: str, order: list[str], fields: list[str], part_rows: int = 10_000, **ordered) -> DataFrame:
    """JSON documents of a user's rows in order: (user, part, document), each part of at most `part_rows` rows.

    Most users have one part; a user with very many rows has more of them instead of one huge document.
    """
    d = Ordered(rows, [user], order, **ordered).number("_n").rows.withColumn("part", F.floor((F.col("_n") - 1) / F.lit(float(part_rows))))
    cells = F.sort_array(F.collect_list(F.struct(F.col("_n"), F.struct(*fields).alias("_r"))))
    return d.groupBy(user, "part").agg(F.to_json(F.transform(cells, lambda c: c["_r"])).alias("document"))


def export_rows(records: DataFrame, user: str = "user_id") -> DataFrame:
    """Live records in log order per user, for write.json partitioned by user; sorted by range, not in one task."""
    return records.filter(~F.col("deleted")).repartitionByRange(user, "seq").sortWithinPartitions(user, "seq")


def metric_rows(metrics: DataFrame, mode: str, model: str) -> DataFrame:
    """Rows of the per-owner metric table."""
    return metrics.select(F.lit(mode).alias("mode"), F.lit(model).alias("model"), F.col("owner").cast("string").alias("subject"), "n",
                          F.col("n_pos").alias("n_stress"), "balanced_accuracy", "macro_f1", "roc_auc")


def owner_order(df: DataFrame, owner: str) -> DataFrame:
    """Sorted by the number after the owner's letter prefix."""
    return df.orderBy(F.regexp_extract(owner, r"(\d+)$", 1).try_cast("int"), owner)


def model_constants(coefs: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """Model constants for small clients: one JSON per signal with rounded metrics and full coefficients."""
    cells = F.sort_array(F.collect_list(F.struct("rank", "feature", "coef", "sd_floor")))
    out = coefs.groupBy("signal").agg(F.first("intercept").alias("intercept"), F.transform(cells, lambda c: F.struct(
        c["feature"].alias("name"), c["sd_floor"].alias("sd_floor"), c["coef"].alias("coef"))).alias("features"))
    if metrics is not None:
        out = out.join(metrics.select("signal", F.struct(*[round_even(F.col(c), 4).alias(c) for c in metrics.columns if c != "signal"]).alias("loso")), "signal", "left")
    return out.select("signal", F.to_json(F.struct(*[c for c in out.columns if c != "signal"])).alias("document"))


def rounded_constants(df: DataFrame, columns: list[str], digits: int = 5) -> DataFrame:
    return df.withColumns({c: round_significant(F.col(c), digits) for c in columns})


def window_documents(windows: DataFrame, owner: str, features: list[str]) -> DataFrame:
    """One row per scored window as JSON: raw and calibrated features, validity, motion flag, scores."""
    r4 = lambda c: round_even(F.col(c), 4)
    named = lambda p: F.struct(*[r4(f"{p}{f}").alias(f) for f in features])
    flag = F.coalesce(F.col("z_acc_std") > K.MOTION_Z, F.lit(False)) if "z_acc_std" in windows.columns else F.lit(False)
    scores = [c for c in windows.columns if c.startswith("score_") or c == "fused"]
    doc = F.struct(F.col("win_start").alias("t_start"), F.col("label").alias("condition"), named("").alias("features"), named("z_").alias("calibrated"),
                   flag.alias("motion_flag"), F.struct(*[r4(c).alias(c) for c in scores]).alias("scores"))
    return windows.select(owner, "win_start", F.to_json(doc).alias("document"))


def paired_log(pairs: DataFrame) -> DataFrame:
    return pairs.select("time", "condition", "kind", "ref", "device", (F.col("device") - F.col("ref")).alias("error"), "quality")
