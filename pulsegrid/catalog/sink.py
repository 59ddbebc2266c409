"""Result sinks, written below the shared folder and read back, and small rules that sinks and reports use."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pulsegrid.catalog import query
from pulsegrid.catalog.beat import r6
from pulsegrid.functions import scalar as X
from pulsegrid.operators import score as SC
from pulsegrid.operators import signals as S
from pulsegrid.plans import tables as T
from pulsegrid.session import new_folder
from pulsegrid.sources import sinks


@query("sink_import_batches", """
SELECT 'imp-' || event_type AS import_id, CASE WHEN event_type IN ('click', 'view') THEN 'import-apple' ELSE 'import-fitbit' END AS source, event_type || '.zip' AS file,
       make_timestamp(2024, 5, 1, 8, 0, 0) AS imported_at, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY event_type""")
def _(spark, sf):
    e = T.table(spark, sf, "events").select("event_id", "value", "event_type")
    folder = new_folder(spark, "imports")
    kinds = sorted(r[0] for r in e.select("event_type").distinct().collect())
    for k in [*kinds, *kinds[:2]]:      # two imports come twice
        source = "import-apple" if k in ("click", "view") else "import-fitbit"
        sinks.write_import(e.filter(F.col("event_type") == k).drop("event_type"), folder, f"imp-{k}", source, f"{k}.zip", "2024-05-01T08:00:00")
    back = sinks.read_imports(spark, folder, e.drop("event_type").schema)
    return back.withColumn("imported_at", F.col("imported_at").cast("timestamp_ntz")).groupBy(*sinks.IMPORT).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("sink_user_export", f"SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS place, id, seq, bytes, version FROM ({T.RECORD_TABLE_SQL}) t WHERE NOT deleted")
def _(spark, sf):
    """One file per user with its live records in log order."""
    folder = new_folder(spark, "export")
    sinks.export_rows(T.record_table(spark, sf)).select("user_id", "id", "seq", "bytes", "version").write.partitionBy("user_id").json(folder)
    from pulsegrid.sources.exports import numbered_lines

    lines = numbered_lines(spark, f"{folder}/*/*.json")
    row = F.from_json("value", "id long, seq long, bytes long, version long")
    # a user at the edge of two ranges has two files, in order by their names
    before = Window.partitionBy("user_id").orderBy("file", "line")
    d = lines.select(F.regexp_extract("file", r"user_id=(\d+)/", 1).cast("long").alias("user_id"), "file", "line", row.alias("r"))
    return d.select("user_id", F.row_number().over(before).cast("long").alias("place"), "r.*")


PAIRS_SQL = "SELECT ts AS time, event_type AS condition, 'hr' AS kind, 60 + value AS ref, 60 + value + event_id % 7 - 3 AS device, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'good' END AS quality FROM events"


@query("sink_paired_log", f"SELECT time, condition, kind, round(ref, 6) AS ref, round(device, 6) AS device, round(device - ref, 6) AS error, quality FROM ({PAIRS_SQL}) p")
def _(spark, sf):
    e = F.col("event_id")
    pairs = T.table(spark, sf, "events").select(F.col("ts").alias("time"), F.col("event_type").alias("condition"), F.lit("hr").alias("kind"), (60 + F.col("value")).alias("ref"),
                                                (60 + F.col("value") + e % 7 - 3).alias("device"), F.when(e % 5 != 0, "good").alias("quality"))
    folder = new_folder(spark, "pairs")
    sinks.write_csv(sinks.paired_log(pairs), folder)
    back = sinks.read_features_csv(spark, folder, "time timestamp_ntz, condition string, kind string, ref double, device double, error double, quality string")
    return back.select("time", "condition", "kind", *r6("ref", "device", "error"), "quality")


@query("scalar_significant", """
SELECT event_id, CASE WHEN x = 0 THEN 0e0 ELSE round_even(x * p, 0) / p END AS x3 FROM (
 SELECT *, pow(10e0, 2 - floor(log10(abs(CASE WHEN x = 0 THEN 1 ELSE x END)))) AS p FROM (SELECT event_id, (value - 30) * pow(10e0, event_id % 9 - 4) AS x FROM events) a) b""")
def _(spark, sf):
    x = (F.col("value") - 30) * F.pow(F.lit(10.0), F.col("event_id") % 9 - 4)
    return T.table(spark, sf, "events").select("event_id", X.round_significant(x, 3).alias("x3"))


@query("scalar_peak_offset", """
SELECT event_id, round(CASE WHEN u IS NULL OR w IS NULL THEN NULL WHEN u - v * 2 + w = 0 THEN 0 ELSE greatest(least((u - w) * 0.5e0 / (u - v * 2 + w), 0.5e0), -0.5e0) END, 6) + 0e0 AS at FROM (
 SELECT event_id, lag(value) OVER o AS u, value AS v, lead(value) OVER o AS w FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id)) x""")
def _(spark, sf):
    o = Window.partitionBy("user_id").orderBy("event_id")
    e = T.table(spark, sf, "events").select("event_id", F.lag("value").over(o).alias("u"), F.col("value").alias("v"), F.lead("value").over(o).alias("w"))
    at = F.when(F.col("u").isNotNull() & F.col("w").isNotNull(), X.parabolic_offset(F.col("u"), F.col("v"), F.col("w")))
    return e.select("event_id", (F.round(at, 6) + F.lit(0.0)).alias("at"))


@query("scalar_motion_flag", """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN x > 3 WHEN 1 THEN x / 40 > 0.075e0 WHEN 2 THEN x / 40 > 0.08e0 WHEN 3 THEN x / 40 > 0.1e0 END AS moving FROM (
 SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN value / 10 END AS x FROM events) e""".replace("0.075e0", f"{S.MOTION_LIMITS['wrist']!r}e0").replace("0.08e0", f"{S.MOTION_LIMITS['chest']!r}e0"))
def _(spark, sf):
    e = F.col("event_id")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("z", "wrist", "chest", "camera", "other")]), (e % 5 + 1).cast("int"))
    x = F.when(e % 11 != 0, F.col("value") / 10)
    return T.table(spark, sf, "events").select("event_id", S.motion_flag(kind, F.when(e % 5 == 0, x).otherwise(x / 40)).alias("moving"))


@query("reading_parity", "SELECT event_type, count(*) AS n, CASE WHEN event_type = 'error' THEN 0.00025e0 ELSE 0e0 END AS max_diff, event_type <> 'error' AS ok FROM events GROUP BY event_type")
def _(spark, sf):
    """Probabilities by the sigmoid against those by its other form; one group is off on purpose."""
    x = (F.col("value") - 50) / 10
    other = (F.tanh(x / 2) + 1) / 2 + F.when(F.col("event_type") == "error", 0.00025).otherwise(0.0)
    d = T.table(spark, sf, "events").select("event_type", X.sigmoid(x).alias("p"), other.alias("q"))
    return SC.parity(d, "p", "q", ["event_type"]).select("event_type", "n", (F.round("max_diff", 9) + F.lit(0.0)).alias("max_diff"), "ok")


@query("sink_owner_order", "SELECT 'S' || user_id AS owner, row_number() OVER (ORDER BY user_id) AS place FROM (SELECT DISTINCT user_id FROM events) u")
def _(spark, sf):
    owners = T.table(spark, sf, "events").select(F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("owner")).distinct()
    placed = sinks.owner_order(owners, "owner").withColumn("_at", F.monotonically_increasing_id())     # one row an owner
    return placed.select("owner", F.row_number().over(Window.orderBy("_at")).cast("long").alias("place"))
