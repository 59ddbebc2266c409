"""Secret scans over an incremental blob ledger, with DataFrame functions only.

Every version of every text is a blob, named by the SHA-256 of its bytes. The ledger is a folder of three tables: `paths`
(which path held which blob), `seen` (blob, rule, version) and `findings` (blob, rule, version, start, end). A scan hashes
the versions it is given, takes the blobs whose (blob, rule, version) the ledger has not seen, reads the text of one path of
each, and joins the findings back to all paths. Findings are written before `seen`: a scan that dies is repeated and the
repeated rows are dropped on reading.

Defined cases: NULL text is the empty blob; a NULL path is a path; repeated rows give repeated result rows; an empty table
gives no rows; columns beyond path and text are not read. Positions are code points, end exclusive. A text counts at its full
length. A blob that a third of all rows share is scanned once; the join back reads one row for it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.llm.base import written


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    version: int = 1
    group: int = 0      # the group whose length counts
    least: int = 1      # code points it must have
    quick: str = ""     # a cheaper pattern that every text with a match has


# fixed values: the kinds and patterns that every result must have
RULES = [
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", group=2, least=8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
]


def _hits(text: Column, rule: Rule) -> Column:
    """(gap, size, ok) of every match in order: code points since the match before, of the match, and whether it counts.

    Splitting by the pattern gives what lies between its matches, so positions follow by adding up.
    """
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    sizes = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    counted = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda v: F.length(v) >= rule.least)
    hits = F.transform(F.arrays_zip(F.slice(gaps, F.lit(1), F.size(sizes)).alias("gap"), sizes.alias("size"), counted.alias("ok")),
                       lambda h: F.struct(F.lit(rule.kind).alias("rule"), F.lit(rule.version).alias("version"), h["gap"].alias("gap"),
                                          h["size"].alias("size"), h["ok"].alias("ok")))
    return F.when(text.rlike(rule.quick or rule.pattern), hits)


def _ledger(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """A table of the ledger; empty before its first row."""
    probe = f"{folder}/{name}"
    path = spark._jvm.org.apache.hadoop.fs.Path(probe)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(probe)


SEEN = "blob binary, rule string, version int"
FINDINGS = "blob binary, rule string, version int, start long, end long"


def blob_id(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def scan(versions: DataFrame, ledger: str, path: str = "doc_id", text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """Bring the ledger up to date with `versions`; returns their (path, blob)."""
    spark = versions.sparkSession
    given = versions.select(F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    paths = written(given.select("path", blob_id(F.col("text")).alias("blob")), "paths")
    paths.write.mode("append").parquet(f"{ledger}/paths")
    asked = F.explode(F.array(*[F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version")) for r in rules]))
    blobs = paths.groupBy("blob").agg(F.min("path").alias("path"))
    unseen = written(blobs.select("blob", "path", asked.alias("r")).select("blob", "path", "r.*").join(
        _ledger(spark, ledger, "seen", SEEN), ["blob", "rule", "version"], "left_anti"), "unseen")
    todo = unseen.groupBy("blob", "path").agg(F.collect_set("rule").alias("todo"))
    here = given.withColumn("_blob", blob_id(F.col("text"))).join(
        todo.withColumnRenamed("path", "_path").hint("shuffle_hash"),
        F.col("path").eqNullSafe(F.col("_path")) & (F.col("_blob") == F.col("blob")))
    nothing = F.array().cast("array<struct<rule:string,version:int,gap:int,size:int,ok:boolean>>")
    found = [F.coalesce(F.when(F.array_contains("todo", r.kind), _hits(F.col("text"), r)), nothing) for r in rules]
    hits = here.select("blob", F.posexplode(F.concat(*found)).alias("k", "h")).select("blob", "k", "h.*").dropDuplicates(["blob", "rule", "version", "k"])
    order = Window.partitionBy("blob", "rule", "version").orderBy("k")
    end = F.sum((F.col("gap") + F.col("size")).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    findings = hits.withColumn("end", end).filter("ok").select("blob", "rule", "version", (F.col("end") - F.col("size")).alias("start"), "end")
    findings.write.mode("append").parquet(f"{ledger}/findings")
    unseen.select("blob", "rule", "version").write.mode("append").parquet(f"{ledger}/seen")
    return paths


def _current(spark: SparkSession, ledger: str, rules: list[Rule]) -> DataFrame:
    """Findings of the rules in their versions."""
    current = F.array(*[F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
    return _ledger(spark, ledger, "findings", FINDINGS).filter(F.array_contains(current, F.struct("rule", "version"))).distinct()


def findings_of(paths: DataFrame, ledger: str, rules: list[Rule] = RULES) -> DataFrame:
    """Per row of `paths`: path, blob, spans = its findings (start, k = place of the rule in `rules`, rule, end) in order."""
    spark = paths.sparkSession
    f = _current(spark, ledger, rules)
    k = F.array_position(F.lit([r.kind for r in rules]), F.col("rule")).cast("int")
    per_blob = f.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", k.alias("k"), "rule", "end"))).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,k:int,rule:string,end:bigint>>")
    return paths.join(per_blob, "blob", "left").select("path", "blob", F.coalesce("spans", none).alias("spans"))


def named(spans: Column) -> Column:
    """`kind:start:end` of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["rule"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masks(ledger: str, spark: SparkSession, rules: list[Rule] = RULES) -> DataFrame:
    """blob and cuts, the parts (start, end) of every blob that findings cover, in order and apart from one another."""
    f = _current(spark, ledger, rules)
    order = Window.partitionBy("blob").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    f = f.withColumn("new", (F.coalesce(before, F.lit(-1)) < F.col("start")).cast("int"))
    f = f.withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = f.groupBy("blob", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return parts.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts"))


def redact(text: Column, cuts: Column, mark: str = "[secret]") -> Column:
    """The text with every cut replaced by a mark."""
    size = F.length(text).cast("long")
    kept = F.transform(F.sequence(F.lit(0), F.size(cuts)), lambda i: F.substr(
        text, (F.coalesce(F.get(cuts, i - 1)["end"], F.lit(0)) + 1).cast("int"),
        (F.coalesce(F.get(cuts, i)["start"], size) - F.coalesce(F.get(cuts, i - 1)["end"], F.lit(0))).cast("int")))
    return F.array_join(kept, mark)
