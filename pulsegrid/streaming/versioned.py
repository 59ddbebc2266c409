"""A table of the newest row per key, fed by batches of changes: hash buckets, small additions, and a manifest per version.

Layout of a table folder:

    data/version=N/bucket=B/   rows that batch N wrote for a bucket: either additions, or the whole bucket merged anew
    manifest/version=N/        one small file: which versions make up every bucket, and how many rows they have

A batch writes its own rows only. A bucket whose additions have grown beyond `merge_at` of its merged rows is merged in the same batch,
so a batch on one per cent of the keys writes about that share, and reading never meets many additions. The manifest file appears
when it is complete, and the largest version that has one is the table: readers see the state before a batch or after it. A batch that
is run again starts from the version before it and writes the same version again. Data that none of the last `keep` manifests names
is deleted.

On the driver are only manifests: at most a few rows per bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from pulsegrid.operators.records import newest

BUCKETS = 64
MERGE_AT = 0.5
KEEP = 2
MANIFEST = "bucket int, part long, n_rows long, merged boolean"


def _fs(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Versions whose manifest is complete, in order."""
    jvm_path, fs = spark._jvm.org.apache.hadoop.fs.Path, _fs(spark, folder)
    root = jvm_path(f"{folder}/manifest")
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith("version=") and fs.exists(jvm_path(f"{folder}/manifest/{n}/_SUCCESS")))


def manifest(spark: SparkSession, folder: str, version: int) -> list[tuple]:
    """(bucket, part, n_rows, merged) of a version: a few rows per bucket."""
    return [tuple(r) for r in spark.read.schema(MANIFEST).json(f"{folder}/manifest/version={version}").collect()]


def _parts(spark: SparkSession, folder: str, schema, entries: list[tuple]) -> DataFrame:
    """Rows of some manifest entries."""
    paths = [f"{folder}/data/version={part}/bucket={bucket}" for bucket, part, _, _ in entries]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_table(spark: SparkSession, folder: str, schema, key: list[str], order: str, version: int | None = None) -> DataFrame:
    """The newest row of every key as of a version (default: the last one)."""
    known = versions(spark, folder)
    if not known:
        return spark.createDataFrame([], schema)
    return newest(_parts(spark, folder, schema, manifest(spark, folder, known[-1] if version is None else version)), key, order)


def merge_batch(batch: DataFrame, number: int, folder: str, key: list[str], order: str, *, buckets: int = BUCKETS, merge_at: float = MERGE_AT, keep: int = KEEP) -> None:
    """Apply one batch as version `number`."""
    spark, schema = batch.sparkSession, batch.schema
    if "bucket" in schema.names:
        raise ValueError("the name bucket is the table's own")
    before = [v for v in versions(spark, folder) if v < number]
    entries = manifest(spark, folder, before[-1]) if before else []
    place = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int").alias("bucket")
    changed = newest(batch, key, order).select(*schema.names, place)
    added = {r["bucket"]: r["count"] for r in changed.groupBy("bucket").count().collect()}      # one row a bucket
    held: dict[int, list[tuple]] = {}
    for e in entries:
        held.setdefault(e[0], []).append(e)

    def full(bucket: int) -> bool:
        mine = held.get(bucket, [])
        base = sum(n for _, _, n, merged in mine if merged)
        return added[bucket] + sum(n for _, _, n, merged in mine if not merged) > merge_at * base

    anew = sorted(b for b in added if held.get(b) and full(b))
    rows = changed
    if anew:
        old = _parts(spark, folder, schema, [e for b in anew for e in held[b]])
        due = F.col("bucket").isin(anew)
        again = newest(old.select(*schema.names, place).unionByName(changed.filter(due)), [*key, "bucket"], order).select(*changed.columns)
        rows = changed.filter(~due).unionByName(again)
    # one file a bucket and version
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/data/version={number}")
    whole = {}
    if anew:
        written = spark.read.schema(StructType([*schema.fields, StructField("bucket", IntegerType())]))
        whole = {r["bucket"]: r["count"] for r in written.parquet(f"{folder}/data/version={number}").groupBy("bucket").count().collect()}
    now = [e for e in entries if e[0] not in anew]
    now += [(b, number, whole.get(b, added[b]) if b in anew else added[b], b in anew or b not in held) for b in sorted(added)]
    spark.createDataFrame(sorted(now), MANIFEST).coalesce(1).write.mode("overwrite").json(f"{folder}/manifest/version={number}")
    expire(spark, folder, keep)


def expire(spark: SparkSession, folder: str, keep: int = KEEP) -> None:
    """Delete manifests but the last `keep`, and data that none of those names."""
    known = versions(spark, folder)
    last = known[-keep:]
    used = {(part, bucket) for v in last for bucket, part, _, _ in manifest(spark, folder, v)}
    jvm_path, fs = spark._jvm.org.apache.hadoop.fs.Path, _fs(spark, folder)
    for v in known[:-keep]:
        fs.delete(jvm_path(f"{folder}/manifest/version={v}"), True)
    for s in fs.listStatus(jvm_path(f"{folder}/data")):
        part = int(s.getPath().getName().partition("=")[2])
        if part > last[-1]:
            continue
        for b in fs.listStatus(s.getPath()):
            name = b.getPath().getName()
            if name.startswith("bucket=") and (part, int(name.partition("=")[2])) not in used:
                fs.delete(b.getPath(), True)


def merge_changes(changes: DataFrame, folder: str, checkpoint: str, key: list[str] = ["user_id", "id"], order: str = "seq", *,
                  buckets: int = BUCKETS, merge_at: float = MERGE_AT, keep: int = KEEP) -> StreamingQuery:
    """Feed a table from a stream of changes, the newest change per key winning; every batch is a version (see `read_table`)."""
    def run(batch: DataFrame, number: int) -> None:
        kept = batch.persist()      # used for the counts and for the rows
        try:
            merge_batch(kept, number, folder, key, order, buckets=buckets, merge_at=merge_at, keep=keep)
        finally:
            kept.unpersist()

    return changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
