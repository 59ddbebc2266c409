"""Helpers shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.session import new_folder

# white space of words in all contracts: blank and the controls 9 to 13
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write `df` below the shared folder and read it from there, so that a lost executor costs no
    recomputation and every later step reads only the columns it needs."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def id_remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; NULL for a NULL id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % modulus


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_tag(text: str = "text") -> Column:
    """Tells rows of one id apart by their text."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def join_tagged(docs: DataFrame, chosen: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str | None = None) -> DataFrame:
    """`_row`, a row of `docs` as it is (whatever its columns are called), for every one whose (id, tag) stands in `chosen` (doc_id, tag, and
    more columns, which are added), with `_nth`, the number of a row among equal ones, from 1. With the name of a column `source`, rows are
    equal only if they agree in it too, and `chosen` has it as source."""
    key = ["doc_id", "tag"] + ["source"] * (source is not None)
    extra = [c for c in chosen.columns if c not in key]
    c = chosen.select(*[F.col(k).alias(f"_{k}") for k in key], *extra)
    d = docs.select(F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("_row"), F.col(f"`{doc_id}`").alias("_own_id"), text_tag(f"`{text}`").alias("_own_tag"),
                    *[F.col(f"`{source}`").alias("_own_source")] * (source is not None))
    same = F.col("_own_id").eqNullSafe(F.col("_doc_id")) & (F.col("_own_tag") == F.col("_tag"))
    if source is not None:
        same = same & F.col("_own_source").eqNullSafe(F.col("_source"))
    nth = F.row_number().over(Window.partitionBy(*[f"_{k}" for k in key]).orderBy("_tag"))
    return d.join(c, same).withColumn("_nth", nth).select("_row", *extra, "_nth")
