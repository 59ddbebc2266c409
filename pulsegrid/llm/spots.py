"""Document fingerprints from spot signatures, with DataFrame functions only.

A spot is a content word that directly follows a common word. Its signature is the common word, the content word and the
two content words after it, common words skipped, hashed to 32 bits. A fingerprint is the sorted set of a text's signatures,
eight hex digits each; likeness is the Jaccard index of two sets. A text without spots (short, or in a language without
listed common words) has one signature of all its words, so that only texts of equal words are alike.

Defined cases: NULL text is empty; the empty text has the signature of no words; equal texts have equal fingerprints;
repeated ids are ordered by text, NULL ids come first; long texts are read whole, with all their spots in one row; an empty table
gives no rows; other columns are not read.

`with_next` gives every row the text of the next id without a global window: ids are cut into ranges at approximate
quantiles, every range gets a copy of the first row of the next one, and the window runs per range. `near_pairs` is the
similarity join: sets are partitioned by length so that only neighbouring partitions can reach the threshold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.base import shuffle_width

# fixed values: frequent function words of the corpus languages
COMMON = """
the of and to in a is that it was for on are with as be at by this have from or had not but what were they which you an
der die das und ist den von zu mit sich des auf dem für im nicht ein eine als auch es an er sie wird bei einer um am
le la les et des est un une du que en dans qui pour pas au sur ce il plus par ne se avec ou
el los las y que del se por con una su para es al lo como más pero sus esta ya entre
""".split()


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def signatures(words: Column, common: list[str] = COMMON, chain: int = 3) -> Column:
    """Sorted set of 32-bit signatures of an array of words."""
    stop = sorted(set(common))
    # content words with the word before each
    content = F.filter(
        F.transform(words, lambda w, i: F.struct(w.alias("w"), F.get(words, i - 1).alias("p"))), lambda x: ~x["w"].isin(stop))

    def chains(items: Column) -> Column:
        signed = F.transform(items, lambda x, i: F.when(
            x["p"].isin(stop), F.hash(F.concat_ws(" ", x["p"], x["w"], *[F.get(items, i + k)["w"] for k in range(1, chain)]))))
        return F.array_compact(signed)

    # `content` is bound once: a lambda over an array of one element
    spots = F.flatten(F.transform(F.array(content), chains))
    whole = F.array(F.hash(F.concat(F.lit("all "), F.array_join(words, " "))))
    bound = F.transform(F.array(spots), lambda s: F.when(F.size(s) == 0, whole).otherwise(s))
    return F.sort_array(F.array_distinct(F.element_at(bound, 1)))


def fingerprint(text: Column, **given) -> Column:
    bound = F.transform(F.array(words(text)), lambda w: signatures(w, **given))
    return F.element_at(bound, 1)


def printed(signs: Column) -> Column:
    return F.array_join(F.transform(signs, lambda s: F.lpad(F.lower(F.hex(s.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b)).cast("double")
    return both / (F.size(a) + F.size(b) - both)


def length_part(signs: Column, threshold: float = 0.8) -> Column:
    """Number of the length partition; sets two or more partitions apart cannot reach the threshold."""
    return F.floor(F.log(F.size(signs).cast("double")) / F.lit(math.log(1 / threshold)) + 1e-9)


def range_bucket(x: Column, bounds: list) -> Column:
    """Number of bounds that are at most x, looked up in two steps; -1 for NULL."""
    step = max(1, math.isqrt(len(bounds)))
    rows = [bounds[i:i + step] for i in range(0, len(bounds), step)]
    if not rows:
        return F.when(x.isNull(), F.lit(-1)).otherwise(F.lit(0))
    row = F.size(F.filter(F.lit([r[0] for r in rows]), lambda b: b <= x))
    inside = F.array(*[F.lit(r) for r in rows])
    return F.when(x.isNull(), F.lit(-1)).when(row == 0, F.lit(0)).otherwise(
        (row - 1) * step + F.size(F.filter(F.element_at(inside, F.greatest(row, F.lit(1))), lambda b: b <= x)))


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, next_text: the text of the next row by ascending id; after the last the first."""
    spark = docs.sparkSession
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = 4 * shuffle_width(spark)     # several ranges per task even out
    # one number per range goes to the driver
    cuts = d.select(F.percentile_approx("doc_id", F.lit([i / n for i in range(1, n)] or [0.5]), F.lit(100 * n))).first()[0] or []
    d = d.withColumn("bucket", range_bucket(F.col("doc_id"), sorted(set(cuts))))
    firsts = d.groupBy("bucket").agg(F.min("doc_id").alias("first_id"))   # a row per range
    ends = Window.orderBy("bucket")
    before = firsts.select("first_id", F.col("bucket").alias("own"), F.coalesce(
        F.lag("bucket").over(ends), F.max("bucket").over(ends.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("to"))
    guests = (d.join(F.broadcast(before), (F.col("bucket") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
              .groupBy("to", "doc_id").agg(F.min("text").alias("text")))
    both = d.select("bucket", F.lit(0).alias("guest"), "doc_id", "text").unionByName(
        guests.select(F.col("to").alias("bucket"), F.lit(1).alias("guest"), "doc_id", "text"))
    order = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").asc_nulls_first(), "text")
    return both.withColumn("next_text", F.lead("text").over(order)).filter("guest = 0").select("doc_id", "text", "next_text")


def edited(text: Column, other: Column) -> Column:
    """The last half of the code points replaced by the first as many of another text."""
    half = F.floor(F.length(text) / F.lit(2)).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - half), F.substr(other, F.lit(1), half))


def near_pairs(prints: DataFrame, key: str = "doc_id", signs: str = "signs", threshold: float = 0.8) -> DataFrame:
    """Pairs (a, b, likeness) of sets of different content with likeness of at least `threshold`; sets of equal content are
    one member, named by their smallest key.

    A set goes to its own length partition and, as a probe, to the one below. Inside a partition two sets meet only if they
    share one of their rarest signatures: of n, all but ceil(threshold * n) - 1 are looked up, which every pair that reaches
    the threshold has to share one of.
    """
    p = written_sets(prints.select(F.col(key).alias("key"), F.col(signs).alias("signs")))
    one = p.select("key", "signs", F.size("signs").alias("n"), length_part(F.col("signs"), threshold).alias("part"))
    seen = one.select(F.explode("signs").alias("sign")).groupBy("sign").count()
    rare = one.select("key", "n", "part", F.explode("signs").alias("sign")).join(seen, "sign")
    place = F.row_number().over(Window.partitionBy("key").orderBy("count", "sign"))
    prefix = rare.withColumn("place", place).filter(F.col("place") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1)
    stored = prefix.select("sign", "part", F.col("key").alias("a"), F.col("n").alias("na"))
    probes = prefix.select("sign", F.explode(F.array("part", F.col("part") - 1)).alias("part"), F.col("part").alias("own"), F.col("key").alias("b"), F.col("n").alias("nb"))
    close = F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb") - 1e-9
    ordered = (F.col("own") > F.col("part")) | (F.col("a") < F.col("b"))
    pairs = stored.join(probes, ["sign", "part"]).filter(close & ordered).select("a", "b").distinct()
    sets = one.select("key", "signs")
    full = (pairs.join(sets.select(F.col("key").alias("a"), F.col("signs").alias("sa")), "a")
            .join(sets.select(F.col("key").alias("b"), F.col("signs").alias("sb")), "b"))
    return full.select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("likeness")).filter(F.col("likeness") >= threshold - 1e-12)


def written_sets(sets: DataFrame) -> DataFrame:
    """One member per distinct set."""
    return sets.groupBy("signs").agg(F.min("key").alias("key"))
