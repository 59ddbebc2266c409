"""Quality classifier: a factorisation machine over hashed words, structure statistics and the length as metadata.

Features of a text are its distinct words, hashed to `WORD_SLOTS` and scaled to unit length, and its structure statistics
(length, word length, repeated words and word pairs, repeated lines, capitals, signs, digits, the share of the most frequent
marks), each cut to `BINS` bins of which one is set. The pairwise part of the machine lets bins and words act together at a
low rank; it is scored in linear time, as half of the squared sums less the summed squares. Fitting minimises the logistic
loss on a bounded seeded sample of labelled rows (`fit_rows`).

Bounds: the sample and the coefficients, (WORD_SLOTS + STAT_SLOTS) x (rank + 1), do not grow with the data. Texts are read
whole.

Defined cases: NULL text is empty and scored; rows whose label is NULL are not learned from; repeated labels count each time;
without rows of both labels the score is the share of label 1 with one added to either side; an empty table gives no
rows; equal texts have equal scores, and rows that tie stay as they are; other columns are not read.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import FMClassifier
from pyspark.ml.feature import HashingTF, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.base import SPACE, written

WORD_SLOTS = 1 << 12
STAT_SLOTS = 1 << 11
BINS = 20


def _bin(name: str, x: Column) -> Column:
    """The name of the bin of a share between 0 and 1."""
    return F.concat(F.lit(name + "="), F.least(F.floor(F.coalesce(x, F.lit(0.0)) * BINS), F.lit(BINS - 1)).cast("string"))


def features(docs: DataFrame, text: str, *keep: str) -> DataFrame:
    """`keep`, words and stats (arrays of strings) of every text."""
    d = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    d = d.withColumn("_words", F.filter(F.split(F.lower("_text"), SPACE), lambda w: w != "")).withColumn("_lines", F.split("_text", "\n"))
    d = d.withColumn("_pairs", F.zip_with("_words", F.slice("_words", F.lit(2), F.size("_words")), lambda a, b: F.hash(a, b)))
    d = d.withColumn("_own", F.array_distinct("_words"))
    d = d.withColumn("_n", F.size("_words").cast("double")).withColumn("_size", F.length("_text").cast("double"))

    def share(x: Column, of: Column) -> Column:
        return F.when(of > 0, x / of)

    def without(pattern: str) -> Column:
        return F.col("_size") - F.length(F.regexp_replace("_text", pattern, ""))

    n, size = F.col("_n"), F.col("_size")
    stats = F.array(
        _bin("chars", F.log2(size + 1) / 20), _bin("words", F.log2(n + 1) / 16), _bin("mean", share(size, n) / 20),
        _bin("distinct", share(F.size("_own").cast("double"), n)),
        _bin("pairs", share(F.size(F.array_distinct("_pairs")).cast("double"), n)),
        _bin("lines", share(F.size(F.array_distinct("_lines")).cast("double"), F.size("_lines").cast("double"))),
        _bin("line", F.log2(size / F.size("_lines") + 1) / 14),
        _bin("capitals", share(without(r"\p{Lu}+"), size)), _bin("digits", share(without(r"[0-9]+"), size) * 2),
        _bin("signs", share(without(r"[^\p{L}\p{N}\s]+"), size) * 2), _bin("bars", share(without(r"[|<>{}\[\]=_/\\]+"), size) * 4),
        _bin("marks", share(without(r"[!?#$%&*@~^+]+"), size) * 4), _bin("stops", share(without(r"[.,;:]+"), size) * 8))
    return d.select(*keep, F.col("_own").alias("words"), stats.alias("stats"))


def _vectors(df: DataFrame) -> DataFrame:
    steps = [HashingTF(inputCol="words", outputCol="_w", numFeatures=WORD_SLOTS, binary=True), Normalizer(inputCol="_w", outputCol="_wn", p=2.0),
             HashingTF(inputCol="stats", outputCol="_s", numFeatures=STAT_SLOTS, binary=True),
             VectorAssembler(inputCols=["_wn", "_s"], outputCol="features")]
    return PipelineModel(steps).transform(df).drop("_w", "_wn", "_s", "words", "stats")


def fit(docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality", *,
        fit_rows: int = 20_000, rank: int = 4, rounds: int = 120, seed: int = 11):
    """A model, or the score of every text if the labels do not differ. `learn`: condition on the id, named doc_id."""
    named = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("double").alias("label")).filter(learn & F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    chosen = named.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(fit_rows)
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = written(_vectors(features(d, "text", "doc_id", "label")).select("label", "features"), "quality-sample")
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(n) < 2:
        return (n.get(1.0, 0) + 1) / (sum(n.values()) + 2)
    fm = FMClassifier(featuresCol="features", labelCol="label", factorSize=rank, maxIter=rounds, stepSize=0.05, regParam=1e-4, initStd=0.05,
                      tol=0.0, seed=seed, solver="adamW")
    return fm.fit(rows.repartition(8))


def score(docs: DataFrame, model, keep: list[str], text: str = "text") -> DataFrame:
    """Columns `keep` of every row and score, the probability of label 1."""
    kept = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(text).alias("_t"))
    names = [f"_k{i}" for i in range(len(keep))]
    if isinstance(model, float):
        out = kept.withColumn("score", F.lit(model))
    else:
        out = model.transform(_vectors(features(kept, "_t", *names))).withColumn("score", vector_to_array("probability")[1])
    return out.select(*[F.col(a).alias(b) for a, b in zip(names, keep)], "score")
