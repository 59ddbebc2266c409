"""Mixing sources to target weights by subset-sum budget fitting.

Every document has a size in words. A source with the total S and the target T is taken whole floor(T / S) times; the rest
of the target is a budget that one more copy of some documents has to fill. Documents of equal size are interchangeable, so
the budget is fitted on counts per exact size: every size first gives the same share of its documents, rounded down; whole
documents are added from the largest size down while they fit; what then remains, less than one document, is closed by a
bounded-knapsack dynamic program over the documents still free, which may also trade in a bounded number of documents
already taken. The counts per size are then turned into documents by a seeded hash order.

Bounds: the fit of one source reads one row per distinct size, never one per document; its bit sets are as long as a few of
its longest documents. The seeded choice cuts every (source, size) group into hash ranges of about `RANGE_ROWS` documents,
of which only the last one taken in part is ranked, so no group of equal documents lands in one task. All other rows,
those of size 0 too, get their copies without a sort.

Defined cases: NULL or empty text has size 0 and is not taken; a NULL source is a source, last in order; equal rows are
equal candidates, each taken on its own; ties of the hash are ordered by id; long texts are counted whole, and a size of their own
is one more row of the fit; an empty table gives no rows; a source of size 0
has target 0; other columns are not read.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.base import SPACE, join_tagged, text_tag, written

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3
RANGE_ROWS = 20_000
WORD = "[^" + SPACE[1:]


def sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, tag (of the text), source, size in words."""
    return docs.select(F.col(doc_id).alias("doc_id"), text_tag(text).alias("tag"), F.col(source).alias("source"),
                       F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, share: float = 1.0) -> DataFrame:
    """source, source_size, target. Targets share `share` of all words by weight; none exceeds `most` times its source.

    What sources at their limit leave over goes to the others by weight. Sorted by limit per weight, the sources at their
    limit come first, so the common level of the rest is found with running sums over one row per source.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.lit(list(weights)), (place % len(weights) + 1).cast("int"))
    s = s.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    s = s.withColumn("level", F.col("limit") / F.col("weight"))
    order = Window.orderBy("level", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("level").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
    s = s.withColumn("rest", F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
    s = s.withColumn("free", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("common", F.when(F.col("rest") / F.col("free") <= F.col("level"), F.col("rest") / F.col("free")))
    s = s.withColumn("common", F.first("common", ignorenulls=True).over(everything))
    at = F.when(F.col("common").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("weight") * F.col("common")))
    return s.select("source", "source_size", at.alias("target"))


def fit_counts(lengths: list[int], counts: list[int], budget: int, trade: int = 64) -> list[int]:
    """How many documents of every length to take so that their sum is as near to `budget` as can be, at most it if equal.

    `trade`: documents per length that the dynamic program may add or give back. The answer is exact for up to that many
    documents of each length, and never worse than the rounded shares.
    """
    have = {n: c for n, c in zip(lengths, counts) if n > 0 and c > 0}
    total = sum(n * c for n, c in have.items())
    budget = max(0, min(budget, total))
    if not total:
        return [0] * len(lengths)
    take = {n: c * budget // total for n, c in have.items()}
    rest = budget - sum(n * k for n, k in take.items())
    for n in sorted(have, reverse=True):
        k = min(rest // n, have[n] - take[n])
        take[n] += k
        rest -= n * k
    if rest:
        # give back up to `trade` of each length, then fill what is open again
        back, most = {}, 24 * max(have)
        opened = rest
        for n in sorted(have):
            k = max(0, min(take[n], trade, (most + rest - opened) // n))
            back[n] = k
            opened += n * k
        items = [(n, size) for n in sorted(have) for size in _parts(min(have[n] - take[n] + back[n], back[n] + trade))]
        width = opened + max(have)
        mask = (1 << (width + 1)) - 1
        reach, layers = 1, []
        for n, size in items:
            layers.append(reach)
            reach |= (reach << (n * size)) & mask
            if reach >> opened & 1:
                break
        below = (reach & ((1 << (opened + 1)) - 1)).bit_length() - 1
        above = reach >> (opened + 1)
        at = below
        if above:
            up = opened + (above & -above).bit_length()
            if up - opened < opened - below:
                at = up
        if abs(opened - at) < rest:
            for n, k in back.items():
                take[n] -= k
            for (n, size), layer in zip(reversed(items[:len(layers)]), reversed(layers)):
                if not layer >> at & 1:
                    take[n] += size
                    at -= n * size
    return [take.get(n, 0) for n in lengths]


def _parts(count: int) -> list[int]:
    """Sizes 1, 2, 4 and a rest, whose sums are all numbers up to `count`."""
    out, size = [], 1
    while count > 0:
        out.append(min(size, count))
        count -= size
        size *= 2
    return out


def in_part() -> Column:
    """Whether a row's range, which holds `here` rows, is taken in part: `open` more are wanted from it on."""
    return (F.col("open") > 0) & (F.col("open") < F.col("here"))


def ranked(d: DataFrame) -> DataFrame:
    """Rows of the ranges taken in part, one range per (source, size), with their copies."""
    place = F.row_number().over(Window.partitionBy("source", "size").orderBy("h", "doc_id", "tag"))
    return d.filter(in_part()).select("doc_id", "tag", "source", "size", (F.col("copies") + (place <= F.col("open")).cast("int")).alias("copies"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", *, seed: int = 17,
        weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, share: float = 1.0) -> DataFrame:
    """doc_id, tag, source, size, source_size, target, copies, taken = copies * size; one row per row of `docs`."""
    sized = written(sizes(docs, doc_id, text, source), "sizes")
    goal = written(targets(sized, weights, most, share), "targets")
    per_size = sized.filter("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    same = F.col("source").eqNullSafe(F.col("_source"))
    known = per_size.join(goal.withColumnRenamed("source", "_source"), same).drop("_source")

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        whole, target = int(frame["source_size"].iloc[0]), float(frame["target"].iloc[0])
        copies = min(most, int(target // whole))
        more = fit_counts(frame["size"].tolist(), frame["n"].tolist(), round(target - copies * whole)) if copies < most else [0] * len(frame)
        return frame[["source", "size", "n"]].assign(copies=copies, extra=more)

    fitted = written(known.groupBy("source").applyInPandas(fit, "source string, size long, n long, copies int, extra long"), "fitted")
    # hash ranges of a (source, size) group, in order, until the wanted number is reached
    key = F.xxhash64(F.col("doc_id"), F.col("tag"), F.lit(seed)).bitwiseAND(F.lit((1 << 31) - 1))
    f = fitted.select(F.col("source").alias("_source"), F.col("size").alias("_size"), "copies", "extra", F.ceil(F.col("n") / RANGE_ROWS).alias("ranges"))
    d = sized.filter("size > 0").withColumn("h", key).join(f, F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")))
    d = d.withColumn("range", F.floor(F.col("h") * F.col("ranges") / F.lit(float(1 << 31)))).drop("_source", "_size")
    counted = d.groupBy("source", "size", "range").agg(F.count("*").alias("here"))
    before = Window.partitionBy("source", "size").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = counted.select(F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("range").alias("_range"), "here",
                            F.coalesce(F.sum("here").over(before), F.lit(0)).alias("earlier"))
    d = written(d.join(ranges, F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")) & (F.col("range") == F.col("_range")))
                .select("doc_id", "tag", "source", "size", "h", "copies", (F.col("extra") - F.col("earlier")).alias("open"), "here"), "ranged")
    dealt = sized.filter("size = 0").withColumn("copies", F.lit(0)).unionByName(
        d.filter(~in_part()).select("doc_id", "tag", "source", "size", (F.col("copies") + (F.col("open") > 0).cast("int")).alias("copies"))).unionByName(ranked(d))
    g = goal.select(F.col("source").alias("_source"), "source_size", "target")
    return (dealt.join(g, F.col("source").eqNullSafe(F.col("_source")))
            .select("doc_id", "tag", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")))



def repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **given) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it."""
    taken = mix(docs, doc_id, text, source, **given).groupBy("doc_id", "tag", "source").agg(F.sort_array(F.collect_list("copies"), False).alias("_copies"))
    j = join_tagged(docs, taken.filter(F.element_at("_copies", 1) > 0), doc_id, text, source).withColumn("_times", F.element_at("_copies", F.col("_nth")))
    return j.filter("_times > 0").withColumn("_times", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_row.*")
