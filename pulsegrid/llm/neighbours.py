"""Approximate nearest neighbours by largest inner product: balanced posting lists behind a graph of centroids.

Fitting: centroids are k-means means of a bounded sample (`fit_rows`); after the rounds a cluster of more than twice the mean
size in the sample is split in two until none is left (`split_full`), so that lists are balanced; this adds centroids. Indexing: every vector goes to the list of its nearest centroid and, if it is near a
boundary, to others whose distance is at most `1 + replicate` times as long. Searching: a query walks the graph of centroids
(every centroid knows its nearest ones and some far ones) and reads the lists within a ratio of the distance of the nearest,
but lists of at least `least` vectors together. The ratio is measured, not guessed: on `PROBES` vectors of the sample it is the
one within which `cover` of their true nearest in the sample lie. So data without clusters costs more lists, not recall.

Inner products become distances by one more coordinate that brings all vectors to the length of the longest; scores are
inner products of the original vectors in double precision.

Equal vectors are one entry with their smallest `top + 1` ids, which is all that a result can show. Lists are cut into
blocks of `BLOCK` entries and the queries of a list too, so a task holds one block of each; every pair of blocks returns the
best per query only.

Bounds: the graph, `most_lists` centroids and those that splitting adds, is all that is broadcast, with the sizes of the lists.

Defined cases: vectors that are NULL, zero, of another length than most, or hold NULL or non-finite components take no part;
ties go to the smaller id; repeated rows of one id count once; NULL ids take no part; fewer candidates than asked are all
returned if the lists hold them, which `least` sees to; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.base import written

FIT_ROWS = 20_000
BLOCK = 4096
KNOWN = 24      # edges of a centroid to its nearest
FAR = 8         # and to others
BEAM = 32
PROBES = 500    # sample vectors on which the ratio is measured


class Graph:
    """Centroids and the walk over them."""

    def __init__(self, centres: np.ndarray, seed: int = 5):
        n = len(centres)
        self.centres = centres
        k = min(KNOWN, n - 1)
        rng = np.random.default_rng(seed)
        near = np.zeros((n, k), np.int64)
        for a in range(0, n, 1024):
            d = self.distances(centres[a:a + 1024])
            d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
            near[a:a + 1024] = np.argsort(d, axis=1, kind="stable")[:, :k]
        self.edges = np.hstack([near, rng.integers(0, n, (n, FAR))])
        self.entry = rng.choice(n, min(n, 16), replace=False)

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x ** 2).sum(1)[:, None] - 2 * x @ self.centres.T + (self.centres ** 2).sum(1), 0)

    def search(self, x: np.ndarray, k: int, ratio: float = np.inf, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(centroid numbers, squared distances), k nearest found per row of x, nearest first; beyond `ratio` times the
        nearest distance the walk does not go on.

        All rows walk together: every step opens each row's nearest unopened centroid, until none of its beam is left.
        """
        n, q = len(self.centres), len(x)
        beam = min(n, max(beam, k))
        opened = np.zeros((q, n), bool)
        known = np.full((q, n), np.inf)
        active = np.arange(q)
        self._look(x, known, active, np.broadcast_to(self.entry, (q, len(self.entry))))
        while len(active):
            d = known[active]
            limit = np.partition(d, beam - 1, axis=1)[:, beam - 1]
            if np.isfinite(ratio):
                few = min(n, BEAM)
                limit = np.minimum(limit, np.maximum(ratio ** 2 * d.min(1), np.partition(d, few - 1, axis=1)[:, few - 1]))
            left = np.where(opened[active], np.inf, d)
            best = left.argmin(1)
            at = left[np.arange(len(active)), best]
            go = np.isfinite(at) & (at <= limit)
            active, best = active[go], best[go]
            opened[active, best] = True
            self._look(x, known, active, self.edges[best])
        at = np.argsort(known, axis=1, kind="stable")[:, :k]
        return at, np.take_along_axis(known, at, 1)

    def _look(self, x: np.ndarray, known: np.ndarray, rows: np.ndarray, nodes: np.ndarray) -> None:
        if len(rows):
            known[rows[:, None], nodes] = ((x[rows][:, None, :] - self.centres[nodes]) ** 2).sum(2)

    def lists(self, x: np.ndarray, replicate: float, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(list numbers, whether used) of every row of x: its nearest centroid and near ones, `most` at most."""
        at, d = self.search(x, min(most, len(self.centres)))
        return at, d <= np.maximum((1 + replicate) ** 2 * d[:, :1], d[:, :1])


def measured_ratio(g: Graph, v: np.ndarray, lifted: np.ndarray, top: int, replicate: float, most: int, cover: float, seed: int) -> float:
    """The distance ratio within which `cover` of the true nearest of some sample vectors lie in a list."""
    ask = np.random.default_rng(seed).choice(len(v), min(len(v), PROBES), replace=False)
    s = v[ask] @ v.T
    s[np.arange(len(ask)), ask] = -np.inf
    k = min(top, len(v) - 1)
    if k < 1:
        return 1.0
    near = np.argpartition(-s, k - 1, axis=1)[:, :k]
    used = np.unique(near)
    d = g.distances(lifted[used])
    most = min(most, d.shape[1])
    at = np.argpartition(d, most - 1, axis=1)[:, :most]
    use = np.take_along_axis(d, at, 1) <= np.maximum((1 + replicate) ** 2, 1) * d.min(1, keepdims=True)
    near = np.searchsorted(used, near)
    centre = np.sqrt(g.distances(lifted[ask]))
    far = centre / np.maximum(centre.min(1, keepdims=True), 1e-12)
    reach = np.where(use[near], np.take_along_axis(far, at[near].reshape(len(ask), -1), 1).reshape(near.shape + (at.shape[1],)), np.inf).min(2)
    return float(np.quantile(reach, cover)) * (1 + 1e-9)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The number of the nearest row of c, for every row of x."""
    return np.concatenate([((x[a:a + 4096] ** 2).sum(1)[:, None] - 2 * x[a:a + 4096] @ c.T + (c ** 2).sum(1)).argmin(1) for a in range(0, len(x), 4096)])


def split_full(x: np.ndarray, c: np.ndarray, most: float) -> np.ndarray:
    """Centres of which none is the nearest of more than `most` rows of x, which are distinct.

    A centre of more gives way to the means of the halves of its rows along their widest direction. Rows that rounding cannot
    tell apart do not split, so the rounds are limited.
    """
    for _ in range(64):
        own = nearest(x, c)
        full = np.flatnonzero(np.bincount(own, minlength=len(c)) > most)
        if not len(full):
            break
        halves = []
        for k in full:
            rows = x[own == k]
            off = rows - rows.mean(0)
            along = np.argsort(off @ np.linalg.eigh(off.T @ off)[1][:, -1], kind="stable")
            halves += [rows[along[:len(rows) // 2]].mean(0), rows[along[len(rows) // 2:]].mean(0)]
        c = np.vstack([np.delete(c, full, axis=0), *halves])
    return c


def fit_centres(x: np.ndarray, lists: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Balanced k-means means of the rows of x."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    lists = max(1, min(lists, len(x)))
    c = x[rng.choice(len(x), lists, replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
        # an empty or tiny cluster restarts beside the fullest
        for small in np.flatnonzero(n * 4 * len(c) < len(x)):
            full = n.argmax()
            c[small] = x[rng.choice(np.flatnonzero(own == full))]
            n[full] //= 2
    return split_full(x, c, 2 * len(x) / lists)


def clean(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id, v (array<double>) of the vectors that take part."""
    d = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(vector, lambda x: x.cast("double")).alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    return d.filter(good)


def search(rows: DataFrame, is_query, vec_id: str = "vec_id", vector: str = "embedding", *, top: int = 20, fit_rows: int = FIT_ROWS,
           per_list: int = 2000, fewest_lists: int = 64, most_lists: int = 4096, replicate: float = 0.05, most_copies: int = 2, cover: float = 0.95, least: int = 600, seed: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the `top` nearest of every row of which `is_query` (a condition on vec_id) holds."""
    spark = rows.sparkSession
    given = written(clean(rows, vec_id, vector).dropDuplicates(["vec_id"]), "vectors")
    common = given.groupBy(F.size("v").alias("n")).count().orderBy(F.col("count").desc(), "n").first()
    result = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return spark.createDataFrame([], result)
    width = common["n"]
    given = given.filter(F.size("v") == width)
    # equal vectors are one entry; its ids are cut to those a result can show, in two steps so that no group is large
    hashed = given.withColumn("h", F.xxhash64("v")).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    place = F.row_number().over(Window.partitionBy("h", "v", "salt").orderBy("vec_id"))
    few = hashed.withColumn("p", place).filter(F.col("p") <= top + 1)
    grouped = few.groupBy("h", "v").agg(F.slice(F.sort_array(F.collect_list("vec_id")), 1, top + 1).alias("ids"))
    entries = written(grouped.select(F.element_at("ids", 1).alias("entry"), "v", "ids"), "entries")
    n, longest = entries.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    lists = int(min(most_lists, max(fewest_lists, n // per_list)))
    sample = entries.orderBy(F.xxhash64("entry", F.lit(seed)), "entry").limit(fit_rows).select("v").toPandas()
    longest = float(longest) * (1 + 1e-12)

    def lifted(v: np.ndarray) -> np.ndarray:
        return np.hstack([v, np.sqrt(np.maximum(longest - (v ** 2).sum(1), 0))[:, None]])

    known = np.stack(sample["v"].to_numpy())
    made = Graph(fit_centres(lifted(known), lists, seed=seed))
    lists = len(made.centres)
    ratio = measured_ratio(made, known, lifted(known), top, replicate, most_copies, cover, seed)
    graph = spark.sparkContext.broadcast(made)

    def vectors(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = graph.value
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                at, take = g.lists(lifted(vectors(part.column("v"))), replicate, most_copies)
                row, j = np.nonzero(take)
                yield pa.RecordBatch.from_arrays([pa.array(at[row, j], pa.int64()), part.column("entry").take(pa.array(row)), part.column("v").take(pa.array(row))],
                                                 ["list", "entry", "v"])

    postings = written(entries.select("entry", "v").mapInArrow(assign, "list long, entry long, v array<double>"), "postings")
    sizes = {r["list"]: r["count"] for r in postings.groupBy("list").count().collect()}       # one row per list
    size = spark.sparkContext.broadcast(np.array([sizes.get(i, 0) for i in range(lists)], np.int64))
    queries = given.filter(is_query).select("vec_id", "v").withColumn("h", F.xxhash64("v"))
    asked = written(queries.groupBy("h", "v").agg(F.min("vec_id").alias("query")).select("query", "v"), "queries")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, count = graph.value, size.value
        k = len(g.centres)
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                at, d = g.search(lifted(vectors(part.column("v"))), k, ratio)
                held = np.cumsum(count[at], axis=1) - count[at]
                take = np.isfinite(d) & ((d <= ratio ** 2 * d[:, :1]) | (held < least))
                row, j = np.nonzero(take & (count[at] > 0))
                yield pa.RecordBatch.from_arrays([pa.array(at[row, j], pa.int64()), part.column("query").take(pa.array(row)), part.column("v").take(pa.array(row))],
                                                 ["list", "query", "v"])

    probes = written(asked.mapInArrow(probe, "list long, query long, v array<double>"), "probes")
    asks = probes.groupBy("list").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("query_blocks"))
    holds = postings.groupBy("list").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("entry_blocks"))
    cut = asks.join(holds, "list")                                                            # one row per list
    left = probes.join(cut, "list").withColumn("qb", F.pmod(F.xxhash64("query"), F.col("query_blocks")).cast("int")).withColumn(
        "eb", F.explode(F.sequence(F.lit(0), F.col("entry_blocks") - 1))).select("list", "qb", "eb", "query", "v")
    right = postings.join(cut, "list").withColumn("eb", F.pmod(F.xxhash64("entry"), F.col("entry_blocks")).cast("int")).withColumn(
        "qb", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1))).select("list", "qb", "eb", "entry", "v")

    def best(q: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(e):
            return pd.DataFrame({"query": [], "entry": [], "score": []}).astype({"query": "int64", "entry": "int64", "score": "float64"})
        e = e.sort_values("entry")
        y, names = np.stack(e["v"].to_numpy()), e["entry"].to_numpy()
        out = []
        for a in range(0, len(q), 512):
            part = q.iloc[a:a + 512]
            s = np.stack(part["v"].to_numpy()) @ y.T
            k = min(top + 1, len(names))
            if k < len(names):      # those above the k-th score, and of equal ones the smaller ids
                kth = -np.partition(-s, k - 1, axis=1)[:, k - 1:k]
                s = np.where(s >= kth, s, -np.inf)
            at = np.argsort(-s, axis=1, kind="stable")[:, :k]
            out.append(pd.DataFrame({"query": np.repeat(part["query"].to_numpy(), k), "entry": names[at].ravel(), "score": np.take_along_axis(s, at, 1).ravel()}))
        return pd.concat(out)

    found = left.groupBy("list", "qb", "eb").cogroup(right.groupBy("list", "qb", "eb")).applyInPandas(best, "query long, entry long, score double")
    single = found.groupBy("query", "entry").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "entry")
    near = single.withColumn("p", F.row_number().over(order)).filter(F.col("p") <= top + 1).select("query", "entry")
    # exact scores of what was found, ids of equal vectors, and the queries that share a vector
    full = (near.join(asked.withColumnRenamed("v", "vq"), "query").join(entries, "entry")
            .select("query", "ids", F.aggregate(F.zip_with("vq", "v", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x).alias("score")))
    same = queries.select(F.col("vec_id").alias("query_id"), "h", "v").join(
        asked.select("query", F.xxhash64("v").alias("h"), "v"), ["h", "v"]).select("query_id", "query")
    pairs = same.join(full.select("query", F.explode("ids").alias("vec_id"), "score"), "query").filter("query_id != vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
