"""Ranked lexical search: the best documents of every item, by branch-and-bound over document FP-trees.

A document is restricted to the terms of the items; its vector lists them from the most frequent in the corpus to the rarest, so
that documents with the same common terms share a path of the tree. A task builds trees of up to `TREE_ROWS` of its documents
one after another: documents are put in the order of their vectors, a node is a run of documents that agree in their first terms,
its children are the runs that agree in one more (neighbours of few documents stand together in a leaf of up to `LEAF`). Every node
knows the largest tf of each term below it and the smallest m, which bound the score of all documents below it from above.

Per item the bounds of all nodes come from one array operation. The tree is walked depth first, the best child first; a node whose
bound is below the tenth score found so far is left out with all below it, and so the result is exact. The ten best of an item
are kept from tree to tree of a task; what tasks found is merged by a window.

Score: `sum over the item's terms, repeats included, of w * ((1000000000 * tf) div (1000 * tf + 8 * m))`, in 64-bit integers, with
`w = floor(1000 * ln((2 N + 2) / (2 df + 1)))` and `m = 25 + (75 * n * N) div L`. It grows with tf and falls with m.

Bounds: items are taken in tiles of about `TILE_TERMS` distinct terms by a hash of the item (one item is never cut); a tile is what
is broadcast, and costs one more pass over the documents. A tree has at most `TREE_ROWS` documents or `TREE_CELLS` entries.
Restricted vectors are a written table below the shared folder.

Defined cases: NULL and empty texts and texts without a term are no documents of N and are never found; repeated rows are
documents of their own and tie, as others do, by ascending doc_id, NULL last; repeated items count once, unlike texts of one
item_id are one item with the terms of all; items without a term that occurs have no rows; long texts are counted whole, in pieces
of `PIECE` bytes; an empty table on either side gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pulsegrid.llm.base import written

TILE_TERMS = 1 << 15
TREE_ROWS, TREE_CELLS = 1 << 14, 1 << 21
LEAF = 64
BEST = 10
PIECE = 1 << 20

# separators (ASCII without letters and digits) as blanks, A-Z in lower case; bytes of other signs are kept
_TERMS = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def term_counts(text: bytes | None) -> Counter:
    """Terms of a UTF-8 text, as bytes, with their occurrences."""
    out, at = Counter(), 0
    plain = (text or b"").translate(_TERMS)
    while at < len(plain):
        end = plain.find(b" ", at + PIECE)
        end = len(plain) if end < 0 else end
        out.update(plain[at:end].split())
        at = end
    return out


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """item (its id), term, k (occurrences in the item)."""
    kind = items.schema[item_id].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, term, k = [], [], []
            for i, x in enumerate(batch.column("text").to_pylist()):
                n = term_counts(x)
                at += [i] * len(n)
                term += n.keys()
                k += n.values()
            yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(at, pa.int64())), pa.array(term, pa.binary()), pa.array(k, pa.int64())],
                                             ["item", "term", "k"])

    d = items.select(F.col(item_id).alias("item"), F.col(text).cast("binary").alias("text")).distinct()
    return d.mapInArrow(count, f"item {kind}, term binary, k long").groupBy("item", "term").agg(F.sum("k").alias("k"))


def vectors(docs: DataFrame, numbers, doc_id: str, text: str) -> DataFrame:
    """doc_id, n (all terms), terms (numbers of the terms that `numbers`, a broadcast, has) and tf of every document with a term."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def restrict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = numbers.value
        for batch in batches:
            at, n, ends, terms, tf = [], [], [0], [], []
            for i, x in enumerate(batch.column("text")):
                counts = term_counts(x.as_py())
                if counts:
                    own = number.keys() & counts.keys()
                    at.append(i)
                    n.append(counts.total())
                    terms += map(number.__getitem__, own)
                    tf += map(counts.__getitem__, own)
                    ends.append(len(terms))
            ends_ = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends_, pa.array(terms, pa.int32())),
                 pa.ListArray.from_arrays(ends_, pa.array(tf, pa.int32()))], ["doc_id", "n", "terms", "tf"])

    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return d.mapInArrow(restrict, f"doc_id {kind}, n long, terms array<int>, tf array<int>")


def gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Tree:
    """FP-tree of documents: nodes are runs of documents in the order of their vectors.

    place: document of every entry; rank: its term, 0 for the most frequent, rising within a document; tf; m: of the documents."""

    def __init__(self, place: np.ndarray, rank: np.ndarray, tf: np.ndarray, m: np.ndarray, ranks: int, leaf: int = LEAF):
        sizes = np.bincount(place, minlength=len(m))
        start = np.r_[0, np.cumsum(sizes)]
        keys = rank.astype(">u4").tobytes()
        vector = [keys[4 * a:4 * b] for a, b in zip(start, start[1:])]
        self.order = np.array(sorted(range(len(m)), key=vector.__getitem__), np.int64)
        self.m = m[self.order]
        sizes = sizes[self.order]
        first = start[self.order]
        self.edge = np.r_[0, np.cumsum(sizes)]
        entry = np.arange(len(rank)) + np.repeat(first - self.edge[:-1], sizes)
        self.rank, self.tf = rank[entry], tf[entry].astype(np.int64)
        self.place = np.repeat(np.arange(len(m)), sizes)
        self._grow([vector[i] for i in self.order], sizes, leaf)
        # maxima of tf and minima of m, from the leaves up; one column per node
        self.most, self.least_m = np.zeros((ranks, len(self.run)), np.int32), np.zeros(len(self.run), np.int64)
        for v in range(len(self.run) - 1, -1, -1):
            a, b = self.run[v]
            self.least_m[v] = self.m[a:b].min()
            if self.children[v]:
                self.most[:, v] = self.most[:, self.children[v]].max(1)
            else:
                e = slice(self.edge[a], self.edge[b])
                np.maximum.at(self.most[:, v], self.rank[e], self.tf[e])

    def _grow(self, vector: list[bytes], sizes: np.ndarray, leaf: int) -> None:
        """run (first and behind last document) and children of every node; children have larger numbers."""
        self.run, self.children = [(0, len(vector))], [[]]
        todo = [0]
        while todo:
            v = todo.pop()
            a, b = self.run[v]
            if b - a <= leaf:
                continue
            # what the first and the last document share is shared by all between
            x, y = vector[a], vector[b - 1]
            depth = next((i for i in range(min(len(x), len(y)) // 4) if x[4 * i:4 * i + 4] != y[4 * i:4 * i + 4]), min(len(x), len(y)) // 4)
            at = self.edge[a:b] + depth
            term = np.where(sizes[a:b] > depth, self.rank[np.minimum(at, len(self.rank) - 1)], -1) if len(self.rank) else np.full(b - a, -1)
            cuts = [a, *(np.flatnonzero(np.diff(term)) + 1 + a).tolist(), b]
            if len(cuts) == 2:      # equal vectors
                cuts = [*range(a, b, leaf), b]
            lo = a
            for i in range(1, len(cuts)):
                # small neighbours stand together until they fill a leaf
                if i == len(cuts) - 1 or cuts[i + 1] - lo > leaf:
                    self.run.append((lo, cuts[i]))
                    self.children.append([])
                    self.children[v].append(len(self.run) - 1)
                    todo.append(len(self.run) - 1)
                    lo = cuts[i]

    def best(self, ranks: np.ndarray, weight: np.ndarray, least: int, keep: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Documents and scores from which the `keep` best can be taken, given that scores below `least` are not among them. A
        caller may raise the bar by sending it a larger one."""
        bound = weight @ gain(self.most[ranks].astype(np.int64), self.least_m)
        own = np.zeros(len(self.most), np.int64)
        own[ranks] = weight
        todo = [0]
        while todo:
            v = todo.pop()
            if bound[v] < least:
                continue
            if self.children[v]:
                todo += sorted(self.children[v], key=bound.__getitem__)     # the best is taken first
                continue
            a, b = self.run[v]
            e = slice(self.edge[a], self.edge[b])
            use = np.flatnonzero(own[self.rank[e]]) + e.start
            place = self.place[use]
            score = np.zeros(b - a, np.int64)
            np.add.at(score, place - a, own[self.rank[use]] * gain(self.tf[use], self.m[place]))
            good = np.flatnonzero(score >= least)
            if len(good):
                least = max(least, (yield self.order[a + good], score[good]) or 0)


def search(docs: DataFrame, items: DataFrame, best: int = BEST, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
           item_text: str = "text", tile_terms: int = TILE_TERMS, tree_rows: int = TREE_ROWS, leaf: int = LEAF) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the `best` documents of every item with a score above 0."""
    spark = docs.sparkSession
    terms = written(item_terms(items, item_id, item_text), "item_terms")
    tiles = max(1, math.ceil(terms.count() / tile_terms))
    found = [_tile(docs, terms.filter(F.pmod(F.xxhash64("item"), F.lit(tiles)) == t) if tiles > 1 else terms, best, doc_id, text, tree_rows, leaf)
             for t in range(tiles)]
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
    return ranked.select(F.col("item").alias(item_id), "rank", F.col("doc_id").alias(doc_id), "score")


def _tile(docs: DataFrame, terms: DataFrame, best: int, doc_id: str, text: str, tree_rows: int, leaf: int) -> DataFrame:
    """item, doc_id, score: what every task found for the items of `terms`, a tile."""
    sc = docs.sparkSession.sparkContext
    mine = terms.toArrow().to_pydict()          # about TILE_TERMS rows
    names = sorted(set(mine["term"]))
    v = written(vectors(docs, sc.broadcast({t: i for i, t in enumerate(names)}), doc_id, text), "vectors")
    total, length = v.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(names), np.int64)
    for r in v.select(F.explode("terms").alias("term")).groupBy("term").count().collect():      # one row a term of the tile
        df[r["term"]] = r["count"]
    rank = np.empty(len(names), np.int64)
    rank[np.argsort(-df, kind="stable")] = np.arange(len(names))
    weight = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * int(k) + 1))) for k in df], np.int64)
    asked: dict = {}
    number = {t: i for i, t in enumerate(names)}
    for item, term, k in zip(mine["item"], mine["term"], mine["k"]):
        i = number[term]
        if df[i]:
            asked.setdefault(item, []).append((rank[i], k * weight[i]))
    items = [(item, np.array([r for r, _ in rw], np.int64), np.array([w for _, w in rw], np.int64)) for item, rw in asked.items()]
    known = sc.broadcast((rank, items))
    item_kind, id_kind = terms.schema["item"].dataType.simpleString(), docs.schema[doc_id].dataType.simpleString()
    id_type = to_arrow_type(docs.schema[doc_id].dataType)
    m = F.lit(25) + F.expr(f"(75L * n * {total}L) div {max(1, length)}L")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank_of, items = known.value
        top: list[list] = [[] for _ in items]

        def look(rows: list[pa.RecordBatch]) -> None:
            t = pa.Table.from_batches(rows).combine_chunks()
            lists = t.column("terms").combine_chunks()
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            r, tf = rank_of[lists.flatten().to_numpy()], t.column("tf").combine_chunks().flatten().to_numpy()
            place = np.repeat(np.arange(t.num_rows), sizes)
            order = np.argsort(place * len(rank_of) + r, kind="stable")
            ids = t.column("doc_id")
            tree = Tree(place, r[order], tf[order], t.column("m").to_numpy(), len(rank_of), leaf)
            for (_, ranks, w), held in zip(items, top):
                walker = tree.best(ranks, w, held[best - 1][0][0] * -1 if len(held) == best else 1, best)
                bar = None
                while True:
                    try:
                        documents, scores = walker.send(bar)
                    except StopIteration:
                        break
                    if len(documents) > best:       # ties at the tenth place stay
                        tenth = np.partition(scores, -best)[-best]
                        documents, scores = documents[scores >= tenth], scores[scores >= tenth]
                    new = [ids[d].as_py() for d in documents.tolist()]
                    held += [((-s, i is None, i if i is not None else 0), i) for s, i in zip(scores.tolist(), new)]
                    held.sort(key=lambda h: h[0])
                    del held[best:]
                    bar = -held[-1][0][0] if len(held) == best else None

        waiting, rows, cells = [], 0, 0
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                waiting.append(part)
                rows += part.num_rows
                cells += len(part.column("terms").flatten())
                if rows >= tree_rows or cells >= TREE_CELLS:
                    look(waiting)
                    waiting, rows, cells = [], 0, 0
        if rows:
            look(waiting)
        flat = [(i, d, -k[0]) for i, held in enumerate(top) for k, d in held]
        i, d, s = zip(*flat) if flat else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(d, id_type), pa.array(s, pa.int64())], ["at", "doc_id", "score"])

    found = v.select("doc_id", "terms", "tf", m.alias("m")).filter(F.size("terms") > 0).mapInArrow(walk, f"at long, doc_id {id_kind}, score long")
    own = docs.sparkSession.createDataFrame([(i, item) for i, (item, _, _) in enumerate(items)], f"at long, item {item_kind}")
    return found.join(F.broadcast(own), "at").select("item", "doc_id", "score")     # one row an item of the tile
