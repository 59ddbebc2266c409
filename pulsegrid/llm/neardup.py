"""MinHash near-duplicates of multisets: BagMinHash signatures, banding, exact verification, components.

A text is the multiset of its shingles of five words (letters and digits, lower case). Signatures come from Poisson
processes over discretised weights: the weight axis of a shingle is cut into the dyadic intervals (0,1], (1,2], (2,4], ...,
each with its own process whose rate is its width; a point has a level inside its interval and one of `SIZE` components and
counts if its level is at most the shingle's count. The least time per component is the signature, so two components agree
with the probability of the weighted Jaccard index. Points come in order of time and a process stops at the largest time
its signature still holds.

Steps. Texts of equal shingle multisets are one member. Members that share a band form a bucket. Every bucket is linked
through its smallest member: pairs whose signatures agree enough are verified exactly on the multisets. Members of a bucket
that are still in different components may be alike without being like the smallest one; they are joined with one another by an
exact prefix filter: their shingles are put in order, the rarest first, and two that reach 0.8 share one of their first few,
with enough shingles left behind it in both (see `_prefixes`). Pairs across components that pass are verified too. Components of the
verified links are the classes. Multisets whose sizes are too far apart to reach 0.8 are no pair anywhere.

Bounds: a bucket never meets in one task: its smallest member comes from an aggregate, links from joins. Pairs inside one
component are not made. The order needs no exact counts: shingles are counted in `CELLS` cells, which are what is broadcast.
Signatures, members and prefixes live in written tables below the shared folder.

The chance that banding misses a pair of exactly 0.8 is (1 - 0.8^5)^24, under 1 in 10,000; above 0.85 it is under 1 in
500,000. The signature test of the first look misses about 1 in 30,000 of those at exactly 0.8; the second look misses none.

Defined cases: NULL text is empty; texts without a word are alike only if they are equal; texts of fewer than five words
are one shingle; repeated rows are copies; ties are settled by the smallest id; an empty table gives no rows; other columns
are not read. Rows without id or of one repeated id take part like others: classes of unlike texts may then have the same
class_id and are told apart by class_key. A NULL id comes after all others, so class_id is NULL only if no row has an id.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.base import join_tagged, text_tag, written

SHINGLE = 5
ROWS, BANDS = 5, 24
SIZE = ROWS * BANDS
LEAST = 0.8
LIKELY = SIZE * 13 // 20  # agreeing components from which a pair is verified; 78 of 120, where 96 are expected at 0.8
WORD = re.compile(r"\w+")
MOST_WORDS = 150_000
PIECE = 1 << 19     # signs handled at a time
SLICE = 1000        # rows taken out of a batch at a time
CELL_BITS = 20
CELLS = 1 << CELL_BITS
RECENT = 8
PARITIES = 512      # bits that a member carries to tell how many shingles it does not share

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_words = _Words()


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle, count) of all texts, sorted by number and shingle."""
    lists = [WORD.findall(t.lower()) for t in texts]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    ids = np.fromiter((h for words in lists for h in map(_words.__getitem__, words)), np.uint64, int(sizes.sum()))
    first = np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64) if len(sizes) else np.zeros(0, np.int64)
    own = np.repeat(np.arange(len(texts)), sizes)
    left = np.repeat(first + sizes, sizes) - np.arange(len(ids))     # words from here to the end of the text
    with np.errstate(over="ignore"):
        h = np.zeros(len(ids), np.uint64)
        for k in range(SHINGLE):
            shifted = np.zeros(len(ids), np.uint64)
            shifted[:max(0, len(ids) - k)] = ids[k:]
            h = h * U(0x9E3779B97F4A7C15) + np.where(left > k, mix(shifted + U(k)), U(0))
        h = mix(h)
    # a start counts if five words follow, or if it is the start of a short text
    begins = np.zeros(len(ids), bool)
    begins[first[sizes > 0]] = True
    use = (left >= SHINGLE) | (begins & (left < SHINGLE))
    own, h = own[use], h[use]
    order = np.lexsort((h, own))
    own, h = own[order], h[order]
    new = np.r_[True, (own[1:] != own[:-1]) | (h[1:] != h[:-1])] if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return own[at], h[at], np.diff(np.r_[at, len(h)])


def signatures(own: np.ndarray, shingle: np.ndarray, count: np.ndarray, texts: int, size: int = SIZE) -> np.ndarray:
    """Times of the BagMinHash signature of every text, texts x size; infinite where a text has no shingle."""
    least = np.full(texts * size, np.inf)
    # one process per shingle and dyadic interval that its count reaches into
    level = np.where(count > 1, np.ceil(np.log2(np.maximum(count, 1))), 0).astype(np.int64)
    times = level + 1
    item = np.repeat(np.arange(len(own)), times)
    k = np.arange(len(item)) - np.repeat(np.cumsum(times) - times, times)
    low = np.where(k == 0, 0, 1 << np.maximum(k - 1, 0))
    width = np.where(k == 0, 1, low)
    inside = count[item] - low                                      # levels of the interval that count
    text, time = own[item], np.zeros(len(item))
    with np.errstate(over="ignore"):
        state = mix(shingle[item] + U(0xD1342543DE82EF95) * k.astype(np.uint64))
        while len(text):
            state = state + U(0x9E3779B97F4A7C15)
            a, b = mix(state), mix(state ^ U(0xA0761D6478BD642F))
            time = time - np.log1p(-(a >> U(11)).astype(np.float64) * 2.0 ** -53) / width
            spot = ((b & U(0xFFFFFFFF)) * U(size) >> U(32)).astype(np.int64)
            rank = ((b >> U(32)) * width.astype(np.uint64) >> U(32)).astype(np.int64)
            hit = rank < inside
            np.minimum.at(least, text[hit] * size + spot[hit], time[hit])
            go = time <= least.reshape(texts, size).max(1)[text]
            text, time, state, width, inside = text[go], time[go], state[go], width[go], inside[go]
    return least.reshape(texts, size)


def folded(least: np.ndarray) -> np.ndarray:
    """64-bit values of signature times."""
    with np.errstate(over="ignore"):
        return mix(least.view(np.uint64))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Rows of about PIECE signs together, with their texts; a longer text stands alone or last."""
    for whole in batches:
        for at in range(0, whole.num_rows, SLICE):
            batch = whole.slice(at, SLICE)
            texts, start, size = batch.column("text").to_pylist(), 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= PIECE or i == len(texts) - 1:
                    yield batch.slice(start, i + 1 - start), texts[start:i + 1]
                    start, size = i + 1, 0


def _content(text: str, h: np.ndarray, count: np.ndarray) -> bytes:
    """16 bytes that are equal for equal multisets; of the text itself if it has no word."""
    if not len(h):
        return xxhash.xxh3_128_digest(b"text " + text.encode("utf-8", "surrogatepass"))
    return xxhash.xxh3_128_digest(h.tobytes() + count.astype(np.int64).tobytes())


def sketch(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, tag (of the text), content (16 bytes, equal for equal multisets), size, sign (two bytes per component; empty without words), bands."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, part in _runs(batches):
            content, size, sign, bands = [], [], [], []
            own, h, count = shingles(part)
            value = folded(signatures(own, h, count, len(part)))
            short = (value & U(0xFFFF)).astype("<u2")
            with np.errstate(over="ignore"):
                key = np.zeros((len(part), BANDS), np.uint64)
                for j in range(ROWS):
                    key = mix(key * U(31) + value.reshape(len(part), BANDS, ROWS)[:, :, j] + np.arange(BANDS, dtype=np.uint64))
            edges = np.searchsorted(own, np.arange(len(part) + 1))
            for i, t in enumerate(part):
                lo, hi = edges[i], edges[i + 1]
                content.append(_content(t, h[lo:hi], count[lo:hi]))
                size.append(int(count[lo:hi].sum()))
                sign.append(short[i].tobytes() if lo < hi else b"")
                bands.append(key[i].view(np.int64) if lo < hi else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tag"), pa.array(content, pa.binary()), pa.array(size, pa.int64()), pa.array(sign, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "tag", "content", "size", "sign", "bands"])

    d = docs.select(F.col(doc_id).alias("doc_id"), text_tag(text).alias("tag"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, tag long, content binary, size long, sign binary, bands array<long>")


def agreeing(pairs: DataFrame, least: int) -> DataFrame:
    """Rows (a, b) of `pairs` (a, b, sa, sb) whose signatures have at least `least` equal components."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(batch.num_rows, SIZE) for c in ("sa", "sb"))
            yield batch.select(["a", "b"]).filter(pa.array((u == v).sum(1) >= least))

    return pairs.select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary")


def overlap(a: bytes, b: bytes) -> float:
    """Weighted Jaccard index of two sorted multisets, packed as 64-bit shingles in which an equal one stands again."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    u, nu = np.unique(x, return_counts=True)
    v, nv = np.unique(y, return_counts=True)
    _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    both = np.minimum(nu[i], nv[j]).sum()
    return float(both / (len(x) + len(y) - both)) if len(x) + len(y) else 1.0


def exact(pairs: DataFrame, least: float) -> DataFrame:
    """a, b and likeness of `pairs` (a, b, ba, bb: packed multisets) that reach `least`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            likeness = np.array([overlap(x.as_py(), y.as_py()) for x, y in zip(batch.column("ba"), batch.column("bb"))], float)
            found = likeness >= least - 1e-12
            yield pa.RecordBatch.from_arrays([*batch.select(["a", "b"]).filter(pa.array(found)).columns, pa.array(likeness[found])], ["a", "b", "likeness"])

    return pairs.select("a", "b", "ba", "bb").mapInArrow(run, "a binary, b binary, likeness double")


def bags(texts: DataFrame) -> DataFrame:
    """content and bag, the packed sorted multiset of shingles, of every row of `texts` (text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in _runs(batches):
            own, h, count = shingles(part)
            edges = np.searchsorted(own, np.arange(len(part) + 1))
            cuts = [slice(a, b) for a, b in zip(edges, edges[1:])]
            content = [_content(t, h[c], count[c]) for t, c in zip(part, cuts)]
            bag = [np.repeat(h[c], count[c]).tobytes() for c in cuts]
            yield pa.RecordBatch.from_arrays([pa.array(content, pa.binary()), pa.array(bag, pa.binary())], ["content", "bag"])

    return texts.select("text").mapInArrow(run, "content binary, bag binary")


def near_size(x: Column, y: Column, least: float) -> Column:
    """Sizes of multisets that can reach `least`."""
    return F.least(x, y) >= F.greatest(x, y) * F.lit(least - 1e-9)


def likely(pairs: DataFrame, signs: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of contents whose sizes and signatures allow `least`. signs: content, size, sign."""
    p = (pairs.join(signs.select(F.col("content").alias("a"), F.col("size").alias("na"), F.col("sign").alias("sa")), "a")
         .join(signs.select(F.col("content").alias("b"), F.col("size").alias("nb"), F.col("sign").alias("sb")), "b"))
    return written(agreeing(p.filter(near_size(F.col("na"), F.col("nb"), least)), LIKELY), "likely")


def bags_of(wanted: DataFrame, members: DataFrame, texts: DataFrame) -> DataFrame:
    """content and bag of the members in `wanted` (content, distinct). members: content, first; texts: doc_id, text."""
    first = wanted.join(members.select("content", "first"), "content").select("first").distinct().hint("shuffle_hash")
    chosen = texts.join(first, F.col("doc_id").eqNullSafe(F.col("first")), "left_semi")
    return written(bags(chosen).dropDuplicates(["content"]), "bags")


def verified(pairs: DataFrame, bag: DataFrame, least: float) -> DataFrame:
    """Links (a, b, likeness): pairs whose multisets reach `least`. bag: content, bag."""
    full = (pairs.join(bag.select(F.col("content").alias("a"), F.col("bag").alias("ba")), "a")
            .join(bag.select(F.col("content").alias("b"), F.col("bag").alias("bb")), "b"))
    return written(exact(full, least), "links")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node of an undirected graph; root is the smallest node of its component.

    Alternates two steps until nothing changes: every node hands its smallest neighbour to its larger ones, and every node
    hands the smallest of its smaller neighbours to the others. Both are an aggregate and a join over the links, and each is
    written by itself: in one plan the first would stand four times, which the driver has to plan, compile and follow.
    """
    def pairs(*of: tuple[str, str]) -> Column:
        return F.inline(F.array(*[F.struct(F.col(x).alias("u"), F.col(y).alias("v")) for x, y in of]))

    e = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct(), "graph")
    state = None
    while True:     # u > v in every row
        low = e.select(pairs(("u", "v"), ("v", "u"))).groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
        large = written(e.join(low, "v").select("u", F.col("m").alias("v")), "graph")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        e = written(large.join(low, "u").select(pairs(("u", "m"), ("v", "m"))).filter("u != v").distinct(), "graph")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return written(e.select(pairs(("u", "v"), ("v", "v"))).select(F.col("u").alias("node"), F.col("v").alias("root")).distinct(), "components")


def _still_open(bucket: DataFrame, found: DataFrame) -> DataFrame:
    """content and root of the members that share a bucket with another component without being its smallest member."""
    b = bucket.filter((F.col("n") > 2) & (F.col("a") != F.col("b"))).select("band", "key", "b")
    b = b.join(found.select(F.col("node").alias("b"), "root"), "b", "left").withColumn("root", F.coalesce("root", "b"))
    mixed = b.groupBy("band", "key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x != y").select("band", "key")
    return b.join(mixed, ["band", "key"]).select(F.col("b").alias("content"), "root").distinct()


def tokens(bag: bytes) -> np.ndarray:
    """One value for every shingle of a packed multiset, also for every time it stands again."""
    h = np.frombuffer(bag, np.uint64)
    nth = np.arange(len(h)) - np.searchsorted(h, h)
    with np.errstate(over="ignore"):
        return np.where(nth > 0, mix(h + mix(nth.astype(np.uint64))), h)


def _frequencies(bag: DataFrame) -> np.ndarray:
    """How often the tokens of all bags fall into each of `CELLS` cells, by their upper bits."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(CELLS, np.int64)
        for batch in batches:
            for x in batch.column("bag").to_pylist():
                np.add.at(n, _cell(tokens(x)), 1)
        at = np.flatnonzero(n)
        for k in range(0, len(at), 10_000):
            part = at[k:k + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(n[part])], ["cell", "n"])

    t = bag.select("bag").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CELLS, np.int64)
    out[t.column("cell").to_numpy()] = t.column("n").to_numpy()
    return out


def _cell(token: np.ndarray) -> np.ndarray:
    return (mix(token) >> U(64 - CELL_BITS)).astype(np.int64)


def _prefixes(open_: DataFrame, least: float) -> DataFrame:
    """token, place (from 0), content, root, size, `short` and the parities of the tokens by which a member must be found, rarest first.

    Two multisets of n <= m tokens reach `least` = t only if they share t m and t (n + m) / (1 + t) tokens, at least 2 t n / (1 + t).
    In any common order of tokens the first shared one is therefore among the first n - ceil(2 t n / (1 + t)) + 1 of the smaller
    one (`short`) and among the first m - ceil(t m) + 1 of the larger one. The parities q0, q1, ... of the counts in `PARITIES` cells differ
    in at most as many places as there are tokens that only one of them has. `recent` are the `RECENT` tokens before it:
    where two share one of those too, the pair has come already. open_: content, root, bag."""
    words = PARITIES // 64
    known = open_.sparkSession.sparkContext.broadcast(_frequencies(open_).astype(np.int32))     # CELLS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 100):
                batch = whole.slice(k, 100)
                row, token, place, size, short, parity, recent = [], [], [], [], [], [], []
                for i, x in enumerate(batch.column("bag").to_pylist()):
                    t = tokens(x)
                    n = len(t)
                    parity.append(np.packbits((np.bincount((mix(t ^ U(0x5851F42D4C957F2D)) & U(PARITIES - 1)).astype(np.int64), minlength=PARITIES) & 1).astype(np.uint8)).view(np.int64))
                    t = t[np.lexsort((t, known.value[_cell(t)]))][:n - math.ceil(least * n - 1e-9) + 1]
                    row.append(np.full(len(t), i))
                    token.append(t.view(np.int64))
                    back = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(RECENT, np.int64), token[-1]]), RECENT)[:len(t)]
                    recent.append(back[np.arange(RECENT) >= RECENT - np.arange(len(t))[:, None]])
                    place.append(np.arange(len(t)))
                    size.append(np.full(len(t), n))
                    short.append(np.arange(len(t)) < n - math.ceil(2 * least * n / (1 + least) - 1e-9) + 1)
                at = np.concatenate(row)
                rows, bits, places = pa.array(at), np.stack(parity)[at], np.concatenate(place)
                ends = np.concatenate([[0], np.cumsum(np.minimum(places, RECENT))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(token)), pa.array(places), batch.column("content").take(rows), batch.column("root").take(rows),
                     pa.array(np.concatenate(size)), pa.array(np.concatenate(short)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(recent))), *[pa.array(bits[:, k]) for k in range(words)]],
                    ["token", "place", "content", "root", "size", "short", "recent", *[f"q{k}" for k in range(words)]])

    kinds = "".join(f", q{k} long" for k in range(words))
    return open_.select("content", "root", "bag").mapInArrow(run, f"token long, place long, content binary, root binary, size long, short boolean, recent array<long>{kinds}")


def _untested(open_: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of open members of different components that can reach `least`: no such pair is left out. What has too few
    tokens behind a shared one, or too many that the other lacks, is no pair; nothing is paired inside a component."""
    p = written(_prefixes(open_, least), "prefixes")
    x, y = (p.select("token", *[F.col(c).alias(k + c) for c in p.columns[1:]]) for k in "xy")
    left = lambda k: F.col(k + "size") - F.col(k + "place")  # noqa: E731  tokens from the shared one on
    apart = sum((F.bit_count(F.col(f"xq{k}").bitwiseXOR(F.col(f"yq{k}"))) for k in range(1, PARITIES // 64)), F.bit_count(F.col("xq0").bitwiseXOR(F.col("yq0"))))
    fits = ((F.struct("xsize", "xcontent") < F.struct("ysize", "ycontent")) & (F.col("xroot") != F.col("yroot")) & near_size(F.col("xsize"), F.col("ysize"), least)
            & (F.least(left("x"), left("y")) >= (F.col("xsize") + F.col("ysize")) * F.lit(least / (1 + least) - 1e-9))
            & (apart <= (F.col("xsize") + F.col("ysize")) * F.lit((1 - least) / (1 + least) + 1e-9))
            & ~F.arrays_overlap("xrecent", "yrecent"))
    both = x.filter("xshort").join(y, "token").filter(fits)
    return both.select(F.least("xcontent", "ycontent").alias("a"), F.greatest("xcontent", "ycontent").alias("b")).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """doc_id, tag, class_key (16 bytes in hex, another one for every class), class_id (the smallest id of its class), class_size
    (rows); one row per row of `docs`."""
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    all_ = written(sketch(texts), "sketch")
    members = written(all_.groupBy("content").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows"), F.first("size").alias("size"), F.first("sign").alias("sign"),
                                                  F.first("bands").alias("bands")), "members")
    signs = members.filter("octet_length(sign) > 0").select("content", "size", "sign")
    rows = members.select("content", F.posexplode("bands").alias("band", "key"))
    shared = rows.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("content").alias("a")).filter("n > 1")
    bucket = written(rows.join(shared, ["band", "key"]).select("band", "key", "n", "a", F.col("content").alias("b")), "buckets")
    pairs = likely(bucket.filter("a != b").select("a", "b").distinct(), signs, least)
    links = verified(pairs, bags_of(pairs.select(F.explode(F.array("a", "b")).alias("content")).distinct(), members, texts), least)
    found = components(links)
    open_ = written(_still_open(bucket, found), "open")
    if not open_.isEmpty():
        bag = bags_of(open_.select("content"), members, texts)
        found = components(links.unionByName(verified(_untested(open_.join(bag, "content"), least), bag, least)))
    root = written(members.select("content", "first", "rows").join(found.withColumnRenamed("node", "content"), "content", "left").withColumn("root", F.coalesce("root", "content")), "roots")
    classes = root.groupBy("root").agg(F.min("first").alias("class_id"), F.sum("rows").alias("class_size"))
    named = root.select("content", "root").join(classes, "root").select("content", F.lower(F.hex("root")).alias("class_key"), "class_id", "class_size")
    return all_.select("doc_id", "tag", "content").join(named, "content").select("doc_id", "tag", "class_key", "class_id", "class_size")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """The row of `docs` that stands for each class: that of the smallest id; of rows of that id that of the smallest tag."""
    seen = near_duplicates(docs, doc_id, text, least).filter(F.col("doc_id").eqNullSafe(F.col("class_id")))
    stay = seen.groupBy("class_key", "doc_id").agg(F.min("tag").alias("tag")).drop("class_key")
    return join_tagged(docs, stay, doc_id, text).filter("_nth = 1").select("_row.*")
