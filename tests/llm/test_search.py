"""Near duplicates and nearest neighbours against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import neardup, neighbours


def bag(text):
    w = re.findall(r"\w+", (text or "").lower())
    if not w:
        return Counter({("raw", text or ""): 1})
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4)))


def likeness(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def classes(rows):
    bags = [bag(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if likeness(bags[i], bags[j]) >= 0.8 and find(i) != find(j):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, least.get(find(i))) for i, (d, _) in enumerate(rows)]


def test_signature_agreement_is_the_weighted_jaccard_index():
    rng = np.random.default_rng(1)
    for k in range(3):
        a = Counter({i: int(rng.integers(1, 12)) for i in range(50)})
        b = Counter({i: max(0, n + int(rng.integers(-3, 4))) for i, n in a.items()}) + Counter({100 + i: 4 for i in range(5)})
        own = np.repeat([0, 1], [len(a), len(b)])
        with np.errstate(over="ignore"):
            h = neardup.mix(np.array([*a, *b], np.uint64) + np.uint64(1000 * k))
        s = neardup.signatures(own, h, np.array([*a.values(), *b.values()]), 2, 20_000)
        assert (s[0] == s[1]).mean() == pytest.approx(likeness(a, b), abs=0.02)


def corpus():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(2000)]
    passage = rng.choices(words, k=60)
    rows, n = [], 0
    for _ in range(12):
        base = rng.choices(words, k=rng.randint(30, 120))
        for _ in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((n, " ".join(w)))
            n += 1
    for _ in range(25):      # unlike texts that share a long passage
        rows.append((n, " ".join(rng.choices(words, k=40) + passage + rng.choices(words, k=20))))
        n += 1
    chain = rng.choices(words, k=200)
    for k in range(12):      # each like the next one, not like all
        chain = chain[4:] + rng.choices(words, k=4)
        rows.append((n, " ".join(chain)))
        n += 1
    rows += [(n, "Same Words, here are six."), (n + 1, "same words here ARE six"), (n + 2, "a b"), (n + 3, "A, b!"), (n + 4, ""), (n + 5, None), (n + 6, "!!"), (n + 7, "??"),
             (n + 8, "x " * 400), (n + 9, "x " * 380), (0, rows[0][1]), (None, rows[1][1])]
    return rows


def test_classes_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, content string").repartition(4)
    got = neardup.near_duplicates(df).collect()
    want = classes(rows)
    assert Counter((r["doc_id"], r["class_id"]) for r in got) == Counter(want)
    size = Counter(c for _, c in want)
    assert all(r["class_size"] == size[r["class_id"]] for r in got)


def test_pairs_that_stars_do_not_test_are_found(spark):
    """Members of a bucket that are like each other but not like its smallest member."""
    bucket = spark.createDataFrame([(0, 1, 4, b"a", x) for x in (b"a", b"b", b"c", b"d")], "band int, key long, n long, a binary, b binary")
    none = spark.createDataFrame([], "node binary, root binary")
    assert sorted(bytes(r["content"]) for r in neardup._still_open(bucket, none).collect()) == [b"b", b"c", b"d"]
    joined = spark.createDataFrame([(x, b"r") for x in (b"a", b"b", b"c", b"d")], "node binary, root binary")
    assert neardup._still_open(bucket, joined).count() == 0


def packed(words):
    return bytearray(np.sort(np.array(words, np.uint64)).tobytes())


@pytest.mark.parametrize("seed", range(2))
def test_second_look_finds_every_pair_and_little_else(spark, seed):
    """A group of copies of one text just around the threshold, pieces that stand several times, and sizes from 1 to 300."""
    rng = np.random.default_rng(seed)
    base = rng.integers(1, 1 << 60, 100).astype(np.uint64)
    bags = []
    for _ in range(150):
        w = base.copy()
        at = rng.choice(100, rng.integers(6, 12), replace=False)
        w[at] = rng.integers(1, 1 << 60, len(at))
        bags.append(w)
    bags += [np.repeat(rng.integers(1, 1 << 60, 3).astype(np.uint64), k) for k in ((5, 5, 5), (1, 0, 0))]
    bags += [np.repeat(np.uint64(7), k) for k in (1, 2, 4, 5, 9, 10, 12, 100, 124, 125, 126)] + [base[:80], base[:79], np.r_[base, base[:25]]]
    rows = [(bytes([i // 256, i % 256]), bytes([i // 256, i % 256]) if i % 10 else b"x", packed(b)) for i, b in enumerate(bags)]
    open_ = spark.createDataFrame(rows, "content binary, root binary, bag binary").repartition(3)
    got = {(bytes(r["a"]), bytes(r["b"])) for r in neardup._untested(open_, 0.8).collect()}
    counts = [Counter(b.tolist()) for b in bags]
    want = {(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i + 1, len(rows))
            if rows[i][1] != rows[j][1] and likeness(counts[i], counts[j]) >= 0.8}
    assert want and want <= got and len(got) < len(rows) ** 2 / 4


def test_one_row_of_each_class_stays(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, tag string")
    left = neardup.keep_one(df)
    got = [r["doc_id"] for r in left.collect()]
    assert sorted(got) == sorted({c for _, c in classes(rows)}) and left.columns == df.columns
    assert neardup.keep_one(df.limit(0)).count() == 0


def test_unlike_texts_without_id_or_of_one_id_stay(spark):
    texts = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcdef"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (9, texts[3] + " more"), (None, texts[2]), (None, texts[4]), (7, texts[4]), (None, texts[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (7, texts[4]), (None, texts[5])]
    assert Counter((r["doc_id"], r["text"]) for r in neardup.keep_one(df).collect()) == Counter(kept)
    got = neardup.near_duplicates(df).collect()
    size = Counter(r["class_key"] for r in got)
    assert len(got) == len(rows) and sorted(size.values()) == [1, 1, 2, 2, 2, 2] and all(r["class_size"] == size[r["class_key"]] for r in got)
    ids = {r["class_key"]: r["class_id"] for r in got}
    assert Counter(ids.values()) == Counter(d for d, _ in kept)


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(150, 151), (151, 150), (200, 200)]
    got = {r["node"]: r["root"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)} | {150: 150, 151: 150}


def test_no_plan_of_near_duplicates_repeats_its_steps(spark, monkeypatch):
    seen, write = [], neardup.written

    def exchanges(df):
        seen.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange "))

    monkeypatch.setattr(neardup, "written", lambda df, name: (exchanges(df), write(df, name))[1])
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:50] + [f"x{i}"])) for i in range(6)] + [(9, "alone here with some more words"), (10, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = neardup.keep_one(df)
    exchanges(left)
    assert sorted(r["doc_id"] for r in left.collect()) == [0, 9, 10]
    assert max(seen) <= 8, seen     # 15 before, where a round of components was one plan


def nearest(rows, top=20):
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    ids, x = [i for i, _ in ok], np.array([v for _, v in ok])
    out = {}
    for i, v in ok:
        if i % 20 == 0:
            s = x @ v
            order = sorted((k for k in range(len(ids)) if ids[k] != i), key=lambda k: (-s[k], ids[k]))[:top]
            out[i] = [(ids[k], s[k]) for k in order]
    return out


def test_neighbours_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 16))
    rows = [(i, (centres[i % 20] + 0.6 * rng.normal(size=16)).tolist()) for i in range(4000)]
    got = {}
    for r in neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, per_list=40).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    want = nearest(rows)
    assert got.keys() == want.keys()
    hit = 0
    exact = {i: np.array(v) for i, v in rows}
    for q, near in want.items():
        assert sorted(got[q]) == list(range(1, 21))
        hit += len({i for i, _ in near} & {i for i, _ in got[q].values()})
        for i, s in got[q].values():
            assert s == pytest.approx(float(exact[q] @ exact[i]), rel=1e-12)
    assert hit / (20 * len(want)) > 0.9


def test_no_list_is_above_twice_the_mean():
    rng = np.random.default_rng(4)
    x = np.exp(2 * rng.normal(size=(4000, 4)))
    c = neighbours.fit_centres(x, 40)
    n = np.bincount(((x[:, None, :] - c) ** 2).sum(2).argmin(1), minlength=len(c))
    assert n.max() <= 2 * len(x) / 40 and 40 <= len(c) < 100


def test_few_and_bad_vectors_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0]) for i in range(0, 70)] + [(100, [2.0, 1.0]), (101, [0.0, 0.0]), (102, None), (103, [nan, 1.0]), (104, [inf, 1.0]), (105, [None, 1.0]), (None, [1.0, 1.0]),
            (100, [2.0, 1.0])]
    df = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<double>, list string")
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = nearest(list({i: (i, v) for i, v in rows if i is not None}.values()))
    assert {q: [(i, pytest.approx(s)) for _, i, s in sorted(v)] for q, v in got.items()} == want
    assert neighbours.search(df.limit(0), F.lit(True)).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (20, [-1.0]), (3, [0.5])], "vec_id long, embedding array<float>")
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.search(few, F.col("vec_id") % 20 == 0).collect()) == [
        (0, 1, 3), (0, 2, 20), (20, 1, 3), (20, 2, 0)]


def test_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(200)]
    got = {}
    for r in neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert {q: [i for _, i in sorted(v)] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in nearest(rows).items()}
