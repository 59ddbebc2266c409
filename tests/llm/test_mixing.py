"""Budget fitting, targets and the seeded choice."""

import random
import re
from collections import Counter

import pytest

from pulsegrid.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def reachable(lengths, counts):
    sums = {0}
    for n, c in zip(lengths, counts):
        sums = {s + n * k for s in sums for k in range(c + 1)}
    return sums


def test_fit_is_the_nearest_subset_sum():
    rng = random.Random(1)
    for _ in range(400):
        lengths = rng.sample(range(1, 40), rng.randint(1, 6))
        counts = [rng.randint(1, 4) for _ in lengths]
        budget = rng.randint(0, sum(a * b for a, b in zip(lengths, counts)))
        take = mixing.fit_counts(lengths, counts, budget)
        assert all(0 <= k <= c for k, c in zip(take, counts))
        got = sum(a * b for a, b in zip(lengths, take))
        assert abs(got - budget) == min(abs(s - budget) for s in reachable(lengths, counts))


def water(sizes, weights=(5.0, 2.0, 1.0)):
    """Targets by resharing the excess until none is above its limit."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    fixed = {}
    while True:
        free = [s for s in names if s not in fixed]
        left = sum(sizes.values()) - sum(fixed.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in over}


def test_mix_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(500):
        source = rng.choice(["b", "a", "a", "a", "a", "ä", "Z", None, "tiny"]) if i else "tiny"
        n = rng.choice([0, 1, 5, rng.randint(1, 60)]) if source != "tiny" else 1
        rows.append((i, " \t".join("w" * rng.randint(1, 3) for _ in range(n)) or rng.choice([None, "", " \n"]), source))
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    again = mixing.mix(spark.createDataFrame(rows[::-1], SCHEMA).repartition(5)).collect()
    assert len(got) == len(rows) and sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in again)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    whole, taken = Counter(), Counter()
    for i, _, s in rows:
        whole[s] += size[i]
    want = water(dict(whole))
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == whole[r["source"]] and r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        assert r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in whole)


def test_large_groups_are_chosen_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 10)
    rows = [(i, "a b c", "s") for i in range(300)] + [(i, "a b", "t") for i in range(300, 900)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    per = {s: sum(r["taken"] for r in got if r["source"] == s) for s in ("s", "t")}
    assert per == {"s": 1500, "t": 600}


def test_repeated_rows_stand_as_often_as_taken(spark):
    rows = [(1, "a b c d", "s"), (1, "a b c d", "s"), (None, "a b", "s"), (2, "x " * 40, "t"), (3, None, "t")]
    df = spark.createDataFrame([(*r, 9, "k") for r in rows], SCHEMA + ", size int, copies string")
    taken = Counter()
    for r in mixing.mix(df).collect():
        taken[r["doc_id"]] += r["copies"]
    stood = Counter(r["doc_id"] for r in mixing.repeated(df).collect())
    assert stood == +taken and mixing.repeated(df).columns == df.columns


def test_equal_rows_of_different_sources_keep_their_copies(spark):
    rows = [(i, "a b c", s) for i in range(20) for s in ("s", "t", None)]
    for given in (rows, rows[::-1]):
        df = spark.createDataFrame(given, SCHEMA).coalesce(1)
        taken = Counter()
        for r in mixing.mix(df).collect():
            taken[r["doc_id"], r["source"]] += r["copies"]
        assert Counter((r["doc_id"], r["source"]) for r in mixing.repeated(df).collect()) == +taken


def test_only_ranges_taken_in_part_are_ranked(spark):
    d = spark.createDataFrame([(i, i, "s", 3, i, 1, n, 4) for n in (-2, 0, 3, 4, 9) for i in range(4)],
                              "doc_id long, tag long, source string, size long, h long, copies int, open long, here long")
    assert sorted((r["doc_id"], r["copies"]) for r in mixing.ranked(d).collect()) == [(0, 2), (1, 2), (2, 2), (3, 1)]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(df).count() == 0 and mixing.repeated(df).count() == 0
    only = spark.createDataFrame([(1, None, None), (2, "", None)], SCHEMA)
    assert [(r["taken"], r["target"]) for r in mixing.mix(only).collect()] == [(0, 0.0)] * 2
