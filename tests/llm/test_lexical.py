"""Ranked search against a score of every document."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from pulsegrid.llm import lexical
from pulsegrid.llm.queries import QUERIES, SQL

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, best=10):
    d = [(i, Counter(terms(t))) for i, t in docs]
    d = [(i, c) for i, c in d if c]
    n_docs, length = len(d), sum(c.total() for _, c in d)
    df = Counter(t for _, c in d for t in c)
    asked = {}
    for i, t in dict.fromkeys(items):
        asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for item, q in asked.items():
        scored = []
        for i, c in d:
            m = 25 + 75 * c.total() * n_docs // length
            s = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, k in q.items() if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:best], 1)]
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def run(docs, items, **opts):
    return sorted((tuple(r) for r in lexical.search(docs, items, **opts).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


@pytest.fixture(scope="module")
def tables(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    return docs, items, brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])


@pytest.mark.parametrize("opts", [{}, {"tree_rows": 30, "leaf": 3}, {"leaf": 1}, {"tile_terms": 100}], ids=str)
def test_against_brute_force(spark, tables, opts):
    docs, items, want = tables
    assert run(docs, items, **opts) == want


def test_registered_query_and_its_sql(spark, tables):
    got = QUERIES["op12_ranked_search"](spark, SF)
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.sql(SQL["op12_ranked_search"])
    assert sorted(tuple(r) for r in got.select(*rel.columns).collect()) == sorted(rel.fetchall()) == sorted(tables[2])


def test_ties_copies_and_odd_rows(spark):
    copies = [(i, "Alpha beta, BETA gamma") for i in (9, 3, 3, None, 7)] + [(i, "alpha delta") for i in range(20, 35)]
    rows = copies + [(1, None), (2, ""), (4, "  ...  "), (5, "Ünïcode ünïcode Ü中文 alpha1 alpha"), (6, "Beta-beta_beta\tbeta"), (8, "word " * 3000)]
    items = [(1, "alpha beta beta"), (1, "alpha beta beta"), (2, "nothing here"), (3, None), (4, ""), (5, "中文 ÜNÏCODE Ünïcode delta word"),
             (None, "gamma"), (6, "delta"), (6, "gamma alpha")]
    docs, q = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, ITEMS)
    want = brute(rows, items)
    for opts in ({}, {"tree_rows": 3, "leaf": 1}, {"best": 3}):
        assert run(docs, q, **opts) == brute(rows, items, opts.get("best", 10))
    extra = [F.lit(1).alias(c) for c in ("term", "n", "tf", "m", "item", "score", "rank", "k")]
    assert run(docs.select("*", *extra), q.select("*", *extra)) == want
    assert run(spark.createDataFrame([], DOCS), q) == [] and run(docs, spark.createDataFrame([], ITEMS)) == []


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 40)
    text = "Über 1b-x " * 500
    assert lexical.term_counts(text.encode()) == Counter({"Über".encode(): 500, b"1b": 500, b"x": 500})


def test_string_ids(spark):
    docs = spark.createDataFrame([("b", "one two"), ("a", "one two"), ("c", "two")], "doc_id string, text string")
    items = spark.createDataFrame([("q", "one")], "item_id string, text string")
    assert [(r[0], r[1], r[2]) for r in run_text(docs, items)] == [("q", 1, "a"), ("q", 2, "b")]


def run_text(docs, items):
    return sorted(tuple(r) for r in lexical.search(docs, items).collect())


def test_bounds_prune_and_never_lose(spark):
    """Scores of the best ten from a tree equal those of all documents, and most leaves are not read."""
    rng = np.random.default_rng(4)
    docs, ranks = 3000, 60
    place, rank = np.nonzero(rng.random((docs, ranks)) < np.linspace(0.7, 0.02, ranks))
    tf, m = rng.integers(1, 6, len(place)), rng.integers(30, 300, docs)
    tree = lexical.Tree(place, rank, tf, m, ranks, leaf=16)
    leaves = sum(not c for c in tree.children)
    assert sorted(tree.order.tolist()) == list(range(docs))
    read = 0
    for q in range(20):
        ask = np.sort(rng.choice(ranks, 12, replace=False))
        weight = 1000 + 100 * ask
        own = np.zeros(ranks, np.int64)
        own[ask] = weight
        score = np.zeros(docs, np.int64)
        np.add.at(score, place, own[rank] * lexical.gain(tf, m[place]))
        walker, held, bar = tree.best(ask, weight, 1, 10), [], None
        while True:
            try:
                d, s = walker.send(bar)
            except StopIteration:
                break
            read += 1
            assert (score[d] == s).all()
            held = sorted(held + s.tolist(), reverse=True)[:10]
            bar = held[-1] if len(held) == 10 else None
        assert held == sorted(score.tolist(), reverse=True)[:10]
    assert read < 20 * leaves / 2
