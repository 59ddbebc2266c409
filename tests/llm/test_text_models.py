"""Language and quality classifiers: held-out accuracy, whole texts, defined cases."""

import math
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import language, quality
from pulsegrid.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_language_on_held_out_rows(spark):
    want = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").fetchall())
    got = QUERIES["op4_language_id"](spark, SF).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(want) and len(held) > 150
    assert np.mean([r["lang_pred"] == want[r["doc_id"]] for r in held]) > 0.97 and all(0 <= r["score"] <= 1 for r in got)


def grams_of(text):
    """n-grams by the definition."""
    out, run = [], ""
    for c in text.lower():
        if c.isalpha():
            run += c
        elif run and run[-1] != " ":
            run += " "
    if run and run[-1] != " ":
        run += " "
    for n in language.ORDERS:
        out += [run[i:i + n] for i in range(len(run) - n + 1)]
    return out


def bucket(gram):
    h = len(gram)
    for c in gram:
        h = ((h ^ ord(c)) * 0x9E3779B1) & 0xFFFFFFFF
        h ^= h >> 15
    return h % language.BUCKETS


def test_scores_are_naive_bayes(spark, monkeypatch):
    rows = [(1, "ab cab!", "x"), (2, "bä, ba", "y"), (3, "Ab", "x"), (4, "zz", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df, F.lit(True))
    counts = {v: Counter(bucket(g) for _, t, k in rows if k == v for g in grams_of(t)) for v in "xy"}

    def log(v, t):
        total = sum(counts[v].values()) + 0.5 * language.BUCKETS
        return math.log({"x": 2, "y": 1}[v] / 3) + sum(math.log((counts[v][bucket(g)] + 0.5) / total) for g in grams_of(t))

    texts = ["abc", "bä bä", "b" * 50 + " ca"]
    labels, scores = model.score(texts)
    for t, v, s in zip(texts, labels, scores):
        x, y = log("x", t), log("y", t)
        assert v == ("x" if x >= y else "y") and s == pytest.approx(1 / (1 + math.exp(-abs(x - y))), rel=1e-3)
    # pieces of a text add up to the same
    long = "abc ba ä " * 3000
    whole = model.score([long, "x", long])
    monkeypatch.setattr(language, "PIECE", 1000)
    assert model.score([long, "x", long])[0] == whole[0] and model.score([long])[1] == pytest.approx(whole[1][:1])


def test_language_defined_cases(spark):
    df = spark.createDataFrame([(1, "hello there", "en", "c"), (2, None, "en", "c"), (3, "12 !?", None, "c"), (None, "", None, "c"), (4, "hallo du", "de", "c")],
                               "doc_id long, text string, lang string, score string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(df, language.fit(df, F.lit(True)), ["doc_id"]).collect()}
    assert got[2] == got[3] == got[None] == ("und", 0.0) and got[1][0] == "en" and got[4][0] == "de"
    none = language.fit(df, F.lit(False))
    assert {r["lang_pred"] for r in language.identify(df, none, ["doc_id"]).collect()} == {"und"}
    assert language.identify(df.limit(0), none, ["doc_id"]).count() == 0


def test_rare_languages_are_sampled(spark):
    rows = [(i, "hello you there" if i % 2 else "hallo du da", "en" if i % 2 else "de") for i in range(4000)]
    rows += [(5000 + i, "привет мир", "ru") for i in range(20)] + [(None, "γεια σου", "el")] * 3 + [(6000, None, "xx"), (6001, "12 !", "yy")]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), fit_rows=100)
    assert model.labels == ["de", "el", "en", "ru"]
    assert model.score(["мир", "γεια", "you there", "du da"])[0] == ["ru", "el", "en", "de"]
    assert np.exp(model.prior) == pytest.approx(np.array([2000, 3, 2000, 20]) / 4023)
    assert language.level([2000, 20, 3, 2000], 100) == 38.5 and language.level([5, 3], 100) == 5 and language.level([9, 9], 1) == 1


def test_quality_on_held_out_rows(spark):
    want = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall())
    got = QUERIES["op10_quality_classifier"](spark, SF).collect()
    assert len(got) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in want]
    good = [r["score"] for r in held if want[r["doc_id"]] == 1]
    bad = [r["score"] for r in held if want[r["doc_id"]] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95 and np.mean([g >= 0.3 for g in good]) > 0.98


def test_quality_score_is_the_factorisation_machine(spark):
    """The linear-time score equals the sum over all pairs of features."""
    docs = spark.createDataFrame([(i, ("good words here " if i % 2 else "bad !! bad !! ") * (i % 7 + 1)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    fm = quality.fit(docs, labels, F.lit(True), rounds=5)
    rows = quality._vectors(quality.features(docs, "text", "doc_id")).limit(5).collect()
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, fm, ["doc_id"]).collect()}
    v, w = fm.factors.toArray(), fm.linear.toArray()
    for r in rows:
        x = r["features"].toArray()
        at = np.flatnonzero(x)
        pair = sum(x[i] * x[j] * v[i] @ v[j] for a, i in enumerate(at) for j in at[a + 1:])
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + math.exp(-(fm.intercept + w @ x + pair))), rel=1e-6)


def test_quality_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (None, "x" * 100_000, "s"), (1, "a b", "s")], "doc_id long, text string, words string")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels, F.lit(True))
    assert isinstance(model, float) and 0 < model < 1
    assert quality.score(docs, model, ["doc_id"]).count() == 4
    both = quality.fit(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"), F.lit(True), rounds=2)
    assert quality.score(docs, both, ["doc_id"]).filter("score BETWEEN 0 AND 1").count() == 4
    assert quality.score(docs.limit(0), both, ["doc_id"]).count() == 0
