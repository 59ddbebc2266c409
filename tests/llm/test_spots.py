"""Fingerprints, next rows, edits and the similarity join."""

import hashlib
import random

from pyspark.sql import functions as F

from pulsegrid.llm import spots


def signs(text):
    """The set of signatures as strings, by the definition."""
    import re

    w = re.findall(r"[^\W_]+", text.lower())
    stop = set(spots.COMMON)
    items = [(w[i - 1] if i else None, x) for i, x in enumerate(w) if x not in stop]
    out = {" ".join([p, *[x for _, x in items[i:i + 3]]]) for i, (p, _) in enumerate(items) if p in stop}
    return out or {"all " + " ".join(w)}


TEXTS = ["", None, "the cat sat on the mat and the dog was in a house", "The Cat, sat on the MAT; and the dog was in a house!", "no anchors here", "no anchors there",
         "the", "der Hund und die Katze sind im Haus des Herrn Müller", "le chat est sur la table " * 3, "the end"]


def test_fingerprints_follow_the_definition(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i long, text string")
    rows = df.select("i", spots.fingerprint(F.coalesce("text", F.lit(""))).alias("s")).collect()
    got = {r["i"]: r["s"] for r in rows}
    for i, a in enumerate(TEXTS):
        assert len(got[i]) == len(signs(a or "")) and got[i] == sorted(got[i])
        for j, b in enumerate(TEXTS):
            x, y = signs(a or ""), signs(b or "")
            assert len(set(got[i]) & set(got[j])) == len(x & y)


def test_next_text_at_range_edges(spark):
    rng = random.Random(2)
    for n in (0, 1, 2, 3, 100):
        ids = rng.sample(range(-500, 5000), n)
        rows = [(i, f"text {i}" * rng.randint(0, 3)) for i in ids]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        order = sorted(rows)
        want = {i: (t, order[(k + 1) % n][1]) for k, (i, t) in enumerate(order)}
        assert {r["doc_id"]: (r["text"], r["next_text"]) for r in spots.with_next(df).collect()} == want


def test_next_text_with_null_and_repeated_ids(spark):
    rows = [(None, "n"), (5, "b"), (5, "a"), (5, "a"), (9, None)]
    got = sorted((str(r[0]), r[1], r[2]) for r in spots.with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([("None", "n", "a"), ("5", "a", "a"), ("5", "a", "b"), ("5", "b", ""), ("9", "", "n")])


def test_edit(spark):
    df = spark.createDataFrame([("abcde", "12345"), ("abcd", "1"), ("", "x"), ("😀é", "日本")], "a string, b string")
    assert [r[0] for r in df.select(spots.edited(F.col("a"), F.col("b"))).collect()] == ["abc12", "ab1", "", "😀日"]


def test_similarity_join_against_brute_force(spark):
    rng = random.Random(6)
    base = [[rng.randint(0, 400) for _ in range(rng.randint(1, 40))] for _ in range(12)]
    sets = []
    for b in base:
        for _ in range(6):
            s = {x for x in b if rng.random() > 0.06} | {rng.randint(0, 400) for _ in range(rng.randint(0, 2))}
            if s:
                sets.append(sorted(s))
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "doc_id long, signs array<int>")
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(tuple(s), i)
    want = {}
    for s, i in first.items():
        for t, j in first.items():
            x, y = set(s), set(t)
            if i < j and len(x & y) / len(x | y) >= 0.8:
                want[i, j] = len(x & y) / len(x | y)
    got = {(min(r["a"], r["b"]), max(r["a"], r["b"])): r["likeness"] for r in spots.near_pairs(df).collect()}
    assert got.keys() == want.keys() and len(want) > 10 and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_query_against_brute_force(spark, sf):
    import duckdb

    from pulsegrid.llm.queries import QUERIES

    docs = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet' ORDER BY doc_id").fetchall()
    got = {r["doc_id"]: r for r in QUERIES["op9_document_fingerprints"](spark, sf).collect()}
    assert len(got) == len(docs)
    for k, (i, t) in enumerate(docs):
        n = docs[(k + 1) % len(docs)][1]
        e = t[:len(t) - len(t) // 2] + n[:len(t) // 2]
        a, b, c = signs(t), signs(e), signs(n)
        r = got[i]
        assert r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest() and len(r["fingerprint"]) == 8 * len(a)
        assert abs(r["near_edited"] - len(a & b) / len(a | b)) < 1e-9 and abs(r["near_next"] - len(a & c) / len(a | c)) < 1e-9
