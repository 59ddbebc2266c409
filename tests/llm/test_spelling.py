"""Spelling variants against a search of all pairs."""

import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from conftest import SF
from pulsegrid.llm import spelling
from pulsegrid.llm.queries import QUERIES

DOCS = "doc_id long, text string"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(docs, least=3):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % 97 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    words = {w: k for w, k in n.items() if len(w) >= 5 and k >= least}
    # candidates of a word share it less one letter, or are it less one letter
    less = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            less[w[:i] + w[i + 1:]].add(w)
    friends = {w: {b for i in range(len(w)) for b in less[w[:i] + w[i + 1:]] | ({w[:i] + w[i + 1:]} & words.keys())} | less.get(w, set()) for w in words}
    friends = {w: {b for b in f if near(w, b)} for w, f in friends.items()}
    form = {}
    for w, f in friends.items():
        best = min(f, key=lambda b: (-words[b], b), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return sorted((w, words[w], len(friends[w]), form[w], words.get(form[w]), root(w)) for w in words)


def run(docs, **opts):
    return sorted(tuple(r) for r in spelling.variants(docs, **opts).collect())


@pytest.mark.parametrize("block", [1 << 15, 40])
def test_query_tables_against_brute_force(spark, block):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert run(docs, block=block) == want and len({r[5] for r in want}) < len(want) and any(r[3] and r[5] != r[3] for r in want)


def test_registered_query(spark):
    got = QUERIES["op11_spelling_variants"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert sorted(tuple(r) for r in got.select("word", "n", "n_near", "form", "form_n", "root").collect()) == brute([tuple(r) for r in docs.collect()])
    assert [t for _, t in got.select("n", "n_near", "form_n").dtypes] == ["bigint"] * 3


def test_index_finds_exactly_one_error():
    import random
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(3, 6))) for _ in range(120)})
    index = spelling.Index(words)
    for w in words + ["", "zzzz", "a"]:
        replaced, longer, shorter, _ = index.near(w)
        found = replaced | longer | shorter
        assert [v for k, v in enumerate(words) if found >> k & 1] == [v for v in words if near(v, w)], w


def test_block_edges_and_dense_words(spark):
    """Words of one letter repeated have many ways to differ; every pair counts once, also where beginning and end agree."""
    import random
    rng = random.Random(2)
    words = {"a" * n for n in range(5, 12)} | {"".join(rng.choice("ab") for _ in range(rng.randint(5, 7))) for _ in range(90)}
    d = spark.createDataFrame([(w, rng.randint(3, 60)) for w in sorted(words)], "word string, n long")
    n = {r["word"]: r["n"] for r in d.collect()}
    for block in (1 << 15, 7):
        got = {r["word"]: (r["n_near"], r["near"]["n"], r["near"]["word"]) for r in spelling.near_words(d, block).collect()}
        want = {}
        for w in words:
            f = [v for v in words if near(v, w)]
            if f:
                best = min(f, key=lambda v: (-n[v], v))
                want[w] = (len(f), n[best], best)
        assert got == want


def test_odd_rows(spark):
    rows = [(1, "Étaler étaler éTALER Étaler"), (None, "Maison maison maisons MAISONS maisons"), (2, None), (3, ""), (4, "12 _ %"), (1, "Étaler étaler éTALER Étaler"),
            (5, "中maison中maison maison\U0001f600maison"), (6, "x" * 3000)] + [(7, "maisonn maisonn maisonn ")] * 2
    docs = spark.createDataFrame(rows, DOCS)
    assert run(docs) == brute(rows)
    clash = docs.select("*", F.lit(1).alias("word"), F.lit("a").alias("n"), F.lit(0).alias("root"), F.lit(0).alias("id"))
    assert run(clash) == brute(rows)
    assert run(spark.createDataFrame([], DOCS)) == []


def test_long_texts_are_cut_between_words(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 50)
    text = " ".join(["Reihen", "reihe", "reihn", "reihen"] * 200)
    parts = list(spelling.runs(text.encode()))
    assert len(parts) > 20 and Counter(w for p in parts for w in p) == Counter({b"reihen": 400, b"reihe": 200, b"reihn": 200})


def test_chains_are_followed_to_the_end(spark):
    chain = ["".join("b" if j < i else "a" for j in range(9)) for i in range(9)]
    docs = spark.createDataFrame([(None, " ".join([w] * (3 * 2 ** i))) for i, w in enumerate(chain)], DOCS)
    got = {r["word"]: r for r in spelling.variants(docs).collect()}
    drawn = {w: r for w, r in got.items() if w in chain}
    assert all(r["root"] == drawn[r["form"]]["root"] for r in drawn.values() if r["form"])
    assert sorted(tuple(r) for r in got.values()) == brute([tuple(r) for r in docs.collect()])
