"""Byte-pair encoding and token counts against the library."""

import random
import struct

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pulsegrid.llm import bpe, transducer

PATH = public_tokenizers.path("word_bpe_49k.json")
SIGNS = "abcdefghijklmnopqrstuvwxyzABCÉß'’.,!?:;-éüñÀΣİǆ日本😀<|>endoftext0123456789́ \x1c\x85 \t\n"


def texts():
    rng = random.Random(3)
    out = ["", None, " ", "Hello, World!! don't", "<|endoftext|>x<|startoftext|>", "<|ENDOFTEXT|>", "a" * 3000, "ha" * 2000 + " !", "É.", "word.,", "'s't've"]
    return out + ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 200))) for _ in range(400)]


def test_encode_and_decode_like_the_library(spark):
    t = Tokenizer.from_file(PATH)
    given = texts()
    rows = [(i, x) for i, x in enumerate(given)] + [(3, "other text of id 3"), (3, given[3]), (None, "null id"), (None, "null id 2")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, ids string").repartition(5)
    keep = df.select("doc_id", "text").withColumn("n", F.monotonically_increasing_id())
    for hot in (0, 50):     # all words rare, some rare
        coded = bpe.encode(keep, PATH, ["doc_id", "text"], hot=hot)
        got = bpe.decode(coded, PATH, ["doc_id", "text", "ids"]).collect()
        assert len(got) == len(rows)
        for r in got:
            ids = t.encode(r["text"] or "", add_special_tokens=False).ids
            assert bytes(r["ids"]) == struct.pack(f"<{len(ids)}I", *ids)
            assert r["decoded"] == t.decode(ids, skip_special_tokens=False)


def test_many_texts_under_one_id(spark):
    """Documents of one id are told apart by 64 bits of their text; the first two agree in 32 of them."""
    texts = ["w33895zq", "w135613zq"] + [f"w{i}zq" for i in range(60_000)]
    df = spark.createDataFrame([(7, x) for x in texts], "doc_id long, text string").repartition(4)
    t = Tokenizer.from_file(PATH)
    got = bpe.encode(df, PATH, ["text"], hot=0).collect()
    want = {x: struct.pack(f"<{len(e.ids)}I", *e.ids) for x, e in zip(texts, t.encode_batch(texts, add_special_tokens=False))}
    assert len(got) == len(texts) and all(bytes(r["ids"]) == want[r["text"]] for r in got)


def test_encode_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(df, PATH, ["doc_id"]), PATH, ["doc_id"]).count() == 0


def test_transducer_counts_words(spark):
    t = transducer.Transducer(open(PATH, encoding="utf-8").read())
    for x in texts():
        for w in (x or "").split():
            assert t[w] == len(t.library.encode(w, add_special_tokens=False).ids), w


def test_transducer_with_few_states(monkeypatch):
    monkeypatch.setattr(transducer, "MOST_STATES", 20)
    monkeypatch.setattr(transducer, "MOST_PAIRS", 20)
    monkeypatch.setattr(transducer, "MOST_WORDS", 5)
    t = transducer.Transducer(open(PATH, encoding="utf-8").read())
    for w in ["hello", "internationalization", "aaaaaaaaaaaaaaaa", "don't", "x1y2", "unbelievable", "hello"] * 2:
        assert t[w] == len(t.library.encode(w, add_special_tokens=False).ids)


def test_counts_do_not_depend_on_chunks(spark):
    t = Tokenizer.from_file(PATH)
    rows = list(enumerate(texts())) + [(5, "twice"), (5, "twice"), (None, "x y")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, row int")
    want = sorted(((str(i), len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in rows))
    for chunk in (1, 7, 100_000):
        got = transducer.count_tokens(df, PATH, chunk=chunk).collect()
        assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert transducer.count_tokens(df.limit(0), PATH).count() == 0


def test_texts_are_split_once(spark):
    """One pass over the texts feeds the rare words and the documents they are joined to, and equal rows ask for their words once."""
    rows = [(i % 40, f"Qzv2!? hello world{i % 20}x {i % 40} Qzv{i % 7}!? qzv{i % 7}") for i in range(200)] + [(None, "null id"), (None, "null id"), (1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    t = Tokenizer.from_file(PATH)
    for hot in (0, 6):
        coded = bpe.encode(df, PATH, ["doc_id", "text"], hot=hot, digests=True)
        got = coded.collect()
        assert sorted((str(r["doc_id"]), str(r["text"])) for r in got) == sorted((str(i), str(x)) for i, x in rows)
        for r in got:
            ids = t.encode(r["text"] or "", add_special_tokens=False).ids
            assert bytes(r["ids"]) == struct.pack(f"<{len(ids)}I", *ids) and r["n_tokens"] == len(ids)
        final = coded._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
        assert sum("MapInArrow" in line and "_text#" in line for line in final.splitlines()) == 1


def test_numbers_of_words_come_back():
    n = (1 << 14) + 300
    codes = bpe.numbers(n)
    given = [0, 1, 127, 128, 16383, 16384, n, 0, 5]
    number, last = bpe.unnumbered(b"".join(bpe.RARE if i == 0 else codes[i - 1] for i in given))
    assert len(set(codes)) == n and number.tolist() == given and len(last) == len(given)
    assert [len(x) for x in bpe.unnumbered(b"")] == [0, 0]
