"""The pipeline, stage by stage against brute force, and its registration."""

import hashlib
import re
import struct
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from pulsegrid.llm import mixing, neardup
from pulsegrid.llm.base import written
from pulsegrid.llm.queries import QUERIES
from test_search import bag, likeness
from test_secrets import brute

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for name, stage in pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
        out.append(docs.collect())
        assert name == "encoding" or docs.columns == COLUMNS
    return out


def test_order_and_registration():
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_dedup", "secrets", "mixing", "encoding"]
    names = set(entry.queries())
    assert "pipeline" in names and {f"op{i}_" for i in range(1, 11)} <= {re.match(r"op\d+_|", n)[0] for n in names}


def test_quality_stage_keeps_what_the_classifier_accepts(spark, stages):
    accepted = {r["doc_id"] for r in QUERIES["op10_quality_classifier"](spark, SF).collect() if r["predicted"] == 1}
    assert [r["doc_id"] for r in stages[0] if r["doc_id"] in accepted] == sorted(r["doc_id"] for r in stages[1]) and len(accepted) < len(stages[0])


def test_near_dedup_stage_leaves_one_of_each_class(stages):
    rows = sorted(stages[1])
    bags = {r["doc_id"]: bag(r["text"]) for r in rows}
    root = {i: i for i in bags}
    ids = sorted(bags)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if root[i] != root[j] and likeness(bags[i], bags[j]) >= 0.8:
                low, high = sorted((root[i], root[j]))
                root = {k: low if v == high else v for k, v in root.items()}
    assert sorted(r["doc_id"] for r in stages[2]) == sorted(set(root.values())) and len(stages[2]) < len(rows)
    assert {tuple(r) for r in stages[2]} <= {tuple(r) for r in rows}


def test_secrets_stage_masks_what_is_found(stages):
    before = {r["doc_id"]: r for r in stages[2]}
    for r in stages[3]:
        text, cuts = before[r["doc_id"]]["text"], []
        for start, _, _, end in brute(text):
            if cuts and start <= cuts[-1][1]:
                cuts[-1][1] = max(end, cuts[-1][1])
            else:
                cuts.append([start, end])
        for start, end in reversed(cuts):
            text = text[:start] + "[secret]" + text[end:]
        assert r["text"] == text and r["n_chars"] == (len(text) if cuts else before[r["doc_id"]]["n_chars"]) and not brute(r["text"])
    assert len(stages[3]) == len(stages[2])


def test_mixing_stage_repeats_rows_up_to_three_times(stages):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    rows = Counter(tuple(r) for r in stages[4])
    assert set(rows) <= {tuple(r) for r in stages[3]} and max(rows.values()) <= 3
    whole, taken = Counter(), Counter()
    for r in stages[3]:
        whole[r["source"]] += words(r["text"])
    for r in stages[4]:
        taken[r["source"]] += words(r["text"])
    names = sorted(whole)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    if all(sum(whole.values()) * weight[s] / sum(weight.values()) <= 3 * whole[s] for s in names):
        for s in names:
            assert abs(taken[s] - sum(whole.values()) * weight[s] / sum(weight.values())) < 0.02 * whole[s] + 20


def test_encoding_stage_is_the_library(stages):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = {r["doc_id"]: r["text"] for r in stages[4]}
    assert Counter(r["doc_id"] for r in stages[5]) == Counter(r["doc_id"] for r in stages[4])
    for r in stages[5]:
        ids = t.encode(text[r["doc_id"]], add_special_tokens=False).ids
        assert bytes(r["ids"]) == struct.pack(f"<{len(ids)}I", *ids) and r["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_stages_take_empty_and_odd_tables(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "token=abcdefgh12 and so on " * 9, None, None, None),
                                 (3, "x " * 20_000, "en", "s", 40_000)], schema)
    for name, stage in pipeline.STAGES:
        assert stage(spark, odd.limit(0), SF).count() == 0
        got = stage(spark, odd, SF).count()
        assert 0 <= got <= 15 and (name != "secrets" or got == 5) and (name != "near_dedup" or got == 3)


def test_rows_keep_columns_of_any_name(spark):
    """Names that the operators use inside, and names with signs in them, come through as they are."""
    names = ["_id", "_tag", "_own", "_nth", "_row", "_source", "_copies", "_times", "tag", "size", "a.b", "c d"]
    rows = [(i % 40, f"text number {i % 40} of one and another kind", f"s{i % 3}", *[i] * len(names)) for i in range(60)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    one, many = neardup.keep_one(docs), mixing.repeated(docs)
    assert one.columns == many.columns == docs.columns
    assert len({r["doc_id"] for r in one.collect()}) == one.count() == 40
    assert {tuple(r) for r in one.collect()} <= set(rows) and {tuple(r) for r in many.collect()} <= set(rows) and many.count() > 0
