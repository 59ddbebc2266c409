"""Secret scans: spans against brute force, the ledger, masking."""

import random
import re

from pyspark.sql import functions as F

from pulsegrid.llm import secrets
from pulsegrid.session import new_folder

PATTERNS = [
    ("assign", re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
]


def brute(text):
    out = []
    for k, (kind, p, group, least) in enumerate(PATTERNS):
        out += [(m.start(), k, kind, m.end()) for m in p.finditer(text or "") if len(m.group(group)) >= least]
    return sorted(out)


def spans_of(spark, rows, **given):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ledger = new_folder(spark, "ledger")
    f = secrets.findings_of(secrets.scan(df, ledger, **given), ledger)
    return [(r["path"], [(s["start"], s["k"] - 1, s["rule"], s["end"]) for s in r["spans"]]) for r in f.collect()]


def test_spans_against_brute_force(spark):
    rng = random.Random(8)
    parts = ["password", "PassWd", "secret", "token", "api_key", "apikey", "=", ":", " = ", "\"", "'", "abcdefgh", "x1", "AKIA", "AKIAABCDEFGHIJKL", "0123456789abcdef",
             "deadbeef" * 4, " ", "\n", "é", "😀", "secret=token:abcdefghijk", "token= token=abcdefgh1", "ſecret=abcdefgh"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))) for i in range(400)] + [(1000, None), (1001, ""), (1002, "ab" * 5000), (1003, "password=" + "z" * 50_000)]
    got = dict(spans_of(spark, rows))
    assert got == {i: brute(t) for i, t in rows} and sum(map(len, got.values())) > 100


def test_repeated_rows_null_paths_and_one_scan_per_blob(spark):
    t = "token=abcdefgh12"
    rows = [(1, t), (1, t), (2, t), (None, t), (3, "none"), (3, "secret: 12345678")]
    got = sorted(spans_of(spark, rows), key=str)
    assert len(got) == 6 and sum(len(s) for _, s in got) == 5
    assert spans_of(spark, []) == []


def test_only_unseen_blob_and_version_pairs_are_scanned(spark):
    ledger = new_folder(spark, "ledger")
    one = spark.createDataFrame([(1, "token=abcdefgh12"), (2, "x")], "doc_id long, text string")
    secrets.scan(one, ledger)
    secrets.scan(one, ledger)
    two = spark.createDataFrame([(3, "token=abcdefgh12"), (4, "AKIAABCDEFGHIJKLMN")], "doc_id long, text string")
    paths = secrets.scan(two, ledger)
    seen = spark.read.parquet(f"{ledger}/seen")
    assert seen.count() == seen.distinct().count() == 9
    assert {r["path"]: len(r["spans"]) for r in secrets.findings_of(paths, ledger).collect()} == {3: 1, 4: 1}
    newer = [secrets.Rule("access", r"AKIA[A-Z]{4}", version=2)]
    again = secrets.scan(two, ledger, rules=newer)
    f = {r["path"]: [(s["start"], s["end"]) for s in r["spans"]] for r in secrets.findings_of(again, ledger, newer).collect()}
    assert f == {3: [], 4: [(0, 8)]} and spark.read.parquet(f"{ledger}/seen").count() == 11


def test_masks_join_overlapping_spans(spark):
    ledger = new_folder(spark, "ledger")
    text = "é token=" + "deadbeef" * 4 + " and AKIAABCDEFGHIJKL, end"
    df = spark.createDataFrame([(1, text), (2, "clean"), (3, None)], "doc_id long, text string")
    secrets.scan(df, ledger)
    d = df.withColumn("blob", secrets.blob_id(F.col("text"))).join(secrets.masks(ledger, spark), "blob", "left")
    got = {r[0]: r[1] for r in d.select("doc_id", F.when(F.col("cuts").isNotNull(), secrets.redact(F.col("text"), F.col("cuts"))).otherwise(F.col("text"))).collect()}
    assert got == {1: "é [secret] and [secret], end", 2: "clean", 3: None}


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "token=abcdefgh12", "p", "b")], "doc_id long, text string, path string, blob string")
    ledger = new_folder(spark, "ledger")
    assert secrets.findings_of(secrets.scan(df, ledger), ledger).count() == 1
