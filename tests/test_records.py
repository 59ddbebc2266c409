from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import as_dicts
from pulsegrid.operators import records as R

REC = "user_id long, id string, seq long, deleted boolean, bytes long, version long, updated_at timestamp"
HEAD = "user_id long, seq long, pruned_seq long"
T0 = datetime(2024, 5, 1)
WRITE = "user_id long, id string, arrival long, base_version long, is_delete boolean, bytes long, updated_at timestamp"


def table(spark, rows):
    return spark.createDataFrame([(1, i, s, d, b, v, T0) for i, s, d, b, v in rows], REC)


def heads(spark, seq, pruned=0):
    return spark.createDataFrame([(1, seq, pruned)], HEAD)


def cursor(spark, c):
    return spark.createDataFrame([(1, c)], "user_id long, cursor long")


def test_pages(spark):
    t = table(spark, [(f"r{i}", i + 1, False, 1, 1) for i in range(7)])
    first = as_dicts(R.changes_since(t, heads(spark, 7), cursor(spark, 0), page=5), "seq")
    assert [r["seq"] for r in first] == [1, 2, 3, 4, 5] and first[0]["more"] and first[0]["next_cursor"] == 5
    rest = as_dicts(R.changes_since(t, heads(spark, 7), cursor(spark, 5), page=5), "seq")
    assert [r["seq"] for r in rest] == [6, 7] and not rest[0]["more"] and rest[0]["next_cursor"] == 7


def test_tombstones_only_after_a_cursor_and_reset(spark):
    t = table(spark, [("a", 1, False, 1, 1), ("b", 3, True, 0, 2)])
    assert [r["id"] for r in as_dicts(R.changes_since(t, heads(spark, 3), cursor(spark, 0)))] == ["a"]
    assert [r["id"] for r in as_dicts(R.changes_since(t, heads(spark, 3), cursor(spark, 1)))] == ["b"]
    old = as_dicts(R.changes_since(t, heads(spark, 3, pruned=2), cursor(spark, 1)))
    assert [r["id"] for r in old] == ["a"] and old[0]["reset"]


def write(spark, rows):
    return spark.createDataFrame([(1, i, a, b, d, 10, T0) for i, a, b, d in rows], WRITE)


def test_conditional_writes(spark):
    cur = table(spark, [("a", 1, False, 5, 1), ("gone", 2, True, 0, 3)])
    w = write(spark, [("a", 1, 1, False), ("a", 2, 1, False), ("a", 3, 2, False), ("new", 4, 0, False), ("new", 5, 0, False),
                      ("gone", 6, 2, False), ("gone", 7, 3, False), ("a", 8, None, True), ("a", 9, None, True), ("none", 10, None, True), ("a", 11, 3, True)])
    table_, acc, con = R.apply_writes(cur, heads(spark, 2), w)
    assert [(r["id"], r["arrival"], r["version"], r["deleted"], r["seq"]) for r in as_dicts(acc, "arrival")] == [
        ("a", 1, 2, False, 3), ("a", 3, 3, False, 4), ("new", 4, 1, False, 5), ("gone", 7, 4, False, 6), ("a", 8, 4, True, 7)]
    assert [(r["arrival"], r["current_version"]) for r in as_dicts(con, "arrival")] == [(2, 2), (5, 1), (6, 3)]
    state = {r["id"]: r for r in as_dicts(table_)}
    assert state["a"]["deleted"] and state["a"]["bytes"] == 0 and state["gone"]["version"] == 4 and state["new"]["version"] == 1


def test_writes_match_a_replay(spark):
    import random
    rng = random.Random(8)
    rows, a = [], 0
    for _ in range(300):
        a += 1
        dele = rng.random() < 0.2
        rows.append((rng.choice("abcd"), a, None if dele and rng.random() < 0.5 else rng.randint(0, 12), dele))
    _, acc, con = R.apply_writes(table(spark, [("a", 1, False, 5, 2), ("b", 2, True, 0, 1)]), heads(spark, 2), write(spark, rows), block_rows=9, bounded=False)
    state, took, clash = {"a": (2, False), "b": (1, True)}, [], []
    for i, arr, b, d in rows:
        v, dead = state.get(i, (0, True))
        fits = (v > 0 and not dead and b in (None, v)) if d else b == v
        if fits:
            state[i] = (v + 1, d)
            took.append(arr)
        elif not (d and dead):
            clash.append(arr)
    assert [r["arrival"] for r in as_dicts(acc, "arrival")] == took
    assert [r["arrival"] for r in as_dicts(con, "arrival")] == clash


def test_a_chain_of_a_thousand_versions_takes_few_rounds(spark, monkeypatch):
    n, rounds = 1000, []
    kept = R.checkpointed
    monkeypatch.setattr(R, "checkpointed", lambda df: rounds.append(1) or kept(df))
    rows = [("a", i, i, False) for i in range(n)] + [("b", n + i, 0, False) for i in range(50)]
    table_, acc, con = R.apply_writes(table(spark, []), heads(spark, 0), write(spark, rows))
    got = as_dicts(acc, "arrival")
    assert [(r["arrival"], r["version"]) for r in got] == [(i, i + 1) for i in range(n)] + [(n, 1)]
    assert con.count() == 49 and len(rounds) <= 12
    assert {r["id"]: r["version"] for r in as_dicts(table_)} == {"a": n, "b": 1}


@pytest.mark.parametrize("seed", range(3))
def test_deletes_without_base_between_versions(spark, seed):
    import random
    rng = random.Random(seed)
    rows = [(rng.choice("abc"), a, None if rng.random() < 0.4 else rng.randint(0, 6), rng.random() < 0.5) for a in range(120)]
    _, acc, con = R.apply_writes(table(spark, [("a", 1, False, 5, 1)]), heads(spark, 1), write(spark, rows))
    state, took, clash = {"a": (1, False)}, [], []
    for i, arr, b, d in rows:
        v, dead = state.get(i, (0, True))
        if (v > 0 and not dead and b in (None, v)) if d else b == v:
            state[i] = (v + 1, d)
            took.append((arr, v + 1))
        elif not (d and dead):
            clash.append(arr)
    assert [(r["arrival"], r["version"]) for r in as_dicts(acc, "arrival")] == took
    assert [r["arrival"] for r in as_dicts(con, "arrival")] == clash


def test_no_writes(spark):
    table_, acc, con = R.apply_writes(table(spark, [("a", 1, False, 5, 1)]), heads(spark, 1), write(spark, []))
    assert (table_.count(), acc.count(), con.count()) == (1, 0, 0)


LOCAL = "user_id long, id string, edit_ms long, version long, dirty boolean, deleted boolean"
REMOTE = "user_id long, id string, edit_ms long, version long, deleted boolean, server_ms long"


@pytest.mark.parametrize("local,remote,action", [
    ((100, 1, True, False), (90, 2, False, 95), "push"), ((90, 1, True, False), (100, 2, False, 101), "take"),
    ((100, 1, True, False), (100, 2, False, 101), "take"), ((100, 2, True, False), (999, 2, False, 999), "push"),
    ((100, 1, True, False), (0, 2, True, 90), "push"), ((100, 1, True, False), (0, 2, True, 110), "drop"),
    ((100, 1, True, True), (90, 2, False, 95), "push"), ((100, 1, True, True), (120, 2, False, 125), "take"),
    ((100, 1, False, False), (120, 2, False, 125), "take"), ((100, 2, False, False), (120, 2, False, 125), "keep"),
    ((100, 1, False, False), (0, 2, True, 125), "drop"), (None, (1, 1, False, 2), "take"), (None, (1, 1, True, 2), "keep"),
    ((100, 0, True, False), None, "create"), ((100, 1, True, True), None, "drop")])
def test_last_writer_wins(spark, local, remote, action):
    lo = spark.createDataFrame([(1, "x", *local)] if local else [], LOCAL)
    re = spark.createDataFrame([(1, "x", *remote)] if remote else [], REMOTE)
    assert as_dicts(R.reconcile_lww(lo, re))[0]["action"] == action


@pytest.mark.parametrize("opts", [{}, {"block_rows": 2, "bounded": False}], ids=["plain", "blocks"])
def test_edit_clock(spark, opts):
    d = spark.createDataFrame([("a", i, t) for i, t in enumerate([5, 5, 4, 20, 20, 3])], "o string, i long, now long")
    assert [r["edit_ms"] for r in as_dicts(R.edit_clock(d, ["o"], ["i"], "now", **opts), "i")] == [5, 6, 7, 20, 21, 22]


def test_prune_remembers_the_highest_dropped(spark):
    t = spark.createDataFrame([(1, "a", 5, True, 0, 2, datetime(2024, 1, 1)), (1, "b", 9, True, 0, 2, datetime(2024, 4, 30)), (1, "c", 2, False, 1, 1, datetime(2023, 1, 1))], REC)
    kept, h = R.prune(t, heads(spark, 9, 1), F.lit(T0))
    assert [r["id"] for r in as_dicts(kept, "id")] == ["b", "c"] and as_dicts(h)[0]["pruned_seq"] == 5


def test_admission(spark):
    cur = table(spark, [("a", 1, False, 50, 1), ("b", 2, True, 0, 2)])
    w = spark.createDataFrame([(1, "a", 1, 60), (1, "n1", 2, 30), (1, "n2", 3, 5), (1, "big", 4, 999), (1, "n3", 5, 20)], "user_id long, id string, arrival long, bytes long")
    r = as_dicts(R.admit(w, cur, max_records=3, max_bytes=100, max_record=500), "arrival")
    assert [x["reason"] for x in r] == [None, None, None, "too_large", "records"]


def test_refused_writes_use_nothing(spark):
    w = spark.createDataFrame([(1, i, n, b) for n, (i, b) in enumerate([("x", 60), ("y", 50), ("z", 30), ("x", 60)])], "user_id long, id string, arrival long, bytes long")
    r = as_dicts(R.admit(w, table(spark, []), max_records=3, max_bytes=100), "arrival")
    assert [x["reason"] for x in r] == [None, "bytes", None, None]


@pytest.mark.parametrize("block", [100_000, 64, 20])
def test_admission_against_replay(spark, block):
    import random
    rng = random.Random(3)
    cur = [(i, n, rng.random() < 0.3, rng.randint(1, 30), 1) for n, i in enumerate("abcdef")]
    rows = [(rng.choice([1, 2]), rng.choice("abcdefghij"), n, rng.randint(1, 60)) for n in range(300)]
    state, want = {1: {i: b for i, _, d, b, _ in cur if not d}, 2: {}}, []
    for u, i, _, b in rows:
        rest = {k: v for k, v in state[u].items() if k != i}
        why = "too_large" if b > 55 else "records" if len(rest) >= 5 else "bytes" if sum(rest.values()) + b > 120 else None
        if why is None:
            state[u] = rest | {i: b}
        want.append(why)
    w = spark.createDataFrame(rows, "user_id long, id string, arrival long, bytes long")
    got = as_dicts(R.admit(w, table(spark, cur), max_records=5, max_bytes=120, max_record=55, block_writes=block), "arrival")
    assert [x["reason"] for x in got] == want and len(set(want)) == 4


def test_admission_of_one_user_in_blocks(spark):
    """Users below the limits are never folded, whatever the windows' block."""
    rows = [(1, f"r{n % 40}", n, 1 + n % 7) for n in range(200)] + [(2, f"q{n}", n, 50) for n in range(4)]
    w = spark.createDataFrame(rows, "user_id long, id string, arrival long, bytes long")
    for opts in ({}, {"block_rows": 16, "bounded": False}):
        got = as_dicts(R.admit(w, table(spark, []), max_records=40, max_bytes=10_000, max_record=49, **opts), "user_id", "arrival")
        assert [x["reason"] for x in got] == [None] * 200 + ["too_large"] * 4


def test_hourly_admission(spark):
    d = spark.createDataFrame([("k", i, datetime(2024, 1, 1, 10 + i // 3)) for i in range(6)], "key string, id long, ts timestamp")
    assert R.admit_hourly(d, ["key"], "ts", "id", 2).count() == 4
