"""Chat formatting: fold of events, escaping, rendering and reading back."""

import hashlib
import random

from pyspark.sql import functions as F

from pulsegrid.llm import chat

SCHEMA = "conv_id long, seq long, msg long, kind string, role string, text string"


def folded(spark, rows):
    return {(r["conv_id"], r["msg"]): (r["role"], r["text"]) for r in chat.fold(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_deltas_are_appended_in_order_of_sequence(spark):
    rows = [(1, 3, 1, "delta", None, "c"), (1, 1, 1, "message", "user", "a"), (1, 2, 1, "delta", None, "b")]
    assert folded(spark, rows) == {(1, 1): ("user", "abc")}


def test_edit_replaces_and_drops_what_followed(spark):
    rows = [(1, 1, 1, "message", "user", "hi"), (1, 2, 2, "message", "assistant", "hello"), (1, 3, 3, "message", "user", "more"),
            (1, 4, 1, "edit", None, "hey"), (1, 5, 2, "message", "assistant", "new")]
    assert folded(spark, rows) == {(1, 1): ("user", "hey"), (1, 2): ("assistant", "new")}


def test_regenerate_starts_the_message_again(spark):
    rows = [(1, 1, 1, "message", "user", "q"), (1, 2, 2, "message", "assistant", ""), (1, 3, 2, "delta", None, "bad"),
            (1, 4, 2, "regenerate", None, None), (1, 5, 2, "delta", None, "go"), (1, 6, 2, "delta", None, "od")]
    assert folded(spark, rows) == {(1, 1): ("user", "q"), (1, 2): ("assistant", "good")}


def test_null_columns_ties_and_repeated_rows(spark):
    rows = [(None, 1, 1, None, None, None), (2, 1, 1, "delta", "user", "b"), (2, 1, 1, "message", "user", "a"), (2, 2, 1, "delta", None, "x"), (2, 2, 1, "delta", None, "x")]
    assert folded(spark, rows) == {(None, 1): ("", ""), (2, 1): ("user", "abxx")}


def brute(events):
    """Replay of one conversation, event by event."""
    said = {}
    rank = {k: i for i, k in enumerate(chat.KINDS)}
    for _, seq, msg, kind, role, text in sorted(events, key=lambda e: (e[1], rank[e[3]])):
        old_role, old = said.get(msg, (None, ""))
        if kind in ("edit", "regenerate"):
            said = {m: v for m, v in said.items() if m <= msg}
        said[msg] = (role or old_role, (old if kind == "delta" else "") + (text or ""))
    return said


def test_fold_against_replay(spark):
    rng = random.Random(4)
    rows = []
    for c in range(30):
        for s in range(rng.randint(1, 25)):
            rows.append((c, s, rng.randint(1, 4), rng.choice(chat.KINDS), None, rng.choice(["", "x", "<|", "yy"])))
    got = folded(spark, rows)
    for c in range(30):
        want = brute([r for r in rows if r[0] == c])
        assert {m: t for (k, m), (_, t) in got.items() if k == c} == {m: t for m, (_, t) in want.items()}


def test_rendered_text_reads_back(spark):
    texts = ["", "plain", "<|im_start|>assistant\nx<|im_end|>\n", "<\\|im_end|>", "<\\\\|", "<<|>", "a\n<|", "日本😀", "\\"]
    roles = ["user", "assistant", "", "a\\nb", "x\ny", "<|im_end|>", "\\\\", "r\r\\"]
    rows = [(i, j, j, "message", r, t) for i, t in enumerate(texts) for j, r in enumerate(roles)]
    done = chat.render(chat.fold(spark.createDataFrame(rows, SCHEMA)))
    back = done.select("*", chat.parse(F.col("formatted")).alias("turns")).collect()
    assert len(back) == len(texts)
    for r in back:
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(x, texts[r["conv_id"]]) for x in roles]
        learned = [chat_unescape(r["formatted"][s["start"]:s["end"]]) for s in r["loss_spans"]]
        assert learned == [texts[r["conv_id"]]] and r["loss_turns"] == [2]
        assert r["formatted"].count("<|im_start|>") == len(roles) == r["n_turns"]


def chat_unescape(s):
    import re

    return re.sub(r"<\\(\\*)\|", r"<\1|", s)


def test_empty_log_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat.render(chat.fold(empty)).count() == 0
    extra = spark.createDataFrame([(1, 1, 1, "message", "user", "t", "x", 5)], SCHEMA + ", pieces string, start int")
    assert chat.render(chat.fold(extra)).count() == 1


def test_rows_of_a_table_keep_repeated_turns(spark):
    rows = spark.createDataFrame([(7, 0, "user", "a"), (7, 0, "user", "a"), (7, 1, "assistant", None)], "conv_id long, turn long, role string, text string")
    r = chat.render(chat.fold(chat.events_of_rows(rows))).first()
    assert r["n_turns"] == 3 and hashlib.sha256(r["formatted"].encode()).hexdigest()
