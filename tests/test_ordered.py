"""Blocked execution (forced by tiny blocks) must equal plain windows, whatever the skew."""

import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from pulsegrid.operators.ordered import Ordered, grouped_quantiles, largest_group, sized


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(1)
    rows = []
    for key, n in (("hot", 900), ("warm", 70), ("cold", 3), ("one", 1)):
        rows += [(key, i, rng.randint(-50, 50) if rng.random() > 0.2 else None) for i in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, i long, v long")


def got(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("block", [20, 64, 333])
def test_blocks_equal_plain_windows(skewed, block):
    def chain(bounded):
        o = Ordered(skewed, ["k"], ["i"], block_rows=block, bounded=bounded)
        assert o.blocked is not bounded
        o = o.number("n").around(5, 3, lambda w: {
            "lag3": F.lag("v", 3).over(w), "lead2": F.lead("v", 2).over(w), "near": F.sum("v").over(w.rowsBetween(-5, 3))})
        o = o.running({"total": ("sum", F.col("v")), "low": ("min", F.col("v")), "high": ("max", F.col("v")), "seen": ("last", F.col("v"))})
        o = o.running({"before": ("sum", F.lit(1))}, current=False)
        return o.running({"next": ("last", F.col("v")), "rest": ("sum", F.col("v"))}, reverse=True).rows

    a, b = chain(False), chain(True)
    assert got(a.select(*b.columns)) == got(b)


def test_row_numbers_match_spark(skewed):
    w = Window.partitionBy("k").orderBy("i")
    plain = skewed.withColumn("n", F.row_number().over(w))
    assert got(Ordered(skewed, ["k"], ["i"], block_rows=50).number("n").rows.select("k", "i", "v", "n")) == got(plain)


def test_small_keys_are_not_cut(skewed):
    assert not Ordered(skewed, ["k"], ["i"]).blocked
    assert largest_group(skewed, ["k"]) == 900
    assert sized(skewed, ["k"])["bounded"] is True
    assert sized(skewed, ["k"], block_rows=100)["bounded"] is False


def test_frame_longer_than_a_block_is_refused(skewed):
    with pytest.raises(ValueError):
        Ordered(skewed, ["k"], ["i"], block_rows=4, bounded=False).around(5, 0, lambda w: {"x": F.lag("v", 5).over(w)})


@pytest.mark.parametrize("bounded", [True, False, None])
def test_quantiles_match_numpy(skewed, bounded):
    q = grouped_quantiles(skewed, ["k"], "v", {"med": ("linear", 0.5), "q9": ("linear", 0.9), "up": ("upper", 0.5), "lo": ("lower", 0.3)},
                          block_rows=10, bounded=bounded)
    rows = {r["k"]: r for r in q.collect()}
    data = {}
    for r in skewed.filter("v IS NOT NULL").collect():
        data.setdefault(r["k"], []).append(r["v"])
    for k, vals in data.items():
        s = sorted(vals)
        assert rows[k]["med"] == pytest.approx(np.median(s))
        assert rows[k]["q9"] == pytest.approx(np.quantile(s, 0.9))
        assert rows[k]["up"] == s[len(s) // 2]
        assert rows[k]["lo"] == s[int(np.floor(0.3 * (len(s) - 1)))]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(-5, 5)), min_size=1, max_size=60), st.integers(2, 9))
def test_running_sum_property(spark, rows, block):
    data = [(k, i, v) for i, (k, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "k string, i long, v long")
    out = Ordered(df, ["k"], ["i"], block_rows=block, bounded=False).running({"s": ("sum", F.col("v"))}).rows
    sums, want = {}, []
    for k, i, v in data:
        sums[k] = sums.get(k, 0) + v
        want.append((k, i, sums[k]))
    assert got(out.select("k", "i", "s")) == sorted(want)
