import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark import scale
from tidemark.operators import coupling


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(1)
    data = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(40)}", i, rng.randrange(-5, 9)) for i in range(2000)]
    return spark.createDataFrame(data, "k string, pos long, v long")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_sliced_join_equals_a_plain_join(spark, rows, skewed, how):
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("k2", 4), ("none", 5)], "k string, x long")
    plain = skewed.join(small, "k", how)
    cut = scale.skewed_join(skewed, small, ["k"], how, hot_rows=50)
    assert rows(plain, *plain.columns) == rows(cut, *plain.columns)


def test_hot_keys_are_cut_and_bounded(rows, skewed):
    assert rows(scale.hot_keys(skewed, ["k"], 500), "k")[0][0] == "hot"
    assert scale.hot_keys(skewed, ["k"], 500).count() == 1


def test_salted_lookup_equals_a_plain_join(spark, rows, skewed):
    facts = spark.createDataFrame([("hot", 7), ("k3", 8)], "k string, fact long")
    assert rows(skewed.join(facts, "k", "left"), "k", "pos", "fact") == rows(scale.salted_lookup(skewed, facts, ["k"]), "k", "pos", "fact")


@pytest.mark.parametrize("width", [1, 7, 5000])
def test_chunked_windows_equal_plain_windows(rows, skewed, width):
    df = skewed.withColumn("c", F.floor(F.col("pos") / width)).withColumn("maybe", F.when(F.col("v") > 6, F.col("v")))
    w = Window.partitionBy("k").orderBy("pos")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    plain = df.withColumn("s", F.sum("v").over(run)).withColumn("p", F.lag("s").over(w)).withColumn("l", F.last("maybe", True).over(run))
    summed = scale.running_sum(df, ["k"], "c", ["pos"], "v", "s", "p")
    carried = scale.carry_forward(df, ["k"], "c", ["pos"], "maybe", "l")
    assert rows(plain, "pos", "s", "p") == rows(summed, "pos", "s", "p")
    assert rows(plain, "pos", "l") == rows(carried, "pos", "l")


def test_top_k_is_planned_as_a_group_limit(skewed):
    top = scale.top_k(skewed, ["k"], [F.desc("v"), F.asc("pos")], 3)
    assert top.groupBy("k").count().agg(F.max("count")).first()[0] == 3
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


@pytest.mark.parametrize("hot", [False, True])
def test_pairs_are_counted_in_parts_of_a_size(spark, monkeypatch, hot):
    """Twice the commits are twice the parts, not twice the pairs of a part, however few partitions a shuffle has."""
    monkeypatch.setattr(coupling, "PAIRS_A_PART", 40 if hot else 60)
    for commits in (100, 200):
        held = {("r", s, f"d{s % 9}/f{(s * k) % 37}") for s in range(commits) for k in (1, 2, 3)} | {("r", s, p) for s in range(commits // 2 if hot else 9) for p in ("a", "b")}
        held |= {(None, None, "a"), (None, None, "b"), ("r", 1, None)}
        want = Counter((r, *p) for r, s in {x[:2] for x in held} for p in itertools.combinations(sorted(f for q, t, f in held if (q, t) == (r, s) and f), 2))
        assert any(n > commits // 3 for n in want.values()) == hot
        sets = coupling.change_sets(spark.createDataFrame([*held, *held], "repo string, sha long, path string").distinct()).localCheckpoint()
        counts = coupling.pair_counts(sets)
        assert {tuple(r)[:3]: r.co_change_count for r in counts.collect()} == want
        parts = -(-sum(want.values()) // coupling.PAIRS_A_PART)
        assert counts.rdd.getNumPartitions() == parts > 4
