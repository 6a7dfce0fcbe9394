import numpy as np
from pyspark.sql import functions as F

from floorops.operators import feedback


def plain(score, ratings):
    x = round(score * 100)
    for r in ratings:
        x = min(100, x + 5) if r == "good" else max(0, x - 15) if r == "bad" else x
    return x / 100


def test_keys_with_one_two_and_a_million_events(spark):
    n = 1_000_000
    rows = spark.range(n + 3).select(
        F.when(F.col("id") < n, "hot").when(F.col("id") == n, "one").otherwise("two").alias("k"), F.col("id").alias("at"), (F.xxhash64("id") % 100).alias("h")
    )
    rows = rows.withColumn("r", F.when(F.abs("h") < 74, "good").otherwise("bad")).orderBy("h")  # not in order of time
    got = {r["k"]: (r["score"], r["good_count"] + r["bad_count"]) for r in feedback.feedback_fold(rows, "k", F.col("r") == "good", ["at"]).collect()}
    listed = rows.select("k", "at", "r").orderBy("at").toPandas()
    want = {k: (plain(0.5, g["r"]), len(g)) for k, g in listed.groupby("k")}
    assert got == want and want["hot"][1] == n


def test_no_row_holds_the_events_of_a_key(spark):
    rows = spark.range(20_000).select(F.lit("hot").alias("k"), F.col("id").alias("at"), (F.col("id") % 4 > 0).alias("g"))
    steps = feedback.feedback_steps(rows, "k", F.col("g"), ["at"]).first()
    assert 1 < len(steps["steps"]) <= 4 and (steps["good_count"], steps["bad_count"]) == (15_000, 5_000)


def test_composed_steps_equal_single_ones():
    rng = np.random.default_rng(0)
    for n in range(1, 40):
        good = rng.random(n) < 0.6
        key = np.sort(rng.integers(0, 4, n))
        args = np.where(good, -feedback.FAR, 0), np.where(good, 10_000, feedback.FAR), np.where(good, 500, -1500)
        k, low, high, shift = feedback.compose(key, *args)
        for i, name in enumerate(k.tolist()):
            for start in (0, 3000, 10_000):
                want = plain(start / 10_000, np.where(good[key == name], "good", "bad"))
                assert min(high[i], max(low[i], start + shift[i])) == round(want * 10_000)


def test_cache_after_feedback(spark):
    cache = spark.createDataFrame([(1, 0.5, 2, 0, "q"), (2, 0.98, 0, 0, "r"), (3, 0.07, 0, 1, "s")], "id long, score double, good_count long, bad_count long, question string")
    events = spark.createDataFrame([(1, "good", 1), (1, "great", 2), (1, None, 3), (2, "good", 1), (2, "bad", 2), (3, "bad", 1), (3, "good", 2), (9, "good", 1), (None, "good", 1)], "id long, rating string, at int")
    got = sorted(map(tuple, feedback.apply_feedback(cache, events, "rating", ["at"]).collect()))
    assert got == [(1, 0.55, 3, 0, "q"), (2, 0.85, 1, 1, "r"), (3, 0.05, 1, 2, "s")]
    assert sorted(map(tuple, feedback.apply_feedback(cache, events.limit(0), "rating", ["at"]).collect())) == sorted(map(tuple, cache.collect()))


def test_null_keys_are_a_key(spark):
    rows = spark.createDataFrame([(None, True, 1), (None, False, 2), ("a", True, 1)], "k string, g boolean, at int")
    got = {r["k"]: r["score"] for r in feedback.feedback_fold(rows, "k", F.col("g"), ["at"]).collect()}
    assert got == {None: 0.4, "a": 0.55}
