"""What line dedup does for each word and pair: numbers and no decimals, words compared once; large sets and extreme ids against a plain version."""

import numpy as np
from pyspark.sql import functions as F
from test_lines import RARE, changed, plain

from floorops.llm import lines
from floorops.llm.common import materialize


def test_large_sets_and_extreme_ids_without_decimals_in_pairs(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base = [list(rng.choice(RARE, n, replace=False)) for n in (60, 66, 125, 135, 260, 400)]
    ids = [None, -(2**63), 2**63 - 1, -1, 0, 10**17, -(10**17)]
    rows = []
    for i in range(60):
        some = [" ".join(changed(rng, base[k], int(rng.integers(0, len(base[k]) // 7)))) for k in rng.choice(6, 3)]
        rows.append((ids[i] if i < len(ids) else i, "\n".join([*some, "a\tb " + str(i), "a\x0bb\r\f" + str(i)])))
    made = {}

    def kept(df, name):
        made[name] = materialize(df, name)
        return made[name]

    monkeypatch.setattr(lines, "materialize", kept)
    got = {(r["doc_id"], tuple(r["removed"])) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {(i, tuple(gone)) for (i, _), gone in plain(rows).items()}
    assert any(gone for _, gone in got)
    for name in ("line-tries", "line-settled", "line-pairs"):
        assert not [f for f in made[name].schema.fields if f.dataType.typeName() == "decimal"], name


def test_parities_differ_in_no_more_classes_than_sets_in_words(spark):
    rng = np.random.default_rng(10)
    rows = []
    for n in (5, 64, 65, 128, 129, 300):
        for d in (0, 1, n // 8):
            a = list(rng.choice(RARE, n, replace=False))
            b = changed(rng, a, d)
            rows.append((len(rows), " ".join(a), " ".join(b), len(set(a) ^ set(b))))
    df = spark.createDataFrame(rows, "k1 long, a string, b string, d int")
    rarity = F.array(F.lit(1).cast("bigint"))
    a, b = (lines.profiles(df.select("k1", F.col(c).alias("line")), rarity, 0.8, 1, fine=True).select("k1", F.lit(0).alias("at"), "n", *lines.FINE) for c in ("a", "b"))
    sizes = [(F.col(f"{x}n").cast("bigint") * 131072).alias(f"{x}np") for x in ("", "o_")]
    both = a.join(lines._other(b, "k1"), "k1").join(df.select("k1", "d"), "k1").select("*", *sizes)
    fits = {r["k1"] for r in both.filter(lines._fits(0.8, "", "o_", fine=True)).collect()}
    # sets that match by size and overlap pass every filter
    want = {i for i, a, b, _ in rows if len(set(a.split()) & set(b.split())) >= 0.8 * len(set(a.split()) | set(b.split()))}
    assert want and want <= fits


def test_words_of_a_pair_are_compared_once(spark):
    line = spark.createDataFrame([(1, 0, 0, [1, 2, 3, 4, 5]), (2, 0, 1, [1, 2, 3, 4]), (3, 0, 2, [1, 2, 3, 9])], "k1 long, hi long, lo long, w array<bigint>")
    pairs = spark.createDataFrame([(2, 0, 1, 1, 0, 0), (3, 0, 2, 1, 0, 0)], ", ".join(f"{c} long" for c in [*lines.KEY, *lines._others(lines.KEY)]))
    out = lines.matches(pairs, line, 0.8)
    assert [tuple(r) for r in out.collect()] == [(2, 0, 1)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("array_intersect") == 1


def test_no_null_is_asked_for_at_each_word_and_a_text_is_hashed_once(spark):
    docs = spark.createDataFrame([(1, "a b c\nb c d"), (2, "a b c")], "doc_id long, text string")
    split = lines.lines_of(docs, "doc_id", "text")
    some = lines.profiles(split.select("k1", "line"), lines._rarity(docs, "text"), 0.8, 1)
    assert "coalesce" not in some._jdf.queryExecution().optimizedPlan().toString()
    # the hash of a text lies below the lists of lines, not above them
    plan = split.select("text_key", "k1")._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64(text" not in plan.split("Generate")[0] and plan.count("xxhash64(text") == 1
    one = some.select("k1", *lines.COARSE, (F.col("n").cast("bigint") * 131072).alias("np"))
    fits = one.crossJoin(lines._other(one)).filter(lines._fits(0.8, "", "o_"))
    assert fits.count() == 5  # two equal lines with each other and themselves, the third with itself
    condition = str(lines._fits(0.8, "", "o_", fine=True))
    assert "ceil" not in condition.lower()
