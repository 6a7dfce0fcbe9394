"""Toxicity scores from class-conditional Kneser-Ney models over the letters of words."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from floorops.llm.common import labelled_sample, materialize
from floorops.llm.decontamination import words_of

ORDER = 8
DISCOUNT = 0.75
#: Sequences in fewer texts are cut off; the shared counts do not have them either.
LEAST = 3
#: Weight of the shared counts besides the discounted mass: what few texts of a class show counts for little.
PRIOR = 10.0
#: A word's ratio counts from this size on (nats); below it says nothing.
EVIDENCE = 2.0
CACHE_WORDS = 400_000
_MUL = np.uint64(0x9E3779B97F4A7C15)
_LEN = np.uint64(0xC2B2AE3D27D4EB4F)


def _word_counts(rows: DataFrame, text_col: str) -> DataFrame:
    """(word, t, o): how many toxic and ordinary labelled texts have the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = (Counter(), Counter())
            for text, y in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
                count[y].update(set(words_of(text)))
            words = list(count[0].keys() | count[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array([w.decode(errors="replace") for w in words], pa.string()), *(pa.array([count[y][w] for w in words], pa.int64()) for y in (1, 0))],
                names=["word", "t", "o"],
            )

    counted = rows.select(text_col, "y").mapInArrow(run, "word string, t long, o long")
    return counted.groupBy("word").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))


def expression_ratios(rows: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Log-likelihood ratios of the two models, toxic to ordinary.

    ``rows`` has texts and ``y`` (1: toxic). Each class has interpolated
    Kneser-Ney counts of letter sequences of up to ``ORDER`` within words (``^``
    marks a word's start, ``$`` its end); both classes back off to one shared
    model of continuation counts, in which a sequence counts by how many
    different letters it follows. So a sequence that neither class has seen
    says nothing, and one that is rare in both leans on the shared counts.
    Sequences in fewer than ``LEAST`` texts are left out of all counts.

    Counts are of texts that have the word. Returns (gram, ratio) for sequences seen in either class and (context,
    ratio) of the back-off weights for what follows a seen context unseen.
    """
    words = _word_counts(rows, text_col).withColumn("w", F.concat(F.lit("^"), "word", F.lit("$")))
    grams = words.select(
        "t",
        "o",
        F.explode(F.transform(F.sequence(F.lit(2), F.length("w")), lambda i: F.substring(F.col("w"), F.greatest(F.lit(1), i - (ORDER - 1)), F.least(i, F.lit(ORDER))))).alias("g"),
    )
    top = materialize(grams.groupBy("g").agg(F.sum("t").alias("t"), F.sum("o").alias("o")).filter(F.col("t") + F.col("o") >= LEAST), "grams")

    # every seen ending of two or more letters; without its first letter, it is preceded by that letter
    endings = top.select(F.explode(F.expr("transform(sequence(2, length(g)), j -> right(g, j))")).alias("x")).distinct()
    follows = endings.groupBy(F.expr("substring(x, 2)").alias("s")).agg(F.count("*").alias("c"))
    context = W.partitionBy(F.expr("left(s, length(s) - 1)"))
    level = follows.select("s", "c", F.sum("c").over(context).alias("all"), F.count("*").over(context).alias("kinds")).select(
        F.col("s").alias("x"),
        F.when(F.length("s") == 1, F.col("c") / F.col("all")).otherwise(F.greatest(F.col("c") - DISCOUNT, F.lit(0.0)) / F.col("all")).alias("own"),
        F.when(F.length("s") == 1, F.lit(0.0)).otherwise(DISCOUNT * F.col("kinds") / F.col("all")).alias("below"),
    )
    # a sequence's shared probability folds those of its endings, from one letter up
    needed = top.select(F.expr("substring(g, 2)").alias("s")).distinct()
    steps = needed.select("s", F.posexplode(F.expr("transform(sequence(1, length(s)), j -> right(s, j))")).alias("k", "x"))
    shared = (
        steps.join(level, "x")
        .groupBy("s")
        .agg(F.sort_array(F.collect_list(F.struct("k", "own", "below"))).alias("v"))
        .select("s", F.aggregate("v", F.lit(0.0), lambda p, v: v["own"] + v["below"] * p).alias("p"))
    )

    ctx = F.expr("substring(g, 1, length(g) - 1)")
    w = W.partitionBy("ctx")
    cols = []
    for c in ("t", "o"):
        cols += [F.sum(c).over(w).alias(f"{c}_all"), F.sum((F.col(c) > 0).cast("int")).over(w).alias(f"{c}_kinds")]
    stats = top.withColumn("ctx", ctx).select("g", "ctx", "t", "o", *cols)

    def weight(c: str) -> Column:
        return (DISCOUNT * F.col(f"{c}_kinds") + PRIOR) / (F.col(f"{c}_all") + PRIOR)

    def seen_p(c: str) -> Column:
        return F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / (F.col(f"{c}_all") + PRIOR) + weight(c) * F.col("p")

    joined = stats.join(shared, F.expr("substring(g, 2)") == F.col("s"), "left").withColumn("p", F.coalesce("p", F.lit(1e-6)))
    ratio = joined.select(F.col("g").alias("gram"), F.log(seen_p("t") / seen_p("o")).alias("ratio"))
    back = stats.select("ctx", *(f"{c}_{x}" for c in "to" for x in ("all", "kinds"))).distinct().select(F.col("ctx").alias("gram"), F.log(weight("t") / weight("o")).alias("ratio"))
    return ratio, back


def _hashes(codes: np.ndarray, most: int) -> list[np.ndarray]:
    """For k = 1 to ``most``: the hash of the k codes that end at each place (wrong across a word's start)."""
    x = codes.astype(np.uint64) + np.uint64(1)
    out = [x]
    for _ in range(most - 1):
        h = out[-1]
        prev = np.concatenate([h[:1], h[:-1]])
        out.append(prev * _MUL + x)
    return [h + _LEN * np.full(1, k, np.uint64) for k, h in enumerate(out, 1)]


def _keys(grams: list[str]) -> np.ndarray:
    """The hash of each sequence."""
    key = np.zeros(len(grams), np.uint64)
    size = np.array([len(g) for g in grams])
    for k in np.unique(size[size > 0]):
        at = np.flatnonzero(size == k)
        codes = np.frombuffer("".join(grams[i] for i in at).encode("utf-32-le"), np.uint32).reshape(-1, k).astype(np.uint64) + np.uint64(1)
        h = codes[:, 0]
        for i in range(1, k):
            h = h * _MUL + codes[:, i]
        key[at] = h + _LEN * np.full(1, k, np.uint64)
    return key


def _table(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of sequences, with their ratios: 12 bytes each, and the labelled sample's bound bounds their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = _keys(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(1).cast(pa.float32())], names=["key", "ratio"])

    got = df.mapInArrow(run, "key long, ratio float").toArrow()
    key, ratio = got.column("key").to_numpy().view(np.uint64), got.column("ratio").to_numpy()
    order = np.argsort(key)
    return key[order], ratio[order]


class WordRatios(dict):
    """Word -> log-likelihood ratio; filled for whole lists of words at a time."""

    def __init__(self, grams, contexts):
        super().__init__()
        self.grams, self.contexts = grams, contexts

    @staticmethod
    def _find(table, key, ok):
        keys, values = table
        out, hit = np.zeros(len(key)), np.zeros(len(key), bool)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = (keys[at] == key) & ok
            out[hit] = values[at[hit]]
        return out, hit

    def learn(self, words: list[bytes]) -> None:
        text = ["^" + w.decode(errors="replace") + "$" for w in words]
        size = np.array([len(t) for t in text])
        codes = np.frombuffer("".join(text).encode("utf-32-le"), np.uint32)
        first = np.repeat(np.cumsum(size) - size, size)
        place = np.arange(len(codes)) - first
        word = np.repeat(np.arange(len(words)), size)
        hashes = _hashes(codes, ORDER)
        k = np.minimum(place + 1, ORDER)
        gram = np.choose(k - 1, hashes)
        before = [np.concatenate([h[:1], h[:-1]]) for h in hashes]
        context = np.choose(np.maximum(k - 2, 0), before)
        real = place > 0
        value, hit = self._find(self.grams, gram, real)
        back, _ = self._find(self.contexts, context, real & ~hit)
        total = np.bincount(word, value + back, len(words))
        total[np.abs(total) < EVIDENCE] = 0.0
        for w, v in zip(words, total.tolist(), strict=True):
            self[w] = v

    def of(self, words: list[bytes]) -> list[float]:
        new = [w for w in set(words) if w not in self]
        if new:
            if len(self) > CACHE_WORDS:
                self.clear()
                new = list(set(words))
            self.learn(new)
        return list(map(self.__getitem__, words))


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", target: str = "toxic", max_rows_per_class: int = 100_000
) -> DataFrame:
    """(id, ratio, score) of every document.

    ``ratio`` is the toxic less the ordinary log-likelihood of the whole text
    by its number of words, leaving out words that tell the classes apart by
    less than ``EVIDENCE``; ``score`` turns it into the probability of label 1
    by a logistic fit on a quarter of the labelled rows, which the models do
    not see. ``train`` is the condition on a label row's id that training rows
    fulfil; at most ``max_rows_per_class`` rows of each class are used, which
    bounds the models that go to the tasks; the logistic fit weights them, so
    that scores keep the class rate of all labels. Words are runs of letters and
    digits, A-Z in lower case.

    Defined cases: null, empty and word-free texts have ratio 0; null ids are
    scored and never labelled; repeated rows are scored each; without labels of
    both classes every score is 0.5; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    sample = materialize(labelled_sample(labels, target, train, max_rows_per_class, id_col), "labels").withColumn(
        "later", F.pmod(F.xxhash64(F.col(id_col), F.lit(3)), F.lit(4)) == 0
    )
    rows = docs.join(F.broadcast(sample.filter(~F.col("later"))), id_col)  # bounded by max_rows_per_class
    grams, back = expression_ratios(rows, text_col)
    model = spark.sparkContext.broadcast((_table(grams), _table(back)))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordRatios(*model.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                some = batch.slice(lo, 200)
                texts = [words_of(t) for t in some.column(1).cast(pa.binary()).to_pylist()]
                flat = known.of([w for words in texts for w in words])
                n = np.array([len(w) for w in texts])
                edges = np.concatenate([[0], np.cumsum(n)])
                sums = np.concatenate([[0.0], np.cumsum(flat)])
                ratio = (sums[edges[1:]] - sums[edges[:-1]]) / np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(ratio)], names=[id_col, "ratio"])

    scored = materialize(docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ratio double"), "ratios")
    a, b = _logistic(scored.join(F.broadcast(sample.filter("later")), id_col).select("ratio", "y", "weight"))
    return scored.withColumn("score", 1 / (1 + F.exp(-(F.lit(a) * F.col("ratio") + F.lit(b)))))


def _logistic(rows: DataFrame, steps: int = 60) -> tuple[float, float]:
    """Slope and intercept fitted on bins of the ratio, weighted and summed by Spark; at most 4,000 bins reach the driver."""
    wide = F.greatest(F.lit(-2000), F.least(F.lit(2000), F.round(F.col("ratio") * 1000))).cast("int")
    w = F.col("weight")
    sums = [F.sum(w).alias("n"), F.sum(w * F.col("y")).alias("y"), (F.sum(w * F.col("ratio")) / F.sum(w)).alias("x")]
    got = rows.groupBy(wide.alias("bin")).agg(*sums, F.min("y").alias("least"), F.max("y").alias("most")).toPandas()
    if got.empty or got["least"].min() == got["most"].max():
        return 0.0, 0.0
    x, n, y = (got[c].to_numpy(float) for c in ("x", "n", "y"))
    scale = max(1e-9, float(np.sqrt((n * x * x).sum() / n.sum())))
    z = np.stack([x / scale, np.ones_like(x)], 1)
    theta = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ theta, -30, 30)))
        grad = z.T @ (n * p - y) + 0.02 * theta
        hess = (z * (n * p * (1 - p))[:, None]).T @ z + 0.02 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        theta -= step * min(1.0, 5 / max(1e-9, float(np.abs(step).max())))
    return float(theta[0] / scale), float(theta[1])
