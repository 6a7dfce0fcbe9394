"""Quality scores: random Fourier features, ridge regression, isotonic calibration."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorops.llm.common import labelled_sample, materialize

STATS = (
    "log_chars log_words word_len letters upper digits space wide punct odd_punct distinct top_share same_next"
    " caps_words bare_words end_marks line_len same_lines short_words entropy longest bar_words repeat_pairs"
).split()
_TAIL = re.compile(rb"[^\w\s.,;:!?'\")\]\x80-\xff]{2,}(?=\s|$)|!{2,}(?=\s|$)|\?{2,}(?=\s|$)")


def text_stats(text: bytes) -> list[float]:
    """Statistics of one whole text (UTF-8), in the order of ``STATS``."""
    raw = np.frombuffer(text, np.uint8)
    hist = np.bincount(raw, minlength=256).astype(float)
    chars = max(1.0, hist[:128].sum() + hist[192:].sum())
    words = text.split()
    n = max(1, len(words))
    count = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    p = hist[hist > 0] / max(1, len(raw))
    marks = hist[33:48].sum() + hist[58:65].sum() + hist[91:97].sum() + hist[123:127].sum()
    plain = hist[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]].sum()
    pairs = Counter(zip(words, words[1:], strict=False))
    return [
        np.log1p(chars),
        np.log1p(len(words)),
        min(40.0, chars / n),
        (hist[65:91].sum() + hist[97:123].sum()) / chars,
        hist[65:91].sum() / chars,
        hist[48:58].sum() / chars,
        (hist[9:14].sum() + hist[32]) / chars,
        hist[192:].sum() / chars,
        marks / chars,
        (marks - plain) / chars,
        np.log1p(len(count)) / np.log1p(n),
        max(count.values(), default=0) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        sum(w.isupper() for w in count) / max(1, len(count)),
        sum(c for w, c in count.items() if not w.isalnum() and len(w) <= 2) / n,
        len(_TAIL.findall(text)) / n,
        np.log1p(chars / max(1, len(lines))),
        1 - len(set(lines)) / max(1, len(lines)),
        sum(c for w, c in count.items() if len(w) <= 3) / n,
        float(-(p * np.log2(p)).sum()) if len(raw) else 0.0,
        min(60, max(map(len, count), default=0)) / 10,
        count.get(b"|", 0) / n,
        1 - len(pairs) / max(1, len(words) - 1) if len(words) > 1 else 0.0,
    ]


def with_stats(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, stats), one row a document; the text is read once and not kept."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                some = batch.slice(lo, 1000)
                got = [text_stats(t or b"") for t in some.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(2), pa.array(got, pa.list_(pa.float64()))], names=[id_col, "key", "stats"]
                )

    return docs.select(id_col, text_col, F.xxhash64(text_col).alias("key")).mapInArrow(run, f"`{id_col}` {kind}, key long, stats array<double>")


class Model:
    """Random Fourier features of standardised statistics, a ridge fit and a step calibration."""

    def __init__(self, mean, std, features: int, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.std = mean, std
        self.w = rng.normal(0, 1 / np.sqrt(len(mean)), (len(mean), features))
        self.b = rng.uniform(0, 2 * np.pi, features)
        self.theta = np.zeros(features + 1)
        self.edges, self.values = np.zeros(1), np.full(1, 0.5)

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.std, -6, 6)
        z = np.cos(x @ self.w + self.b) * np.sqrt(2 / len(self.b))
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.theta

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated between the steps' middles, so that scores keep the order of the raw ones; 0 to 1."""
        return np.clip(np.interp(self.raw(stats), self.edges, self.values), 0, 1)


def pool_adjacent(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of bins in order of ``x``: block middles and their means."""
    blocks: list[list[float]] = []
    for xi, yi, wi in zip(x, y, w, strict=True):
        blocks.append([xi * wi, yi * wi, wi])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    b = np.array(blocks).reshape(-1, 3)
    return b[:, 0] / b[:, 2], b[:, 1] / b[:, 2]


def _stats(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), len(STATS))


def fit(stats: DataFrame, sample: DataFrame, id_col: str, features: int = 256, ridge: float = 1e-3, seed: int = 7, bins: int = 400) -> Model:
    """Fit on the labelled rows of ``stats``: three quarters for the ridge scores, the rest for the calibration.

    Moments, normal equations and calibration bins are weighted by what each
    row of ``sample`` stands for and summed by partition;
    only these sums, whose sizes do not depend on the data, reach the driver.
    """
    rows = stats.join(F.broadcast(sample), id_col).select("y", "weight", "stats", (F.pmod(F.xxhash64("key"), F.lit(4)) == 0).alias("later"))
    rows = materialize(rows.repartition(16), "train")

    def sums(part) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                got = part(_stats(batch.column("stats")), batch.column("y").to_numpy().astype(float), batch.column("weight").to_numpy())
                total = got if total is None else total + got
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["sums"])

        return run

    first = rows.filter(~F.col("later"))
    d = len(STATS)
    moments = sum(
        (np.frombuffer(r[0]) for r in first.mapInArrow(sums(lambda x, y, w: np.concatenate([[w.sum()], w @ x, w @ (x * x)])), "sums binary").collect()),
        np.zeros(2 * d + 1),
    )
    n = max(1.0, moments[0])
    mean = moments[1 : d + 1] / n
    model = Model(mean, np.sqrt(np.maximum(moments[d + 1 :] / n - mean**2, 1e-8)), features, seed)

    def normal(x, y, w):
        z = model.features(x)
        zw = z.T * w
        return np.concatenate([(zw @ z).ravel(), zw @ y])

    k = features + 1
    total = sum((np.frombuffer(r[0]) for r in first.mapInArrow(sums(normal), "sums binary").collect()), np.zeros(k * k + k))
    model.theta = np.linalg.solve(total[: k * k].reshape(k, k) + ridge * n / k * np.eye(k), total[k * k :])

    def binned(x, y, w):
        raw = model.raw(x)
        at = np.clip(((raw + 0.5) * bins / 2).astype(int), 0, bins - 1)
        return np.concatenate([np.bincount(at, w, bins), np.bincount(at, w * y, bins), np.bincount(at, w * raw, bins)])

    c = sum((np.frombuffer(r[0]) for r in rows.filter("later").mapInArrow(sums(binned), "sums binary").collect()), np.zeros(3 * bins))
    has = c[:bins] > 0
    if has.any():
        # a weak pull to the overall rate keeps the ends off 0 and 1
        rate = c[bins : 2 * bins].sum() / c[:bins].sum()
        w = c[:bins][has]
        x, y = pool_adjacent(c[2 * bins :][has] / w, c[bins : 2 * bins][has] / w, w)
        total_w = np.array([w[(np.searchsorted(x, c[2 * bins :][has] / w) == i)].sum() for i in range(len(x))]) + 1
        model.edges, model.values = x, np.clip((y * total_w + rate) / (total_w + 1), 0.001, 0.999)
        model.values = np.maximum.accumulate(model.values)
    return model


def quality_scores(
    docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", target: str = "quality", max_rows_per_class: int = 100_000
) -> DataFrame:
    """(id, key, score) of every document: the probability that its quality label is 1.

    ``train`` is the condition on a label row's id that training rows fulfil;
    at most ``max_rows_per_class`` rows of each class are used, weighted so
    that scores keep the class rate of all labels. ``key`` is a hash of the text, which tells rows apart that share an id. The texts are
    read once, for the statistics; all else works on those.

    Defined cases: null and empty texts get the score of an empty text; null
    ids are scored and never labelled; repeated rows are scored each; without
    labels every score is 0.5; an empty table gives an empty result.
    """
    stats = materialize(with_stats(docs, id_col, text_col), "stats")
    sample = labelled_sample(labels, target, train, max_rows_per_class, id_col)
    model = fit(stats, sample, id_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = model.score(_stats(batch.column(2)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], names=[id_col, "key", "score"])

    return stats.mapInArrow(run, f"`{id_col}` {kind}, key long, score double")


def keep_quality(docs: DataFrame, labels: DataFrame, train: Column, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``threshold``, with all their columns, whatever their names.

    Defined cases: as for ``quality_scores``; rows are told apart by id and
    text, so that repeated rows stay or go together and a null or repeated id
    says nothing about other texts.
    """
    low = quality_scores(docs, labels, train, id_col, text_col, **options).filter(F.col("score") < threshold).select(F.col(id_col).alias("id"), "key").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(text_col).alias("text_key"))
    kept = rows.join(low, F.col("row")[id_col].eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")), "left_anti")
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
