"""Removal of repeated passages: count-min prefilter, then exact grouping of windows."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from floorops.llm.common import extended, materialize, without

#: Words of the runs whose counts stand for a window's.
RUN = 8
SEGMENT = 1 << 16
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD, 0x165667B19E3779F9))


class WordHashes(dict):
    """Word -> 64-bit hash; emptied when it gets large."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        self[word] = h = xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > 500_000:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def rolled(h: np.ndarray, k: int, mul: np.uint64) -> np.ndarray:
    """Hash of each run of ``k`` words."""
    out = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        out *= mul
        out += h[i : len(h) - k + 1 + i]
    return out


def _sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over each ``width`` neighbours, by doubling."""
    done = 1
    while 2 * done <= width:
        x, done = f(x[:-done], x[done:]), 2 * done
    rest = width - done
    return f(x[:-rest], x[rest:]) if rest else x


def window_marks(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(marks, kept): each window's smallest run hash, and the run hashes at the places that are smallest in some window.

    Windows of the same words have the same mark, at the same place in the
    window. So a window that starts at two places has its mark kept at two.
    """
    run = min(RUN, window)
    g = rolled(h, run, _A)
    g = (g ^ (g >> np.uint64(33))) * _C
    g ^= g >> np.uint64(29)
    width = window - run + 1
    marks = _sliding(g, width, np.minimum)
    pad = np.zeros(width - 1, np.uint64)
    most = _sliding(np.concatenate([pad, marks, pad]), width, np.maximum)
    return marks, g[most == g]


class Sketch:
    """Count-min sketch of two rows with counters that stop at 2."""

    def __init__(self, cells: int):
        self.shift = np.uint64(64 - (cells.bit_length() - 1))
        self.rows = np.zeros((2, cells), np.uint8)

    def places(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (x * _B) >> self.shift, (x * _D) >> self.shift

    def add(self, x: np.ndarray) -> None:
        for row, at in zip(self.rows, self.places(x), strict=True):
            u, n = np.unique(at, return_counts=True)
            row[u] = np.minimum(2, row[u] + np.minimum(n, 2)).astype(np.uint8)

    def segments(self) -> Iterator[tuple[int, bytes, bytes]]:
        """(segment, cells counted, cells counted twice or more) where any was."""
        flat = self.rows.reshape(-1, min(SEGMENT, self.rows.shape[1]))
        for i in np.flatnonzero(flat.any(axis=1)).tolist():
            yield i, np.packbits(flat[i] > 0).tobytes(), np.packbits(flat[i] > 1).tobytes()


def _read(text: bytes | None) -> list[bytes]:
    return text.split() if text else []


def sketch_cells(docs: DataFrame, text_col: str, most: int) -> int:
    """Four cells for each mark that the text can be expected to keep; a power of two, at most ``most``."""
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    return min(most, max(SEGMENT, 1 << int(size / 6 * 2 / (20 - RUN + 2) * 4 + 1).bit_length() - 1))


def repeated_marks(docs: DataFrame, window: int, text_col: str, cells: int) -> dict[int, bytes]:
    """segment -> bits of the merged sketch's cells that count 2 or more.

    Each task sketches its rows; the sketches meet segment by segment. The
    result has ``2 * cells`` bits whatever the input.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, hashes, held, n = Sketch(cells), WordHashes(), [], 0
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                words = _read(text)
                if len(words) >= window:
                    held.append(window_marks(hashes.of(words), window)[1])
                    n += len(held[-1])
                    if n > 1_000_000:
                        s.add(np.concatenate(held))
                        held, n = [], 0
        if held:
            s.add(np.concatenate(held))
        got = [(i, zlib.compress(a, 1), zlib.compress(b, 1)) for i, a, b in s.segments()]
        for lo in range(0, len(got), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*got[lo : lo + 1000], strict=True)], names=["segment", "once", "twice"])

    def merge(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = twice = 0
        for b in parts:
            for x, y in zip(b.column("once").to_pylist(), b.column("twice").to_pylist(), strict=True):
                x, y = (np.frombuffer(zlib.decompress(z), np.uint8) for z in (x, y))
                twice, once = twice | y | (once & x), once | x
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([twice.tobytes()])], names=["segment", "twice"])

    parts = docs.select(text_col).mapInArrow(sketch, "segment long, once binary, twice binary")
    merged = parts.groupBy("segment").applyInArrow(merge, "segment long, twice binary")
    return {r[0]: bytes(r[1]) for r in merged.toLocalIterator() if any(r[1])}


def repeated_windows(docs: DataFrame, window: int, id_col: str, text_col: str, cells: int) -> DataFrame:
    """(id, key, starts): the starts of windows whose words also start earlier, as lists of places.

    Windows that the sketch lets through are grouped exactly, by 128 bits of
    hash. Within a task's chunk all but the first of a group are settled on the
    spot, so a group sends one row a chunk to the shuffle, however hot it is.
    """
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(repeated_marks(docs, window, text_col, cells))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length = min(SEGMENT, cells)
        table = np.zeros((2 * cells // length, length // 8), np.uint8)
        for i, raw in bits.value.items():
            table[i] = np.frombuffer(raw, np.uint8)
        table = table.reshape(2, -1)
        places = Sketch.places
        probe = type("Probe", (), {"shift": np.uint64(64 - (cells.bit_length() - 1))})
        hashes = WordHashes()

        def twice(x: np.ndarray) -> np.ndarray:
            ok = np.ones(len(x), bool)
            for row, at in zip(table, places(probe, x), strict=True):
                ok &= (row[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8) & 1).astype(bool)
            return ok

        def settle(docs_: list, chunk: list) -> Iterator[pa.RecordBatch]:
            h1, h2, pos = (np.concatenate([c[i] for c in chunk]) for i in range(3))
            doc = np.repeat(np.arange(len(docs_)), [len(c[0]) for c in chunk])
            low = -(1 << 63)
            rank = np.empty(len(docs_), np.int64)
            rank[np.lexsort((np.array([k for _, k in docs_], np.int64), np.array([low if d is None else d for d, _ in docs_], np.int64), np.array([d is not None for d, _ in docs_])))] = np.arange(len(docs_))
            order = np.lexsort((pos, rank[doc], h2, h1))
            a, b = h1[order], h2[order]
            first = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            lead, rest = order[first], order[~first]
            ids = pa.array([d for d, _ in docs_], pa.int64())
            keys = np.array([k for _, k in docs_], np.int64)
            for lo in range(0, len(lead), 100_000):
                x = lead[lo : lo + 100_000]
                yield batch_of(ids.take(pa.array(doc[x])), keys[doc[x]], pos[x], h1[x].view(np.int64), h2[x].view(np.int64), [None] * len(x))
            rest = rest[np.lexsort((pos[rest], doc[rest]))]
            who, at = np.unique(doc[rest], return_index=True)
            blobs = [pos[x].astype("<i4").tobytes() for x in np.split(rest, at[1:])] if len(rest) else []
            for lo in range(0, len(blobs), 2000):
                w = who[lo : lo + 2000]
                # the hash only spreads these rows
                yield batch_of(ids.take(pa.array(w)), keys[w], np.full(len(w), -1, np.int32), w.astype(np.int64) * -7046029254386353131, keys[w], blobs[lo : lo + 2000])

        def batch_of(ids, keys, pos, h1, h2, blobs) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [ids, pa.array(keys), pa.array(pos.astype(np.int32)), pa.array(h1), pa.array(h2), pa.array(blobs, pa.binary())], names=["id", "key", "pos", "h1", "h2", "settled"]
            )

        docs_, chunk, n, has = [], [], 0, set()
        for batch in batches:
            for d, text, key in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = _read(text)
                if len(words) < window or (d, key) in has:
                    continue
                h = hashes.of(words)
                at = np.flatnonzero(twice(window_marks(h, window)[0]))
                if not len(at):
                    continue
                docs_.append((d, key))
                has.add((d, key))
                chunk.append((rolled(h, window, _A)[at], rolled(h, window, _D)[at], at))
                n += len(at)
                if n >= 2_000_000:
                    yield from settle(docs_, chunk)
                    docs_, chunk, n, has = [], [], 0, set()
        if docs_:
            yield from settle(docs_, chunk)

    found = docs.select(F.col(id_col).cast("long"), text_col, F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("key")).mapInArrow(
        run, "id long, key long, pos int, h1 long, h2 long, settled binary"
    )
    group = W.partitionBy("h1", "h2").orderBy(F.col("id").asc_nulls_first(), "key", "pos")
    # rank: the same window of repeated rows is no earlier one
    later = found.withColumn("n", F.rank().over(group)).filter((F.col("n") > 1) | F.col("settled").isNotNull())
    return later.groupBy("id", "key").agg(F.collect_list(F.when(F.col("settled").isNull(), F.col("pos"))).alias("starts"), F.collect_list("settled").alias("settled"))


def remove_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", max_cells: int = 1 << 26) -> DataFrame:
    """Remove from each text the words of windows that also start earlier.

    A window is ``window`` consecutive words of one document; earlier is a
    smaller id (null first), or the same document and an earlier start. All
    windows are judged on the input. Adds ``n_words``, ``n_removed`` and
    ``kept`` (the remaining words, joined by one space; the text unchanged is
    not kept, since white space is not).

    First pass: every task counts its windows in a count-min sketch; the merged
    sketch overestimates. What is counted for a window is its mark, the
    smallest hash among its runs of eight words, at the one place that has it:
    a window that occurs twice has its mark twice. Second pass: windows whose
    estimate is 2 or more are grouped exactly. The sketch has at most
    ``2 * max_cells`` counters; a corpus beyond some 16 million marks for
    ``max_cells`` of 2**26 sends more windows to the second pass and loses none.

    Defined cases: null and word-free texts have 0 words and an empty ``kept``;
    rows with the same id and text are one document and get the same result;
    rows with the same id and other texts count in the order of a text hash; an
    empty table gives an empty result; input columns called like the new ones
    are replaced. Ids are integers.
    """
    docs = without(docs, "n_words", "n_removed", "kept", "_key", "_starts", "_settled")
    cells = sketch_cells(docs, text_col, max_cells)
    found = materialize(repeated_windows(docs, window, id_col, text_col, cells), "repeated").select(F.col("id").alias("_id"), F.col("key").alias("_k"), F.col("starts").alias("_starts"), F.col("settled").alias("_settled"))
    keyed = docs.withColumn("_key", F.coalesce(F.xxhash64(text_col), F.lit(0)))
    joined = keyed.join(found, keyed[id_col].cast("long").eqNullSafe(found["_id"]) & (keyed["_key"] == found["_k"]), "left").drop("_id", "_k", "_key")
    names, at = docs.columns, docs.columns.index(text_col)
    n = len(names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                some = batch.slice(lo, 1000)
                out: list[list] = [[], [], []]
                for text, starts, settled in zip(some.column(at).cast(pa.binary()).to_pylist(), some.column(n).to_pylist(), some.column(n + 1).to_pylist(), strict=True):
                    words = _read(text)
                    gone = 0
                    if starts or settled:
                        edge = np.zeros(len(words) + 1, np.int32)
                        for s in [np.array(starts or [], np.int64), *(np.frombuffer(x, "<i4") for x in settled or [])]:
                            np.add.at(edge, s, 1)
                            np.add.at(edge, np.minimum(s + window, len(words)), -1)
                        keep = np.cumsum(edge[:-1]) == 0
                        gone = len(words) - int(keep.sum())
                        words_kept = [words[i] for i in np.flatnonzero(keep)]
                    else:
                        words_kept = words
                    for column, v in zip(out, (len(words), gone, b" ".join(words_kept)), strict=True):
                        column.append(v)
                yield pa.RecordBatch.from_arrays(
                    [*some.columns[:n], pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()).cast(pa.string())], names=[*names, "n_words", "n_removed", "kept"]
                )

    schema = extended(docs, "n_words long, n_removed long, kept string")
    return joined.select(*[F.col(f"`{c}`") for c in names], "_starts", "_settled").mapInArrow(cut, schema)
