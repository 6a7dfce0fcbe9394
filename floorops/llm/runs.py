"""Periodic runs of words, found in tiles per octave of periods and stitched together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from floorops.llm.common import materialize, partitions

#: The first octave takes the periods 1 to 7 together; the octave of P takes P to 2P - 1.
FIRST = 1
PARTS = "array<struct<period:bigint,start:bigint,end:bigint>>"


def octaves(n: int) -> list[int]:
    """The octaves in which a text of ``n`` words can have runs."""
    return [p for p in [FIRST, *(1 << k for k in range(3, 63))] if 2 * p <= n]


def top(octave: int) -> int:
    """The first period beyond an octave."""
    return 8 if octave == FIRST else 2 * octave


def z_function(s: list[int]) -> list[int]:
    """For each place the length of the longest common prefix of ``s`` and its rest from there."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    lo = hi = 0
    for i in range(1, n):
        k = min(hi - i, z[i - lo]) if i < hi else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > hi:
            lo, hi = i, i + k
    return z


def prime_factors(q: int) -> list[int]:
    out, r = [], 2
    while r * r <= q:
        if q % r == 0:
            out.append(r)
            while q % r == 0:
                q //= r
        r += 1
    return [*out, q] if q > 1 else out


def same_ahead(w: np.ndarray, at: int, q: int, hi: int) -> int:
    """How many words from ``at`` equal those ``q`` places later, before ``hi``."""
    n, step = 0, 64
    while at + n + q < hi:
        m = min(step, hi - q - at - n)
        differ = np.flatnonzero(w[at + n : at + n + m] != w[at + n + q : at + n + q + m])
        if len(differ):
            return n + int(differ[0])
        n, step = n + m, 2 * step
    return n


def same_behind(w: np.ndarray, at: int, q: int, lo: int) -> int:
    """How many words before ``at`` equal those ``q`` places later, from ``lo`` on."""
    n, step = 0, 64
    while at - n > lo:
        m = min(step, at - n - lo)
        a = at - n - m
        differ = np.flatnonzero(w[a : a + m] != w[a + q : a + q + m])
        if len(differ):
            return n + m - 1 - int(differ[-1])
        n, step = n + m, 2 * step
    return n


def candidates(w: np.ndarray, octave: int) -> tuple[np.ndarray, np.ndarray]:
    """(boundary, period): boundaries whose block of words occurs again a period of the octave later.

    Blocks are half as long as the octave's least run has matching words, and
    boundaries lie a block apart, so each run has a block that matches. Blocks
    are compared by hash: a collision costs time and changes nothing.
    """
    size, width = (3, 7) if octave == FIRST else (octave // 2, octave)
    n = len(w) - size + 1
    if n <= octave:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, have = (w.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), 1
    while have < size:
        more = min(have, size - have)
        m = len(h) - more
        h = (h[:m] ^ (h[:m] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + (h[more:] ^ (h[more:] >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        have += more
    at = np.arange(0, n, size)
    ahead = np.concatenate([h, np.zeros(octave + width, np.uint64)])
    windows = np.lib.stride_tricks.sliding_window_view(ahead, width)[octave::size][: len(at)]
    i, j = np.nonzero(windows == h[at][:, None])
    c, q = at[i], j + octave
    inside = c + q < n
    return c[inside], q[inside]


def solve(w: np.ndarray, ends: np.ndarray, octave: int, least: int) -> list[tuple[int, int, int]]:
    """(period, start, end) of the runs of one octave in texts that lie end to end in ``w``.

    ``ends`` are the texts' ends. At each boundary with a candidate two
    Z-functions, of the words after it and of those before it read backwards,
    tell how far the words on either side repeat at each period; both together
    must repeat at least a period long. What reaches the end of the
    Z-functions' window is followed beyond it by comparing words.
    """
    out = []
    limit = top(octave)
    reach = max(limit, least)
    covered: dict[int, int] = {}  # period -> boundaries before this place lie in a stretch that has been seen
    c_all, q_all = candidates(w, octave)
    text = np.searchsorted(ends, c_all, "right")
    inside = c_all + q_all < ends[text]
    c_all, q_all, text = c_all[inside], q_all[inside], text[inside]
    if not len(c_all):
        return out
    first = np.flatnonzero(np.concatenate([[True], c_all[1:] != c_all[:-1]]))
    for lo_hit, hi_hit in zip(first.tolist(), [*first[1:].tolist(), len(c_all)], strict=True):
        c, k = int(c_all[lo_hit]), int(text[lo_hit])
        todo = [q for q in q_all[lo_hit:hi_hit].tolist() if covered.get(q, -1) <= c]
        if not todo:
            continue
        lo, hi = int(ends[k - 1]) if k else 0, int(ends[k])
        left = max(lo, c - reach)
        ahead, span = min(hi, c + limit + reach) - c, min(hi, c + limit) - c
        after = z_function(w[c : c + ahead].tolist())
        back = w[left:c][::-1].tolist()
        before = z_function([*back, -1, *w[left : c + span][::-1].tolist()])
        shift = len(back) + 1 + span
        for q in todo:
            r, b = after[q], before[shift - q] if back else 0
            covered[q] = c + r
            if b + r < q:
                continue
            if any(after[p] >= q - p + r and (not back or before[shift - p] >= b) for p in (q // f for f in prime_factors(q))):
                continue  # a smaller period holds for all of it
            if c + q + r == c + ahead:
                r += same_ahead(w, c + r, q, hi)
                covered[q] = c + r
            if back and b == len(back):
                b += same_behind(w, left, q, lo)
            if b + r + q >= max(least, 2 * q):
                out.append((q, c - b, c + q + r))
    return out


def coded(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of texts laid end to end, equal for equal words, and the texts' ends."""
    seen: dict[bytes, int] = {}
    number = seen.setdefault
    codes = [number(w, len(seen)) for t in texts for w in t]
    return np.array(codes, np.int64), np.cumsum([len(t) for t in texts], dtype=np.int64)


def scan(batch: pa.RecordBatch, least: int, tile_words: int) -> pa.RecordBatch:
    """The texts of a batch: their words, and the runs of those that are one tile."""
    words = [t.split() if t else [] for t in batch.column(2).cast(pa.binary()).to_pylist()]
    n = np.array([len(t) for t in words], np.int64)
    parts: list[list[dict] | None] = [None if m > tile_words else [] for m in n.tolist()]
    order = [i for i in np.argsort(-n, kind="stable").tolist() if least <= n[i] <= tile_words]
    w, ends = coded([words[i] for i in order])
    for octave in octaves(int(n[order[0]]) if order else 0):
        some = int((n[order] >= 2 * octave).sum())  # the longest come first
        for q, a, b in solve(w[: ends[some - 1]], ends[:some], octave, least):
            k = int(np.searchsorted(ends, a, "right"))
            start = int(ends[k - 1]) if k else 0
            parts[order[k]].append({"period": q, "start": a - start, "end": b - start})
    text = pa.array([b" ".join(t) for t in words], pa.binary()).cast(pa.string())
    kind = pa.list_(pa.struct([("period", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), text, pa.array(parts, kind)], names=["row", "id", "n_words", "text", "parts"])


def tiles(w: np.ndarray, tile_words: int, least: int) -> Iterator[tuple[int, list[int], np.ndarray]]:
    """(first word, octaves, words): overlapping tiles of a long text.

    Neighbours overlap by two periods and by ``least`` words at the least, so
    that the tile in which a run begins holds enough of it to see it, and each
    next one that it reaches too. Octaves with room for that in half a tile
    share tiles; each greater one has its own.
    """
    small = [p for p in octaves(len(w)) if max(2 * top(p), least) <= tile_words // 2]
    large = [[p] for p in octaves(len(w)) if p not in small]
    for some in [small, *large] if small else large:
        overlap = max(2 * top(some[-1]), least)
        step = max(tile_words - overlap, overlap)
        for a in range(0, max(1, len(w) - overlap), step):
            yield a, some, w[a : a + step + overlap]


def find_runs(docs: DataFrame, least: int = 12, tile_words: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, runs, collapsed) of each row of ``docs``: its periodic runs of words.

    Words are what white space (space, tab to carriage return) parts. A run is
    a maximal stretch with smallest period q of ``max(least, 2 * q)`` words or
    more; ``runs`` holds (start, length, period), by start, then period;
    ``collapsed`` is the text without the words that lie in a run after its
    first q, joined by single spaces.

    Texts are dealt out as overlapping tiles, those of up to ``tile_words``
    words as a single one that is solved where it is read. The tiles of longer
    texts are solved in any order by any task, one octave of periods at a time.
    Then only intervals are shuffled, by text and period, where those that
    overlap by a period are stitched into one; and the texts that have any are
    joined with their runs. A text has fewer runs than words, so no group is
    larger than its text.

    Defined cases: null, empty and word-free texts have no words, no runs and
    an empty ``collapsed``; rows count each for themselves, repeated and null
    ids too; columns besides id and text are not looked at; an empty table
    gives an empty result.
    """
    if least < 8:
        raise ValueError("least must be 8 or more: shorter runs of short periods are not looked for")
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 250):
                yield scan(batch.slice(lo, 250), least, tile_words)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = materialize(rows.mapInArrow(read, f"row long, id {kind}, n_words long, text string, parts {PARTS}"), "run-parts", codec="zstd")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                w, _ = coded([text.split()])
                for at, some, own in tiles(w, tile_words, least):
                    yield pa.RecordBatch.from_pylist([{"row": row, "at": at, "octaves": some, "words": own.astype("<i4").tobytes()}], dealt)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.to_pylist():
                w = np.frombuffer(t["words"], "<i4").astype(np.int64)
                found = [x for p in t["octaves"] for x in solve(w, np.array([len(w)]), p, least)]
                q, a, b = (np.array([x[i] for x in found], np.int64) for i in range(3))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), t["row"], np.int64)), pa.array(q), pa.array(a + t["at"]), pa.array(b + t["at"])], names=["row", "period", "start", "end"])

    dealt = pa.schema([("row", pa.int64()), ("at", pa.int64()), ("octaves", pa.list_(pa.int64())), ("words", pa.binary())])
    tiled = rows.filter("parts is null").select("row", "text").mapInArrow(cut, "row long, at long, octaves array<bigint>, words binary")
    tiled = tiled.repartition(partitions(spark), "row", "at", "octaves").mapInArrow(part, "row long, period long, start long, end long")
    whole = rows.select("row", F.inline("parts"))
    runs = materialize(stitched(whole.unionByName(tiled), least), "runs")

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, found in zip(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = text.split()
                gone = np.zeros(len(words) + 1, np.int64)
                for r in found:
                    gone[r["start"] + r["period"]] += 1
                    gone[r["start"] + r["length"]] -= 1
                out.append(b" ".join([x for x, g in zip(words, (np.cumsum(gone) > 0).tolist(), strict=False) if not g]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(out, pa.binary()).cast(pa.string())], names=["id", "n_words", "runs", "collapsed"])

    shape = "array<struct<start:bigint,length:bigint,period:bigint>>"
    some = rows.filter("parts is null or size(parts) > 0").select("row", "id", "n_words", "text").join(runs.hint("merge"), "row", "left")
    some = some.select("id", "n_words", "text", F.coalesce("runs", F.from_json(F.lit("[]"), shape)).alias("runs")).mapInArrow(collapse, f"id {kind}, n_words long, runs {shape}, collapsed string")
    none = rows.filter("size(parts) = 0").select("id", "n_words", F.from_json(F.lit("[]"), shape).alias("runs"), F.col("text").alias("collapsed"))
    return none.unionByName(some).withColumnRenamed("id", id_col)


def stitched(parts: DataFrame, least: int) -> DataFrame:
    """(row, runs): intervals (row, period, start, end) of one period that overlap by a period made one, as sorted arrays."""
    order = W.partitionBy("row", "period").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(before - F.col("start") >= F.col("period"), 0).otherwise(1)
    island = parts.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order))
    one = island.groupBy("row", "period", "island").agg(F.min("start").alias("start"), (F.max("end") - F.min("start")).alias("length"))
    one = one.filter(F.col("length") >= F.greatest(F.lit(least), 2 * F.col("period")))
    return one.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))
