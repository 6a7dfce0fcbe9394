"""Benchmark decontamination by Wu-Manber search for word windows."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorops.llm.common import materialize, without

#: A-Z to a-z; every byte that is no ASCII letter or digit and below 0x80 to a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
#: Words in a block of the shift table.
BLOCK = 2


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class WuManber:
    """Search for many word sequences of one length.

    ``shift`` says how far a block of words can be moved on before any pattern
    could end in it; only a block that ends a pattern has shift 0, and its
    bucket then holds the patterns to compare word by word. For patterns of one
    word the block is that word.
    """

    def __init__(self, patterns: dict[tuple, list]):
        self.m = len(next(iter(patterns)))
        self.block = min(BLOCK, self.m)
        self.far = self.m - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.bucket: dict[tuple, list] = defaultdict(list)
        for words, items in patterns.items():
            for end in range(self.block, self.m + 1):
                key = words[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.far), self.m - end)
            self.bucket[words[self.m - self.block :]].append((list(words), items))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list]]:
        """(first word, items) of each occurrence."""
        m, shift, far, n = self.m, self.shift, self.far, len(words)
        end = m
        if self.block == 2:
            while end <= n:
                key = (words[end - 2], words[end - 1])
                step = shift.get(key, far)
                if step:
                    end += step
                    continue
                for pattern, items in self.bucket[key]:
                    if words[end - m : end] == pattern:
                        yield end - m, items
                end += 1
        else:
            for at, w in enumerate(words):
                if (w,) in shift:
                    yield at, self.bucket[(w,)][0][1]


def _patterns(items: list[tuple], window: int) -> list[dict[tuple, list]]:
    """Windows by their length; an item of fewer words is one window."""
    by: dict[int, dict[tuple, list]] = defaultdict(lambda: defaultdict(list))
    for item, text in items:
        words = words_of(text)
        size = min(window, len(words))
        for at in range(len(words) - size + 1) if size else ():
            found = by[size][tuple(words[at : at + size])]
            if item not in found:
                found.append(item)
    return [dict(by[k]) for k in sorted(by)]


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 32 << 20
) -> DataFrame:
    """Mark the words of each text that lie in an occurrence of a benchmark window.

    Adds ``n_words``, ``n_hit``, ``items`` (ids of the items with occurring
    windows, sorted as strings) and ``spans`` (first word and length of each
    maximal run of hit words).

    The benchmark goes to the tasks in blocks of at most ``block_bytes`` of
    text (or one item, if that is longer); a benchmark within one block is
    searched in a single pass without a shuffle, a larger one in one pass for
    each block, the spans so far being written and read again between passes.

    Defined cases: null or word-free texts have 0 words and no hits; items that
    are null, word-free or without an id are left out; repeated items all
    report; an empty benchmark hits nothing.
    """
    new = ["n_words", "n_hit", "items", "spans"]
    d = without(docs, *new)
    d = d.withColumns(
        {"n_words": F.lit(0).cast("long"), "n_hit": F.lit(0).cast("long"), "items": F.array().cast("array<string>"), "spans": F.array().cast("array<struct<start:int,length:int>>")}
    )
    rows = benchmark.filter(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull()).select(
        F.col(item_col).cast("string").alias("i"), F.encode(item_text_col, "UTF-8").alias("t")
    )
    block: list[tuple] = []
    held, passes = 0, 0
    for r in rows.toLocalIterator():
        if block and held + len(r["t"]) > block_bytes:
            d, block, held, passes = materialize(_search(d, block, window, text_col), "hits"), [], 0, passes + 1
        block.append((r["i"], bytes(r["t"])))
        held += len(r["t"])
    return _search(d, block, window, text_col)


def _search(d: DataFrame, items: list[tuple], window: int, text_col: str) -> DataFrame:
    schema, at = d.schema, d.columns.index(text_col)
    names = d.columns
    n_words, n_hit, ids, spans = (names.index(c) for c in ("n_words", "n_hit", "items", "spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [WuManber(p) for p in _patterns(items, window)]
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                some = batch.slice(lo, 1000)
                old_ids, old_spans = some.column(ids).to_pylist(), some.column(spans).to_pylist()
                out: list[list] = [[], [], [], []]
                for text, had, ran in zip(some.column(at).cast(pa.binary()).to_pylist(), old_ids, old_spans, strict=True):
                    words = words_of(text)
                    found = set(had)
                    hit = None
                    for s in searches:
                        for first, who in s.search(words):
                            if hit is None:
                                hit = np.zeros(len(words) + 2, np.int8)
                            hit[first + 1 : first + 1 + s.m] = 1
                            found.update(who)
                    for r in ran if hit is not None or len(searches) == 0 else ():
                        if hit is None:
                            hit = np.zeros(len(words) + 2, np.int8)
                        hit[r["start"] + 1 : r["start"] + 1 + r["length"]] = 1
                    if hit is None:
                        runs, total = ran, sum(r["length"] for r in ran)
                    else:
                        edge = np.diff(hit)
                        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                        runs = [{"start": int(x), "length": int(y - x)} for x, y in zip(a, b, strict=True)]
                        total = int(hit.sum())
                    for column, v in zip(out, (len(words), total, sorted(found), runs), strict=True):
                        column.append(v)
                columns = list(some.columns)
                for k, v in zip((n_words, n_hit, ids, spans), out, strict=True):
                    columns[k] = pa.array(v, some.schema.field(k).type)
                yield pa.RecordBatch.from_arrays(columns, schema=some.schema)

    return d.mapInArrow(run, schema)
