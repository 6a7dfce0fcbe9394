"""SimHash near-duplicates found at the anchors of a Hamming code."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorops.llm.common import materialize, partitions
from floorops.llm.components import components

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bits 1 to 63 of a fingerprint are the places of the Hamming code [63, 57]; bit 0 lies outside it.
PLACE_BITS = [np.uint64(sum(1 << p for p in range(1, 64) if p >> j & 1)) for j in range(6)]
ONE = np.uint64(1)


def fingerprint(text: bytes | None, size: int = 3) -> int:
    """SimHash of a text's word shingles by XXH64 with seed 42; 0 without words."""
    from xxhash import xxh64_intdigest

    words = text.translate(LOWER).split() if text else []
    if not words:
        return 0
    if len(words) <= size:
        h = [xxh64_intdigest(b" ".join(words), 42)]
    else:
        flat = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate([[0], ends[:-size]]).tolist()
        h = [xxh64_intdigest(flat[a:b], 42) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)]
    n = len(h)
    ones = np.zeros(64, np.int64)
    raw = np.array(h, np.uint64)
    for lo in range(0, n, 8192):
        some = raw[lo : lo + 8192].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, fp): a hash of the text, and the fingerprint, as signed 64-bit numbers."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                some = batch.slice(lo, 1000)
                fp = np.array([fingerprint(t, size) for t in some.column(1).cast(pa.binary()).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array(fp.view(np.int64))], names=["id", "text_key", "fp"])

    return docs.select(id_col, text_col, F.xxhash64(text_col)).mapInArrow(run, f"id {kind}, text_key long, fp long")


def syndrome(x: np.ndarray) -> np.ndarray:
    """Of each fingerprint's 63 code bits: the place to flip for the nearest code word, 0 for none."""
    s = np.zeros(len(x), np.uint64)
    for j, mask in enumerate(PLACE_BITS):
        s |= (np.bitwise_count(x & mask).astype(np.uint64) & ONE) << np.uint64(j)
    return s


def anchors(x: np.ndarray) -> np.ndarray:
    """(n, 32) code words within distance 2 of each fingerprint, repeats for code words themselves.

    Flipping places i and j leads to a code word if i ^ j is the syndrome;
    place 0 stands for no flip, so that the pair (0, syndrome) is the nearest.
    """
    base, s = x & ~ONE, syndrome(x)
    i = np.arange(64, dtype=np.uint64)[None, :]
    j = i ^ s[:, None]
    flips = np.where(i > 0, ONE << i, np.uint64(0)) | np.where(j > 0, ONE << j, np.uint64(0))
    flips = np.where(s[:, None] == 0, np.uint64(0), flips)
    order = np.argsort(~((i < j) | (s[:, None] == 0)), axis=1, kind="stable")[:, :32]  # each pair once
    return base[:, None] ^ np.take_along_axis(flips, order, 1)


def near_links(fps: np.ndarray, most: int) -> list[tuple[int, int]]:
    """A spanning forest of the links (at most ``most`` differing bits) among an anchor's fingerprints."""
    todo = np.ones(len(fps), bool)
    out = []
    while todo.any():
        front = [int(np.flatnonzero(todo)[0])]
        todo[front[0]] = False
        while front:
            at = front.pop()
            rest = np.flatnonzero(todo)
            near = rest[np.bitwise_count(fps[rest] ^ fps[at]) <= most]
            todo[near] = False
            out += [(at, int(x)) for x in near]
            front += near.tolist()
    return out


def anchor_links(fps: DataFrame) -> DataFrame:
    """(a, b): links that connect all fingerprints of ``fps`` (distinct, column fp) at 2 or fewer differing bits.

    The anchors are the words of the perfect Hamming code [63, 57], covering
    radius 1. Two fingerprints that differ in up to 2 bits have one between
    them within 1 of both, and that one has an anchor within 1: so both lie
    within 1 + 2/2 of a common anchor, and each is sent to the (up to 32)
    anchors within distance 2. No more than 2 * (1 + 63 + 63 * 62 / 2) different
    fingerprints can meet at an anchor, however many documents there are;
    there they are compared, and links that connect them are kept, not all
    pairs.
    """
    spark = fps.sparkSession

    def spread(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            x = p["fp"].to_numpy(np.int64).view(np.uint64)
            a = anchors(x)
            same = syndrome(x) == 0
            keep = np.ones(a.shape, bool)
            keep[same, 1:] = False
            yield pd.DataFrame({"anchor": a[keep].view(np.int64), "fp": np.repeat(p["fp"].to_numpy(), keep.sum(axis=1))})

    def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = None
        for p in parts:  # sorted by anchor; the last anchor of a batch may go on in the next
            p = p if left is None else pd.concat([left, p], ignore_index=True)
            cut = int(np.searchsorted(p["anchor"].to_numpy(), p["anchor"].iloc[-1], "left"))
            left = p.iloc[cut:]
            yield links(p.iloc[:cut])
        if left is not None:
            yield links(left)

    def links(p: pd.DataFrame) -> pd.DataFrame:
        key, fp = p["anchor"].to_numpy(), p["fp"].to_numpy(np.int64)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.array([], np.int64)
        last = np.append(first[1:], len(key))
        out = []
        for lo, hi in zip(first[last - first > 1].tolist(), last[last - first > 1].tolist(), strict=True):
            out += [(lo + a, lo + b) for a, b in near_links(fp[lo:hi].view(np.uint64), 2)]
        pairs = np.array(out, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": fp[pairs[:, 0]], "b": fp[pairs[:, 1]]})

    sent = fps.mapInPandas(spread, "anchor long, fp long").repartition(partitions(spark), "anchor").sortWithinPartitions("anchor", "fp")
    return sent.mapInPandas(compare, "a long, b long")


def _groups(fps: DataFrame) -> DataFrame:
    """(fp, root) of every fingerprint of ``fps``: those that links connect have one root."""
    each = fps.select("fp").distinct()
    found = components(anchor_links(each))
    return materialize(each.join(found, each["fp"] == found["node"], "left").select("fp", F.coalesce("root", "fp").alias("root")), "rooted")


def simhash_components(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id): near-duplicate groups of SimHash fingerprints.

    Documents of one fingerprint are linked, and those whose fingerprints
    differ in at most 2 bits; a component is all that links reach, named by its
    smallest id. Only distinct fingerprints are compared (a hot group of copies
    is one), at the anchors of a covering code (``anchor_links``).

    Defined cases: null, empty and word-free texts have fingerprint 0, linked
    like any other; a null id is a member and names a component only if all its
    ids are null; repeated ids are members each; an empty table gives an empty
    result.
    """
    fps = materialize(fingerprints(docs, size, id_col, text_col), "fingerprints")
    groups = _groups(fps)
    least = fps.groupBy("fp").agg(F.min("id").alias("least"))
    names = groups.join(least, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = groups.join(names, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def dedup_simhash(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` of each component of ``simhash_components``, with all columns, whatever their names.

    The one with the smallest id stays, null ids last, and of several texts of
    that id the one with the smallest hash. Rows are told apart by id and text,
    not by id alone.

    Defined cases: null, empty and word-free texts are near copies of each
    other; of rows with the same id and text one stays, whatever else they
    hold; an empty table gives an empty result.
    """
    fps = materialize(fingerprints(docs, size, id_col, text_col), "fingerprints")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "text_key")
    least = fps.groupBy("fp").agg(F.min(order).alias("least"))
    stays = _groups(fps).join(least, "fp").groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.id").alias("kept_id"), F.col("least.text_key").alias("kept_key"))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"))
    kept = rows.join(stays, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("text_key") == F.col("kept_key")), "left_semi")
    return kept.dropDuplicates(["id", "text_key"]).select(*[F.col("row")[c].alias(c) for c in docs.columns])
