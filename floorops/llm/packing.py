"""Concatenate-and-cut packing of token ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorops.llm.common import materialize

#: Bytes that a worker's remembered pieces may take, about.
CACHE_BYTES = 160 << 20
#: Longer pieces are encoded each time and not remembered.
CACHE_LENGTH = 48
#: Anything but ASCII and those letters and signs of Latin-1 whose class, lower case and normal form are plain; or what may begin a special token.
_OTHER = r"[^\x00-\x7f\x{a1}-\x{a9}\x{ab}\x{ac}\x{ae}-\x{b1}\x{b4}\x{b6}-\x{b8}\x{bb}\x{bf}-\x{ff}]|<\|"
#: The tokenizer's own pattern (a fixed value) for plain texts in lower case, with the white space before.
_PART = r"[ \t\n\x0b\f\r]*('s|'t|'re|'ve|'m|'ll|'d|[a-z\x{df}-\x{f6}\x{f8}-\x{ff}]+|[0-9]|[^ \t\n\x0b\f\ra-z0-9\x{df}-\x{f6}\x{f8}-\x{ff}]+)"


def _tokenizer(path: str | None):
    from tokenizers import Tokenizer

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return Tokenizer.from_file(path)


class WordTokens:
    """Token ids (little-endian unsigned 32-bit) of whole texts, for a tokenizer that drops white space.

    Such a tokenizer first cuts a text into parts, which Arrow does here for
    plain texts, by the tokenizer's own pattern. Of other texts the pieces
    between spaces and line feeds are taken, across which no token reaches.
    Arrow also finds the different parts or pieces of a column, so that only
    these are looked up; their ids are then gathered for all places. Each is
    encoded once and remembered: parts many at a time, as each ends with the
    one token that marks a word's end. What is remembered is forgotten when it
    takes about ``CACHE_BYTES``. A worker keeps it from task to task.
    """

    def __init__(self, path: str | None):
        self.tok = _tokenizer(path)
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}
        self.held = 0

    @classmethod
    def of(cls, path: str | None) -> WordTokens:
        if path not in _WORKER:
            _WORKER[path] = cls(path)
        return _WORKER[path]

    def raw(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(pieces, add_special_tokens=False)]

    def parts(self, parts: list[str]) -> list[bytes]:
        """Ids of parts, encoded joined by spaces; they are cut after each word's end."""
        out: list[bytes] = []
        runs = [parts[lo : lo + 1024] for lo in range(0, len(parts), 1024)]
        for some, e in zip(runs, self.tok.encode_batch_fast([" ".join(r) for r in runs], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(some):
                whole, at = ids.tobytes(), (4 * ends).tolist()
                out += [whole[lo:hi] for lo, hi in zip([0, *at], at, strict=False)]
            else:
                out += self.raw(some)
        return out

    def _gather(self, cut: pa.ListArray, encode) -> tuple[np.ndarray, np.ndarray]:
        coded = cut.flatten().dictionary_encode()
        different = coded.dictionary.to_pylist()
        if self.held > CACHE_BYTES:
            self.known, self.held = {"": b""}, 0
        known = self.known
        new = [w for w in different if w not in known]
        found = dict(zip(new, encode(new), strict=True))
        short = {w: x for w, x in found.items() if len(w) <= CACHE_LENGTH}
        known.update(short)
        self.held += sum(map(len, short)) + 180 * len(short)
        raw = [found[w] if w in found else known[w] for w in different]
        size = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        first = np.cumsum(size) - size
        code = coded.indices.to_numpy()
        n = size[code]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = np.frombuffer(b"".join(raw), "<u4")[np.repeat(first[code] - (ends - n), n) + np.arange(total)]
        return ids, np.concatenate([[0], ends])[cut.offsets.to_numpy() - cut.offsets[0].as_py()]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, edges): the ids of all texts one after another, and where each text's begin and end."""
        texts = pc.fill_null(texts, "")
        other = pc.match_substring_regex(texts, _OTHER)
        plain = texts if not pc.any(other).as_py() else texts.filter(pc.invert(other))
        spaced = pc.replace_substring_regex(pc.ascii_rtrim(pc.utf8_lower(plain), " \t\n\x0b\f\r"), _PART, r" \1")
        ids, edges = self._gather(pc.split_pattern(spaced, " "), self.parts)
        if len(plain) == len(texts):
            return ids, edges
        rest = pc.split_pattern(pc.replace_substring(texts.filter(other), "\n", " "), " ")
        both = iter(np.split(ids, edges[1:-1]) if len(plain) else []), iter((lambda i, e: np.split(i, e[1:-1]))(*self._gather(rest, self.raw)))
        each = [next(both[o]) for o in other.to_pylist()]
        return np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])

    def encode(self, text: str) -> bytes:
        return self.encode_column(pa.array([text], pa.string()))[0].tobytes()


#: The tokenizers and remembered pieces of this worker process.
_WORKER: dict[tuple, WordTokens] = {}


def slices(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text (column 1) each, or one row."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    lo = 0
    while lo < batch.num_rows:
        before = size[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(size, before + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def tokenize(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, part, start, n, ids): each document's ids and its place in its partition's run of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        part, at = TaskContext.get().partitionId(), 0
        words = WordTokens.of(tokenizer)
        for batch in batches:
            for some in slices(batch):
                ids, edges = words.encode_column(some.column(1))
                ids = np.insert(ids, edges[1:], end_id).astype("<u4")
                edges = edges + np.arange(len(edges))
                n = np.diff(edges)
                raw = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(4 * edges), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(at + edges[:-1]), pa.array(n), raw], names=["id", "part", "start", "n", "ids"])
                at += int(edges[-1])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, part int, start long, n long, ids binary")


def pack(docs: DataFrame, length: int = 4096, tokenizer: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Concatenate all documents' tokens and cut the stream every ``length`` tokens.

    First pass: tokenize, keeping each document's place within its partition,
    and write the ids to the shared folder, which fixes the partitions. The
    partition totals (one number a partition) become global offsets by a prefix
    sum. Second pass: a document that starts at offset g has its tokens in the
    windows g // length onward; a document that a window's edge runs through
    gives one record on each side. Nothing is shuffled and only the last
    sequence is short. The second pass needs no Python.

    Returns one row per piece: id, ``start`` (ids of the document before the
    piece), ``length``, ``ids`` (little-endian unsigned 32-bit), ``doc_tokens``
    (with the end id), ``sequence_id``, ``offset`` (place in the sequence).

    Defined cases: null and empty texts give the end id alone; null and repeated
    ids are documents like others; an empty table gives an empty result; other
    columns are not carried.
    """
    tokens = materialize(tokenize(docs, tokenizer, end_id, id_col, text_col), "tokens")
    offsets, at = [], 0
    for part, total in sorted(tokens.groupBy("part").agg(F.sum("n")).collect()):
        offsets.append((part, at))
        at += total
    first = F.broadcast(docs.sparkSession.createDataFrame(offsets, "part int, first long"))  # one row a partition
    size = F.lit(length).cast("bigint")

    def piece(seq):
        start = F.greatest(seq * size - F.col("g"), F.lit(0))
        n = F.least((seq + 1) * size - F.col("g"), F.col("n")) - start
        ids = F.substring(F.col("ids"), (start * 4 + 1).cast("int"), (n * 4).cast("int"))
        return F.struct(start.alias("start"), n.alias("length"), ids.alias("ids"), F.col("n").alias("doc_tokens"), seq.alias("sequence_id"), (F.col("g") + start - seq * size).alias("offset"))

    placed = tokens.join(first, "part").withColumn("g", F.col("first") + F.col("start"))
    windows = F.sequence(F.expr(f"g div {int(length)}"), F.expr(f"(g + n - 1) div {int(length)}"))
    return placed.select(F.col("id").alias(id_col), F.inline_outer(F.transform(windows, piece)))
