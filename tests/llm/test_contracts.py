"""Columns of the registered queries, and their digests against plain ones on the smallest tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

from floorops.llm import packing, queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op2_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op3_html_extraction": "page_id bigint, url string, text string, n_chars bigint",
    "op4_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op6_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op7_topk": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op8_substrings": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op9_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op10_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op11_vector_links": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op12_hard_negatives": "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
    "op13_runs": "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(spark, name):
    got = queries.QUERIES[name](spark, SF)
    assert ", ".join(f"{c} {t}" for c, t in got.dtypes) == COLUMNS[name]


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def test_sharding_digests_and_law(spark, docs):
    got = queries.op1_sharding(spark, SF).collect()
    by = collections.defaultdict(list)
    for r in got:
        raw = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        by[r["shard"]].append((r["slot"], r["size"]))
    assert sorted(by) == list(range(8)) and len(got) == len(docs)
    mean, most = sum(r["size"] for r in got) / 8, max(r["size"] for r in got)
    for rows in by.values():
        assert sorted(s for s, _ in rows) == list(range(len(rows))) and abs(sum(n for _, n in rows) - mean) <= most


def test_packing_digests(spark, docs):
    tok = packing._tokenizer(None)
    ids = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in docs.items()}
    seen, offsets = collections.defaultdict(int), collections.defaultdict(list)
    for r in queries.op6_packing(spark, SF).collect():
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
        seen[r["doc_id"]] += r["length"]
        offsets[r["sequence_id"]].append((r["offset"], r["length"]))
    assert seen == {i: len(x) for i, x in ids.items()}
    for rows in offsets.values():
        at = 0
        for o, n in sorted(rows):
            assert o == at
            at += n
        assert at <= 4096


def test_substring_and_benchmark_digests(spark, docs):
    for r in queries.op8_substrings(spark, SF).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", docs[r["doc_id"]] or "")
        assert r["n_words"] == len(words)
        if not r["n_removed"]:
            assert r["kept_sha256"] == hashlib.sha256(" ".join(words).encode()).hexdigest()
    empty = hashlib.sha256(b"").hexdigest()
    got = queries.op9_decontamination(spark, SF).collect()
    assert {r["contaminated"] for r in got} == {True, False}
    assert all((r["items_sha256"] == empty) == (r["n_items"] == 0) == (not r["contaminated"]) == (r["n_hit"] == 0) for r in got)


@pytest.mark.parametrize("name, mod, out", [("op2_toxicity", 4, 2), ("op10_quality", 5, 0)])
def test_scores_and_held_out_rows(spark, docs, name, mod, out):
    got = queries.QUERIES[name](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % mod == out)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
