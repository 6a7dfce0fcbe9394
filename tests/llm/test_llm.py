import collections
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from floorops.llm import html, lines, packing, queries, sharding, simhash, substrings
from floorops.llm.common import crc_mod
from floorops.llm.decontamination import benchmark_hits
from floorops.llm.quality import quality_scores
from floorops.llm.topk import BallTree, quantized, topk
from floorops.llm.toxicity import toxicity_scores

DDL = "doc_id long, text string, shard string, fp string, n_words string"
WORDS = [f"w{i}" for i in range(40)]


def make(spark, n=60, seed=1):
    rng = np.random.default_rng(seed)
    base = ["\n".join(" ".join(rng.choice(WORDS, rng.integers(1, 40))) for _ in range(rng.integers(1, 5))) for _ in range(n)]
    rows = [(i, base[i % (n - 8)] if i % 7 else base[0].replace("w1 ", "W1 "), "x", None, "y") for i in range(n)]
    rows += [(900, None, None, None, None), (901, "", None, None, None), (902, " \n\t ", None, None, None), (903, "A b", None, None, None), (904, " ".join(rng.choice(WORDS, 5000)), None, None, None)]
    rows += [rows[3], (None, base[2], None, None, None)]
    return spark.createDataFrame(rows, DDL).repartition(3), rows


def empty(spark):
    return spark.createDataFrame([], DDL)


def test_sharding(spark):
    df, rows = make(spark)
    got = sharding.shard_by_bytes(df, 8).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        assert r["size"] == len((r["text"] or "").encode()) + 1
        by[r["shard"]].append((r["slot"], r["size"]))
    assert all(sorted(s for s, _ in v) == list(range(len(v))) for v in by.values())
    most = max(r["size"] for r in got)
    want = sum(r["size"] for r in got) / 8
    assert all(abs(sum(x for _, x in by[k]) - want) <= most for k in range(8))
    assert sharding.shard_by_bytes(empty(spark), 8).count() == 0


def test_packing_round_trip(spark):
    df, rows = make(spark)
    df = df.filter("doc_id is not null").dropDuplicates(["doc_id"])
    tok = packing._tokenizer(None)
    got = packing.pack(df, 256).collect()
    docs, seqs = collections.defaultdict(dict), collections.defaultdict(list)
    for r in got:
        docs[r["doc_id"]][r["start"]] = np.frombuffer(r["ids"], "<u4")
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t, *_ in {r[0]: r for r in rows if r[0] is not None}.values():
        ids = np.concatenate([docs[i][s] for s in sorted(docs[i])]).tolist()
        assert ids == tok.encode(t or "", add_special_tokens=False).ids + [2]
    sizes = []
    for k in sorted(seqs):
        at = 0
        for o, n in sorted(seqs[k]):
            assert o == at
            at += n
        sizes.append(at)
    assert set(sizes[:-1]) <= {256} and 0 < sizes[-1] <= 256
    assert packing.pack(empty(spark)).count() == 0


@pytest.mark.parametrize("text", ["Hello,  WORLD!", "a\tb\x0bc d", "İstanbul ΣΑΣ", "'s it's", "x <|endoftext|> y", "́ é", "日本 語\n\n12 345"])
def test_tokens_by_words_equal_tokens_of_texts(text):
    w = packing.WordTokens(None)
    assert np.frombuffer(w.encode(text), "<u4").tolist() == w.tok.encode(text, add_special_tokens=False).ids


def test_anchor_code_meets_every_pair_within_two_bits():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    a = simhash.anchors(x)
    for flips in (0, 1, 2):
        y = x.copy()
        for i in range(len(y)):
            for b in rng.choice(64, flips, replace=False):
                y[i] ^= np.uint64(1) << np.uint64(b)
        b = simhash.anchors(y)
        assert all(np.intersect1d(p, q).size for p, q in zip(a, b, strict=True))


def brute_fp(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(simhash.LOWER))
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_groups(spark):
    df, rows = make(spark)
    got = {(r[0], r[1]): r[2] for r in simhash.simhash_components(df).collect()}
    fps = [brute_fp(r[1]) for r in rows]
    group = list(range(len(rows)))
    for _ in range(len(rows)):
        for i in range(len(rows)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 2:
                    group[i] = group[j] = min(group[i], group[j])
    least = collections.defaultdict(lambda: None)
    for r, g in zip(rows, group, strict=True):
        if r[0] is not None and (least[g] is None or r[0] < least[g]):
            least[g] = r[0]
    assert got == {(r[0], f"{fp:016x}"): least[g] for r, fp, g in zip(rows, fps, group, strict=True)}
    assert simhash.simhash_components(empty(spark)).count() == 0


def test_lines(spark):
    df, rows = make(spark)
    docs = sorted({(r[0] is not None, r[0] or 0, r[1]) for r in rows}, key=lambda r: r[:2])
    seen, gone = [], collections.defaultdict(list)
    for has, i, t in docs:
        for no, line in enumerate((t or "").split("\n")):
            s = frozenset(w for w in re.split("[ \t\x0b\f\r]+", line) if w)
            if len(s) >= 5:
                if any(5 * len(s & o) >= 4 * len(s | o) for o in seen):
                    gone[(has, i)].append(no)
                seen.append(s)
    got = {(r["doc_id"] is not None, r["doc_id"] or 0): (r["removed"], r["text"]) for r in lines.dedup_lines(df, min_words=5).collect()}
    for has, i, t in docs:
        removed, text = got[(has, i)]
        assert removed == gone[(has, i)]
        assert text == (None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[(has, i)]))
    assert lines.dedup_lines(empty(spark)).count() == 0


def test_lines_of_few_words(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, "\n".join(" ".join(rng.choice(WORDS[:6], rng.integers(0, 7))) for _ in range(6)), None, None, None) for i in range(80)]
    rows += [(100, "p q r s\np q r s t\np q r\nz z", None, None, None), (101, "s r q p\n\n \t\nz\n", None, None, None)]
    spark.createDataFrame(rows, DDL).write.parquet(f"{tmp_path}/documents.parquet")
    seen, want = [], {}
    for i, t, *_ in rows:
        gone = []
        for no, line in enumerate(t.split("\n")):
            s = frozenset(line.split())
            if s and any(5 * len(s & o) >= 4 * len(s | o) for o in seen):
                gone.append(no)
            seen += [s] if s else []
        want[i] = ",".join(map(str, gone))
    assert want[100] == "1" and want[101] == "0,3"
    assert {r["doc_id"]: r["removed"] for r in queries.QUERIES["op5_line_dedup"](spark, str(tmp_path)).collect()} == want
    piped = corpus_pipeline.lines(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert {r["doc_id"]: r["text"] for r in piped.collect()}[101] == "\n \t\n"


def test_substrings(spark):
    df, rows = make(spark)
    docs = sorted({(r[0] is not None, r[0] or 0, r[1] or "") for r in rows})
    seen, want = set(), {}
    for has, i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        gone = set()
        for p in range(len(w) - 19):
            g = tuple(w[p : p + 20])
            if g in seen:
                gone.update(range(p, p + 20))
            seen.add(g)
        want[(has, i)] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    got = substrings.remove_repeats(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert want[(r["doc_id"] is not None, r["doc_id"] or 0)] == (r["n_words"], r["n_removed"], r["kept"])
    assert substrings.remove_repeats(empty(spark)).count() == 0


def test_decontamination_blocks_and_short_items(spark):
    df, _ = make(spark)
    rows = [(1, " ".join(WORDS[:12])), (2, "w3"), (3, "W5, w6!"), (4, ""), (5, None), (6, "w3")]
    bench = spark.createDataFrame(rows, "item_id long, text string")
    docs = df.unionByName(spark.createDataFrame([(1000, "zz " + " ".join(WORDS[:11]) + " zz w3", None, None, None)], DDL))
    one = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in benchmark_hits(docs, bench).collect()}
    many = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in benchmark_hits(docs, bench, block_bytes=1).collect()}
    assert one == many
    assert one[1000] == (14, 12, ["1", "2", "3", "6"])
    assert one[900] == (0, 0, []) and one[901] == (0, 0, [])
    assert benchmark_hits(empty(spark), bench).count() == 0


def test_topk(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(0, 0.2, (300, 8)).astype(np.float32)
    v[50:90] = v[50]
    rows = [(i, v[i].tolist()) for i in range(300)] + [(300, None), (301, [1.0, None] + [0.0] * 6), (302, [float("nan")] * 8), (320, [])]
    q = quantized(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = collections.defaultdict(list)
    for r in topk(q.filter("id % 20 = 0"), q, 5, shard_rows=70, block_bytes=300).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    x = np.floor(64 * v.astype(np.float64)).astype(int)
    for i in range(0, 300, 20):
        s = x @ x[i]
        assert got[i] == [(j, s[j]) for j in sorted((j for j in range(300) if j != i), key=lambda j: (-s[j], j))[:5]]
    assert len(got) == 15


def test_topk_with_large_components_is_exact(spark):
    rng = np.random.default_rng(4)
    v = rng.integers(-(2**26), 2**26, (60, 4)).astype(float)
    v[7] = v[3]
    v[9, 0] = 5e7  # floor(64 x) is beyond 32 bits
    rows = [(i, (v[i] / (1 if i % 2 else 1024)).tolist()) for i in range(60)] + [(3, v[3].tolist())]
    q = quantized(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    x = [[int(np.floor(64 * c)) for c in r[1]] for r in rows]
    got = collections.defaultdict(list)
    for r in topk(q.filter("id % 20 = 0"), q, 6, shard_rows=16).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert sorted(got) == [0, 20, 40]
    for i in got:
        s = [(-sum(a * b for a, b in zip(x[i], y, strict=True)), rows[j][0]) for j, y in enumerate(x) if rows[j][0] != i]
        assert got[i] == [(j, -c) for c, j in sorted(s)[:6]]
    none = q.filter("false")
    assert topk(none, q).count() == 0 and topk(q, none).count() == 0


def test_ball_tree_leaves_out_branches():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.integers(-9, 9, (400, 6)) + c * 60 for c in rng.integers(-9, 9, (20, 6))])
    ids = rng.permutation(len(x))
    tree = BallTree(x, ids)
    q = x[:3]
    got = {i: list(zip(w.tolist(), s.tolist(), strict=True)) for i, w, s in tree.search(q, ids[:3], 5, np.full(3, -(2**62)))}
    for i in range(3):
        s = x @ q[i]
        assert got[i] == [(int(ids[j]), int(s[j])) for j in sorted((j for j in range(len(x)) if ids[j] != ids[i]), key=lambda j: (-s[j], ids[j]))[:5]]
    leaves = sum(n[2] < 0 for n in tree.nodes)
    assert tree.leaves_scored < leaves / 4 and tree.visited < len(tree.nodes) / 2


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><header>Site</header><nav><a href=x>Menu</a></nav><div class="cookie-notice">We use cookies</div>
<div class="post-7 content"><h1>Ti&amp;tle</h1><p>One <b>two
 three<p>Four&nbsp;five<br>six<div class="ad">Buy</div><form><p>mail</p></form><script>"</p>"</script></div><aside>More</aside><section id="comments"><p>Nice post</p></section><footer>&copy;</footer></body></html>"""


def test_html(spark):
    rows = [(1, "http://a.example/1", PAGE), (2, "http://a.example/2", PAGE.replace("post-7", "post-8")), (3, None, None), (4, "x", ""), (5, "http://a.example/3", "plain text"), (6, "http://b.example", "<p>a<p>b")]
    got = {r["page_id"]: r["main_text"] for r in html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == got[2] == "Ti&tle\nOne two three\nFour five six"
    assert got[3] == got[4] == "" and got[5] == "plain text" and got[6] == "a\nb"


def test_scores(spark):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(400):
        bad, junk = i % 4 == 0, i % 5 == 0
        w = list(rng.choice(WORDS, 60)) + ([f"grobl{rng.choice(list('abcdef'))}x"] * 3 if bad else [])
        rows.append((i, " ".join(x.upper() + "!!" if junk else x for x in w), None, None, None))
        labels.append((i, int(not junk), int(bad)))
    df = spark.createDataFrame(rows + [(None, None, None, None, None), (1000, "", None, None, None)], DDL)
    lab = spark.createDataFrame(labels + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    t = {r["doc_id"]: r["score"] for r in toxicity_scores(df, lab, crc_mod("doc_id", 4) != 2).collect()}
    q = {r["doc_id"]: r["score"] for r in quality_scores(df, lab, crc_mod("doc_id", 5) != 0).collect()}
    assert len(t) == len(q) == 402 and all(0 <= x <= 1 for x in [*t.values(), *q.values()])
    assert np.mean([(t[i] >= 0.3) == bool(b) for i, _, b in labels]) > 0.95
    assert np.mean([(q[i] >= 0.3) == bool(a) for i, a, _ in labels]) > 0.95
    none = lab.filter("false")
    assert {r["score"] for r in toxicity_scores(df, none, F.lit(True)).collect()} == {0.5}
    assert quality_scores(df, none, F.lit(True)).count() == 402
    assert toxicity_scores(empty(spark), lab, F.lit(True)).count() == 0 and quality_scores(empty(spark), lab, F.lit(True)).count() == 0


@pytest.mark.parametrize("scores", [toxicity_scores, quality_scores])
def test_small_samples_keep_the_class_rate(spark, scores):
    rng = np.random.default_rng(6)
    rows, toxic, quality = [], [], []
    for i in range(20_000):
        kind = i % 25 < 2  # 8 % of the texts: a fifth of them toxic, half of them of low quality
        rows.append((i, " ".join([*rng.choice(WORDS, 6), "zqxv" if kind else "w1"]).upper() if kind else " ".join(rng.choice(WORDS, 6)), None, None, None))
        toxic.append(int(rng.random() < (0.2 if kind else 0.004)))
        quality.append(int(rng.random() < (0.5 if kind else 0.995)))
    df = spark.createDataFrame(rows, DDL)
    lab = spark.createDataFrame([(i, q, t) for i, (q, t) in enumerate(zip(quality, toxic, strict=True))], "doc_id long, quality int, toxic int")
    whole, small = (scores(df, lab, F.lit(True), max_rows_per_class=n).select(F.avg((F.col("score") >= 0.3).cast("int")), F.avg("score")).first() for n in (100_000, 1_000))
    assert abs(whole[0] - small[0]) < 0.02 and abs(whole[1] - small[1]) < 0.02


def test_queries_have_the_contract_columns(spark):
    got = queries.QUERIES["op1_sharding"](spark, "/root/testdata/sf0.001")
    assert got.dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")]
    r = got.join(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "doc_id").select("text", "text_crc32").first()
    assert zlib.crc32(r["text"].encode()) == r["text_crc32"]
