"""Line dedup against a plain version: near copies, short lines, null and repeated ids."""

import collections
import re

import numpy as np
import pytest

from floorops.llm import lines
from floorops.llm.common import materialize

RARE = [f"r{i}" for i in range(4000)]
COMMON = ["the", "of", "and", "to", "a", "in"]


def plain(rows, threshold=0.8):
    """(id, text) -> numbers of the lines that have an earlier match; rows of one id in the order of line numbers."""
    places = collections.defaultdict(set)
    for i, t in rows:
        for no, line in enumerate([] if t is None else t.split("\n")):
            s = frozenset(w for w in re.split("[ \t\x0b\f\r]+", line) if w)
            if s:
                places[(i is not None, i or 0, no)].add((line, s))
    seen, gone = [], set()
    for at in sorted(places):
        for line, s in places[at]:
            if any(len(s & o) >= threshold * len(s | o) - 1e-9 for o in seen):
                gone.add((at, line))
        seen += {s for _, s in places[at]}
    return {(i, t): [no for no, line in enumerate([] if t is None else t.split("\n")) if ((i is not None, i or 0, no), line) in gone] for i, t in rows}


def changed(rng, words, n):
    out = list(words)
    for k in rng.choice(len(out), n, replace=False):
        out[k] = str(rng.choice(RARE))
    return out


@pytest.mark.parametrize("threshold", [0.8, 0.6, 1.0])
def test_near_copies_and_odd_rows(spark, threshold):
    rng = np.random.default_rng(7)
    base = [list(rng.choice(RARE, n)) + list(rng.choice(COMMON, 3)) for n in (4, 12, 30, 70, 150)]
    rows = []
    for i in range(150):
        some = [" ".join(changed(rng, base[k], int(rng.integers(0, max(2, len(base[k]) // 6))))) for k in rng.choice(5, 3)]
        some += [" ".join(rng.choice(COMMON, int(rng.integers(1, 5)))), "", " \t", "\t".join(rng.choice(RARE, 9))]
        rows.append((i % 120 if i % 11 else None, "\n".join(rng.permutation(some))))
    rows += [(3, None), (4, ""), (5, rows[0][1]), (5, rows[0][1]), (2**40, rows[1][1]), (-7, rows[2][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = plain(rows, threshold)
    got = lines.dedup_lines(df, threshold).collect()
    assert len(got) == len(rows)
    left = collections.Counter()
    for (i, t), gone in want.items():
        left[(i, None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone), tuple(gone))] += sum(r == (i, t) for r in rows)
    assert left == collections.Counter((r["doc_id"], r["text"], tuple(r["removed"])) for r in got)
    assert any(want.values())


def test_a_large_group_of_near_copies_makes_few_pairs(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = list(rng.choice(RARE, 40, replace=False))
    rows = [(i, " ".join(changed(rng, base, 2))) for i in range(600)]
    made = {}

    def counted(df, name):
        out = materialize(df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(lines, "materialize", counted)
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = plain(rows)
    assert {r["doc_id"]: r["removed"] for r in got} == {i: want[(i, t)] for i, t in rows}
    assert sum(bool(r["removed"]) for r in got) > 500
    assert made["line-tries"] + made["line-pairs"] < 20 * len(rows)
