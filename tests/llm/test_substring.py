import hashlib
from collections import defaultdict

import numpy as np

from docloom.llm import common
from docloom.llm import substring as S
from docloom.llm.common import words_of
from docloom.llm.hashing import Bloom


def brute(rows, length):
    first = defaultdict(list)
    for k, t in rows:
        w = words_of(t)
        for i in range(len(w) - length + 1):
            if k is not None:
                first[tuple(w[i : i + length])].append(k)
    out = []
    for k, t in rows:
        w = words_of(t)
        gone = set()
        for i in range(len(w) - length + 1):
            if k is not None and min(first[tuple(w[i : i + length])]) < k:
                gone.update(range(i, i + length))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((k, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df, length=50, anchor=20):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in S.rewrite(S.dedup(df, length, anchor), length).collect()), key=str)


def test_automaton_against_all_substrings():
    rng = np.random.default_rng(2)
    for _ in range(60):
        seqs = [rng.integers(0, 3, rng.integers(1, 25)).tolist() for _ in range(3)]
        a = S.SuffixAutomaton()
        for s in seqs:
            a.add(s)
        w = rng.integers(0, 4, 30).tolist()
        inside = lambda x: any(s[i : i + len(x)] == x for s in seqs for i in range(len(s)))
        want = [max((n for n in range(i + 2) if n == 0 or inside(w[i + 1 - n : i + 1])), default=0) for i in range(len(w))]
        assert list(a.statistics(w)) == want


def test_random_tables(spark):
    rng = np.random.default_rng(3)
    passages = [[f"p{k}_{i}" for i in range(int(rng.integers(5, 40)))] for k in range(12)]
    rows = []
    for _ in range(150):
        w = []
        for _ in range(int(rng.integers(0, 6))):
            p = passages[int(rng.integers(0, 12))]
            a = int(rng.integers(0, len(p)))
            w += p[a : a + int(rng.integers(1, 40))] + [f"x{int(rng.integers(0, 50))}" for _ in range(int(rng.integers(0, 4)))]
        rows.append((int(rng.integers(0, 120)), " ".join(w)))  # ids repeat, with other texts
    rows += [rows[0], (500, rows[0][1]), (None, rows[0][1]), (501, None), (502, ""), (503, "a\x0bb\x1cc")]
    df = spark.createDataFrame([(k, t, "x", 0) for k, t in rows], "doc_id long, text string, spans string, k int")
    assert got(df, 8, 4) == brute(rows, 8)


def test_hot_passage_is_shared_out(spark, monkeypatch):
    monkeypatch.setattr(S, "MOST_RUNS", 10)
    hot = " ".join(f"h{i}" for i in range(70))
    rows = [(k, f"a{k} b{k} {hot} c{k}") for k in range(120)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows, 50)


def test_shuffled_path(spark, monkeypatch):
    monkeypatch.setattr(common, "MOST_BROADCAST", 0)
    hot = " ".join(f"h{i}" for i in range(70))
    rows = [(k, f"a{k} {hot}") for k in range(20)] + [(50 + k, hot) for k in range(5)] + [(90 + k, f"alone {k}") for k in range(30)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows, 50)


def test_several_filters(spark, monkeypatch):
    """More anchors than one filter may hold: the texts are read once for each filter, and nothing is lost."""
    monkeypatch.setattr(Bloom, "MOST_BITS", 256)
    words = [" ".join(f"w{k}_{i}" for i in range(55)) for k in range(40)]
    rows = [(k, f"a{k} {words[k % 40]} b{k}") for k in range(120)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows, 50)


def test_very_long_text_and_repeated_rows(spark):
    long = " ".join(f"v{i % 70_001}" for i in range(200_000))
    rows = [(1, "q " + long), (2, long), (2, long), (3, long[:900] + " end")]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows, 50)


def test_empty(spark):
    assert got(spark.createDataFrame([], "doc_id long, text string")) == []


def test_whole_table(spark, sf, rows):
    have = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in S.op9_substring_dedup(spark, sf).collect()), key=str)
    assert have == brute(list(rows.items()), 50)
