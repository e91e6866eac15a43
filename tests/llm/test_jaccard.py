from collections import Counter, defaultdict

import numpy as np
import pytest

from docloom.llm import common
from docloom.llm import jaccard as J
from docloom.llm.common import words_of


def shingles(text):
    w = words_of(text)
    k = min(5, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def brute(rows):
    """{(doc_id, text): (class, links)} from all pairs of different texts."""
    rep = {}
    for k, t in sorted((k, t) for k, t in rows if k is not None and words_of(t)):
        rep.setdefault(t, k)
    sets = {k: shingles(t) for t, k in rep.items()}
    inv = defaultdict(list)
    for k, s in sets.items():
        for x in s:
            inv[x].append(k)
    parent, links = {k: k for k in sets}, Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in sets.items():
        for j, n in Counter(j for x in s for j in inv[x] if j > k).items():
            if n >= 0.8 * (len(s) + len(sets[j]) - n) - 1e-9:
                links[k] += 1
                links[j] += 1
                a, b = find(k), find(j)
                parent[max(a, b)] = min(a, b)
    return {(k, t): (find(rep[t]), links[rep[t]]) if k is not None and t in rep else (k, 0) for k, t in rows}


def got(df):
    return {r["doc_id"]: (r["class_id"], r["n_links"]) for r in J.jaccard_classes(df).collect()}


def test_whole_table(spark, sf, rows):
    want = brute(rows.items())
    have = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in J.op7_ngram_jaccard(spark, sf).collect()}
    assert have == {k: v for (k, _), v in want.items()}


@pytest.mark.parametrize("block", [256, 7])
def test_many_near_copies(spark, monkeypatch, block):
    monkeypatch.setattr(J, "BLOCK", block)
    rng = np.random.default_rng(1)
    base = [f"w{x}" for x in rng.integers(0, 500, 120)]
    rows = []
    for k in range(90):
        w = list(base)
        for p in rng.integers(0, 120, k % 4):
            w[p] = f"n{k}{p}"
        rows.append((k, " ".join(w)))
    rows += [(100 + k, " ".join(f"u{k}_{i}" for i in range(60))) for k in range(40)]
    want = brute(rows)
    have = got(spark.createDataFrame(rows, "doc_id long, text string"))
    assert have == {k: v for (k, _), v in want.items()}


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "one  two"), (6, "one two"), (7, "one three"), (None, "one two"), (8, "x " * 30_000), (9, "x " * 29_999), (4, "one two")]
    df = spark.createDataFrame([(k, t, "c", [1]) for k, t in rows], "doc_id long, text string, class_id string, bands array<int>")
    out = J.jaccard_classes(df).collect()
    assert len(out) == len(rows)
    have = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in out}
    want = {k: v for (k, _), v in brute([r for r in rows if r[0] is not None]).items()} | {None: (None, 0)}
    assert have == want
    assert J.jaccard_classes(df.limit(0)).count() == 0


def test_different_texts_of_one_doc_id(spark):
    t, u = " ".join(f"t{k}" for k in range(60)), " ".join(f"u{k}" for k in range(60))
    rows = [(5, t), (5, t + " end"), (5, u), (5, u), (7, t + " more"), (8, u + " end"), (3, u + " more")]
    out = J.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    have = Counter((r["doc_id"], r["class_id"], r["n_links"], r["n_copies"], r["rep_id"]) for r in out)
    assert have == Counter({(5, 5, 2, 1, 5): 2, (7, 5, 2, 1, 7): 1, (5, 3, 2, 2, 5): 2, (8, 3, 2, 1, 8): 1, (3, 3, 2, 1, 3): 1})


def test_shuffled_path(spark, monkeypatch, docs, rows):
    """Past the bound of what is broadcast the texts of members alone are shuffled; the result is the same."""
    monkeypatch.setattr(common, "MOST_BROADCAST", 0)
    want = brute(rows.items())
    assert got(docs) == {k: v for (k, _), v in want.items()}
    kept = {r["doc_id"] for r in J.pipeline_near_duplicates(docs).collect()}
    assert kept == {k for (k, _), (c, _) in want.items() if k == c}


def test_roots_and_intersections_against_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(40):
        n = int(rng.integers(2, 60))
        i, j = rng.integers(0, n, (2, int(rng.integers(1, 50))))
        root = list(range(n))
        for _ in range(n):
            for a, b in zip(i, j, strict=True):
                root[a] = root[b] = min(root[a], root[b])
        assert J._roots(n, i, j).tolist() == root
        sets = [np.unique(rng.integers(0, 6000, int(rng.integers(1, 4000))).astype(np.uint64)) for _ in range(12)]
        for i, j in ((np.array([0, 3]), np.array([4, 2])), tuple(np.array(x) for x in zip(*[(a, b) for a in range(6) for b in range(6, 12)], strict=True)) * 1):
            assert J._intersections(sets, i, j).tolist() == [len(set(sets[a]) & set(sets[b])) for a, b in zip(i, j, strict=True)]
        sig = rng.integers(0, 4, (14, 5)).astype(np.uint64)
        for band in range(5):
            got_pairs = set(zip(*(x.tolist() for x in J._pairs(sig, sig, band, True)), strict=True))
            assert got_pairs == {(a, b) for a in range(14) for b in range(a + 1, 14) if next((k for k in range(5) if sig[a, k] == sig[b, k]), -1) == band}


def test_bands():
    b, r = J.choose_bands(0.8, 0.9995)
    assert 1 - (1 - 0.8**r) ** b >= 0.9995 and b <= J.MOST_BANDS


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (102, 101), (7, 7)]
    out = {r["id"]: r["component"] for r in J.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert out == {**{k: 1 for k in range(1, 41)}, 100: 100, 101: 100, 102: 100}


def test_stage_keeps_one_of_each(spark):
    t = " ".join(map(str, range(60)))
    df = spark.createDataFrame([(5, t, "a"), (3, t + " end", "b"), (9, "alone", "c"), (None, t, "d"), (10, None, "e")], "doc_id long, text string, lang string")
    out = J.pipeline_near_duplicates(df)
    assert out.columns == df.columns and {r["lang"] for r in out.collect()} == {"b", "c", "d", "e"}


def test_stage_keeps_one_row_of_repeated_ones(spark):
    t, u = " ".join(map(str, range(60))), " ".join(f"u{k}" for k in range(60))
    rows = [(3, t, "a"), (3, t, "a"), (3, t, "b"), (5, t, "c"), (3, t + " end", "d"), (3, u, "e"), (9, u + " end", "f"), (7, "alone", "g"), (7, "alone", "g"), (None, t, "h"), (None, t, "h"), (8, "", "i"), (8, "", "i")]
    out = [(r["doc_id"], r["text"]) for r in J.pipeline_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()]
    first = [x for x in out if x[0] == 3 and x[1].startswith("0 ")]
    assert len(first) == 1 and first[0][1] in (t, t + " end")
    assert Counter(x for x in out if x not in first) == Counter({(3, u): 1, (7, "alone"): 1, (None, t): 2, (8, ""): 2})
