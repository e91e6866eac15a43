import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import classifier as C
from docloom.llm import common
from docloom.llm import decontaminate as D


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = C.op8_quality_classifier(spark, sf).collect()
    assert len(out) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in out if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([a == b for a, b in held]) >= 0.93


def test_neighbours_against_brute_force():
    rng = np.random.default_rng(4)
    ids = [rng.integers(0, 20, n) for n in (0, 1, 5, 60_000)]
    index, total, want = C.index_vectors(), np.zeros((C.BUCKETS, C.DIMS), np.int64), np.zeros((C.BUCKETS, C.DIMS), np.int64)
    C._neighbours(ids, total, index)
    for d in ids:
        for k in (-2, -1, 1, 2):
            a, b = (d[:k], d[-k:]) if k < 0 else (d[k:], d[:-k])
            if len(d) > abs(k):
                np.add.at(want, a, index[b])
    assert (total == want).all()


def test_labels_that_may_not_teach_change_nothing(spark):
    docs = spark.createDataFrame([(k, f"word{k % 7} {'!!' if k % 2 else 'ok'} text {k % 3}") for k in range(60)], "doc_id long, text string")
    labels = [(k, 1 - k % 2) for k in range(60)]
    flipped = [(k, 1 - q if zlib.crc32(str(k).encode()) % 3 == 1 else q) for k, q in labels]
    score = lambda x: [r["score"] for r in C.classify(docs, spark.createDataFrame(x, "doc_id long, quality int")).orderBy("doc_id").collect()]
    assert score(labels) == score(flipped)


def test_classifier_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a", 1.0, "x"), (1, None, 2.0, "y"), (2, "", 3.0, "z"), (2, "", 3.0, "z"), (3, "w " * 150_000, 1.0, "")], "doc_id long, text string, score double, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = C.classify(docs, none).collect()
    assert len(out) == 5 and all(r["score"] == 0.5 and r["predicted"] == 1 for r in out)
    odd = spark.createDataFrame([(None, 1), (2, None), (3, 0), (3, 1), (77, 1)], "doc_id long, quality int")
    assert len(C.classify(docs, odd).collect()) == 5
    assert C.classify(docs.limit(0), odd).count() == 0


ITEM = "A train leaves London at 40 km and carries 12 boxes for Robert while Maria counts 12 of them twice"


def held(spark, texts, items=((1, ITEM),)):
    docs = spark.createDataFrame([(k, t, ["x"]) for k, t in enumerate(texts)], "doc_id long, text string, items array<string>")
    bench = spark.createDataFrame(list(items), "item_id long, text string")
    return [(r["items"], r["contaminated"], r["reparameterised"]) for r in D.decontaminate(docs, bench).orderBy("doc_id").collect()]


def test_leaks(spark):
    same = "Some text before. " + ITEM + " and after."
    other = same.replace("London", "Paris").replace("40", "75").replace("12", "9").replace("Robert", "Peter").replace("Maria", "Susan")
    torn = same.replace("London", "Paris").replace("40 km and carries 12 boxes for Robert while Maria counts 12", "40 km and carries 12 boxes for Robert while Robert counts 13")
    shout = same.upper()
    part = "Intro. " + ITEM[:50]
    got = held(spark, [same, other, torn, shout, part, None, "", "nothing here at all"])
    assert got[0] == ([1], True, False) and got[1] == ([1], True, True) and got[3][1]
    assert [g[1] for g in got[4:]] == [False] * 4
    assert held(spark, [torn.replace("Paris", "Robert").replace("40", "13").replace("12", "40")])[0][1] is False


def test_items_of_all_kinds(spark):
    items = [(1, ITEM), (1, ITEM), (2, None), (3, ""), (None, "x y z"), (4, "two words"), (5, "Is it"), (6, "costs 12 dollars")]
    got = held(spark, ["here are two words", ITEM, "x y z", "well is it so", "Two words.", "costs 99 dollars"], items)
    assert [g[0] for g in got] == [[], [1], [], [], [4], [6]] and got[5][2]
    assert held(spark, [ITEM], [])[0][1] is False and held(spark, []) == []


def brute(items, text):
    """[(item, share, changed)] by lists of tokens, without hashes, filters or joins."""
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    token = lambda w: D.canonical(w.encode())
    words, out = split(text), []
    doc = [token(w) for w in words]
    for item, item_text in items:
        for form in dict.fromkeys((tuple(split(item_text)), tuple(split(item_text.upper())))):
            own = [token(w) for w in form]
            n = min(5, len(own))
            if not own or n < 5 and len(doc) != n:
                continue
            window = lambda ts, k: tuple(t[0] for t in ts[k : k + n])  # noqa: E731, B023
            mine = {window(own, k) for k in range(len(own) - n + 1)}
            at = [k for k in range(len(doc) - n + 1) if window(doc, k) in mine]
            inside = {window(doc, k) for k in at}
            if len(inside) < 0.8 * len(mine):
                continue
            diagonals = {w: {k - i for k in at if window(doc, k) == w for i in range(len(own) - n + 1) if window(own, i) == w} for w in inside}
            votes = Counter(d for ds in diagonals.values() for d in ds)
            chosen = {}
            for w in dict.fromkeys(window(doc, k) for k in at):
                best = max(diagonals[w], key=lambda d: (votes[d], -d))
                for i in range(len(own) - n + 1):
                    if window(own, i) == w and i + best >= 0:
                        for p in range(i, i + n):
                            if p + best < len(doc):
                                chosen.setdefault(p, p + best)
            there, back, good, total, changed = {}, {}, 0, 0, False
            for p, q in sorted(chosen.items()):
                (kind, a), (other, b) = own[p], doc[q]
                if a is not None and kind == other:
                    total += 1
                    if there.setdefault((kind, a), b) == b and back.setdefault((kind, b), a) == a:
                        good, changed = good + 1, changed or a != b
            if good >= 0.8 * total:
                out.append((item, round(len(inside) / len(mine), 6), changed))
    return out


@pytest.mark.parametrize("most", [D.BLOCK_ITEMS, 0])
def test_whole_table_against_brute_force(spark, sf, rows, monkeypatch, most):
    """Looked up in a broadcast table, and joined on rare windows with nothing broadcast."""
    monkeypatch.setattr(D, "BLOCK_ITEMS", most)
    if not most:
        monkeypatch.setattr(common, "MOST_BROADCAST", 0)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    n = 0
    for r in D.op10_decontaminate(spark, sf).collect():
        want = brute(items, rows[r["doc_id"]])
        assert r["items"] == sorted({x[0] for x in want}), r["doc_id"]
        assert r["max_share"] == max((x[1] for x in want), default=0.0) and r["reparameterised"] == any(x[2] for x in want) and r["contaminated"] == bool(want)
        n += bool(want)
    assert n


@pytest.mark.parametrize("most", [D.BLOCK_ITEMS, 4])
def test_both_ways_on_odd_rows(spark, monkeypatch, most):
    """Many items, repeated rows, very long and null texts, ties of alignment, items with common windows, clashing names."""
    monkeypatch.setattr(D, "BLOCK_ITEMS", most)
    items = [(k, "what is the value of the sum of " + " ".join(f"w{k}x{i}" for i in range(7))) for k in range(30)] + [(40, "a b"), (41, "a b c d e a b c d e"), (42, None)]
    texts = [items[3][1], items[3][1], "x " * 150_000 + items[4][1], None, "", "a b", "a b c d e a b c d e a b c d e", items[5][1] + " and " + items[6][1]]
    docs = spark.createDataFrame([(k, t, True, "i") for k, t in enumerate(texts)], "doc_id long, text string, contaminated boolean, items string")
    out = D.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")).orderBy("doc_id").collect()
    assert [r["items"] for r in out] == [[3], [3], [4], [], [], [40], [41], [5, 6]]
    good = [x for x in items if x[1]]
    for r, t in zip(out, texts, strict=True):
        assert r["items"] == sorted({x[0] for x in brute(good, t)})


def test_pooling_and_network_against_brute_force():
    """A document is the mean of its tokens' vectors; the gradient step and the temperature are checked by plain loops."""
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(C.BUCKETS, C.DIMS)).astype(np.float32)
    tokens = C.Tokens()
    text = "Some WORDS, and 12 more; some words. " * 900
    ids = [i for w in text.split() for i in tokens[w]]
    want = np.zeros(C.DIMS)
    for i in ids:
        want += vectors[i]
    assert np.allclose(C.pooled(tokens, vectors, text), want / len(ids), atol=1e-5) and not C.pooled(tokens, vectors, None).any()
    x = rng.normal(size=(900, C.DIMS))
    y = ((x[:, 0] * x[:, 1] + x[:, 2] > 0) ^ (rng.random(900) < 0.15)).astype(float)
    net = C.Network().fit(x, y)
    for k in range(5):
        z = [(x[k, d] - net.mean[d]) / net.scale[d] for d in range(C.DIMS)]
        hidden = [np.tanh(sum(z[d] * net.w[d, h] for d in range(C.DIMS)) + net.b[h]) for h in range(C.HIDDEN)]
        logit = sum(hidden[h] * net.v[h] for h in range(C.HIDDEN)) + net.c
        assert np.isclose(net.score(x[k : k + 1])[0], 1 / (1 + np.exp(-logit / net.temperature)))
    held = np.arange(900) % 5 == 4
    loss = lambda t: -np.mean([np.log(p if b else 1 - p) for p, b in zip(1 / (1 + np.exp(-net.logit(x[held]) / t)), y[held], strict=True)])
    assert loss(net.temperature) <= min(loss(t) for t in (0.25, 0.5, 1, 2, 4, 8)) + 1e-3


def test_probabilities_are_calibrated(spark):
    """Over held-out rows the mean score is near the share of label 1, in each half of the scores."""
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("doc_id IS NOT NULL AND quality IS NOT NULL").collect()}
    out = [(r["score"], labels[r["doc_id"]]) for r in C.op8_quality_classifier(spark, sf).where("held_out").collect() if r["doc_id"] in labels]
    s, y = (np.array(x, float) for x in zip(*out, strict=True))
    assert len(s) > 1000 and np.mean((s >= 0.5) == y) > 0.96
    for half in (s < 0.5, s >= 0.5):
        assert abs(s[half].mean() - y[half].mean()) < 0.04


def test_held_out_of_a_null_id_is_null(spark):
    df = spark.createDataFrame([(None,), (1,)], "doc_id long").select((~C.teaching()).alias("h"))
    assert df.where("h IS NULL").count() == 1 and F is not None
