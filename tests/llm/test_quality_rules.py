import math
import re
from collections import Counter

import xxhash

from docloom.llm import quality_rules as Q


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base(text):
    w = words(text)
    n = len(w)
    win = [tuple(w[i : i + 8]) for i in range(n - 7)]
    twice = {x for x, c in Counter(win).items() if c > 1}
    covered = {k for i, x in enumerate(win) if x in twice for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def grams(text):
    h = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) % 1048576 for w in words(text)]
    return [b % Q.BUCKETS for b in h] + [(b * 31 + a * 8191) % Q.BUCKETS for a, b in zip(h, h[1:], strict=False)]


def brute(rows, trusted):
    raw, target = Counter(), Counter()
    for k, text in rows:
        g = grams(text)
        raw.update(g)
        if k in trusted:
            target.update(g)
    n, t = sum(raw.values()), sum(target.values())
    out = []
    for k, text in rows:
        b, g = base(text), grams(text)
        llr = sum(math.log((target[x] + 1) / (t + Q.BUCKETS)) - math.log((raw[x] + 1) / (n + Q.BUCKETS)) for x in g) / len(g) if g and t else 0.0
        failed = b[0] < 20 or 100 * b[4] > 30 * b[0]
        out.append((k, *b, failed, round(llr, 6), not failed and llr >= Q.THRESHOLD))
    return out


def shown(df):
    return [(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], round(r["llr"], 6), r["kept"]) for r in df.collect()]


def test_whole_table(spark, sf, rows):
    trusted = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1 AND toxic = 0").collect()}
    assert sorted(shown(Q.op1_quality_rules(spark, sf))) == sorted(brute(rows.items(), trusted))


def test_odd_rows(spark):
    texts = [None, "", " \n\t ", "a" * 9, "a b c d e f g h " * 5, "x y\n\nx y\n \nx y", "one\x0btwo\x0cthree\x1cfour\x85five", "é𝒳 #$%|<>&* ok", "w1 w2 " + "z " * 5000, "a b c d e f g h a b c d e f g h a"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, "again " * 30), (3, "again " * 30), (None, "no id")]
    df = spark.createDataFrame([(k, t, 1.0, "x") for k, t in rows], "doc_id long, text string, llr double, __w string")
    trusted = spark.createDataFrame([(7,), (7,), (None,), (99,)], "doc_id long")
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(shown(Q.judge(df, trusted)), key=key) == sorted(brute(rows, {7}), key=key)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert Q.judge(df, df.select("doc_id")).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert Q.judge(one, df.select("doc_id")).first()["llr"] == 0
