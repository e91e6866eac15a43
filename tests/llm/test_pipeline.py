import subprocess
import sys
from pathlib import Path

import pytest

import corpus_pipeline as P
from docloom.llm import bpe, classifier, pii
from docloom.llm.common import keep

ROOT = Path(__file__).resolve().parents[2]


def test_stages(spark, sf, docs):
    assert [n for n, _ in P.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "PII", "byte-level BPE encoding and decoding"]
    cur, ids = docs, {r["doc_id"] for r in docs.collect()}
    for k, (_, stage) in enumerate(P.STAGES[:4]):
        out = keep(stage(spark, cur, sf), f"test{k}")
        assert out.columns == docs.columns
        now = {r["doc_id"] for r in out.collect()}
        assert now <= ids and (len(now) < len(ids) if k < 3 else now == ids)
        cur, ids = out, now
    tok = bpe.tokenizer(*bpe.default_vocabulary())
    last = P.STAGES[4][1](spark, cur, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in cur.collect()}
    assert {r["doc_id"] for r in last} == ids and all(r["round_trip"] and tok.decode(r["ids"]).decode() == texts[r["doc_id"]] for r in last)


def test_run_is_the_stages(spark, sf, docs):
    assert P.run(spark, sf).count() > 0


def test_stages_on_odd_rows(spark, tmp_path, docs):
    """Nulls, empty and very long texts, ties, repeated rows, clashing names and empty side tables, by what each stage says."""
    prose = [r["text"] for r in docs.where("length(text) > 400").orderBy("doc_id").limit(6).collect()]
    item = "What is the sum of 14 apples and 23 pears that Maria carries to London in 3 days"
    rows = [(1, prose[0]), (2, prose[0]), (1, prose[0]), (3, prose[1] + " " + item.replace("14", "77")), (4, None), (5, ""), (None, prose[2]), (None, None), (6, prose[3] * 40), (7, prose[4] + " mail jo.li@firma.de"), (8, "ok")]
    names = "doc_id long, text string, lang string, source string, n_chars long, score double, items string, class_id long, entity_types string, n_tokens long, bands int"
    data = spark.createDataFrame([(k, t, "en", "s", len(t or ""), 9.0, "i", -1, "e", -1, 0) for k, t in rows], names)
    data.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item), (1, item), (2, None), (None, "x")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    cur, want = spark.read.parquet(str(tmp_path / "documents.parquet")), [len(rows), len(rows) - 2, len(rows) - 3, len(rows) - 3]
    for (_, stage), n in zip(P.STAGES, want, strict=False):
        cur = keep(stage(spark, cur, str(tmp_path)), "odd")
        assert cur.columns == data.columns and cur.count() == n
    assert cur.where("score = 9.0 AND items = 'i' AND class_id = -1 AND entity_types = 'e'").count() == want[-1]
    texts = {r["doc_id"]: r["text"] for r in cur.where("doc_id IS NOT NULL").collect()}
    assert set(texts) == {1, 4, 5, 6, 7, 8} and texts[4] is None and texts[5] == "" and "jo.li@firma.de" not in texts[7] and texts[1] == prose[0] and texts[6] == prose[3] * 40
    last = P.run(spark, str(tmp_path)).collect()
    assert len(last) == want[-1] and all(r["round_trip"] for r in last)


def test_run_against_the_operators_brute_force(spark, sf, docs, rows):
    """The rows of run() from each operator's own brute force: scores aside, all decisions are made again by plain Python."""
    from tests.llm.test_classifier_and_decontaminate import brute as leaks
    from tests.llm.test_jaccard import brute as classes

    good = {r["doc_id"] for r in P.quality(spark, docs, sf).select("doc_id").collect()}
    kept = {k: t for k, t in rows.items() if k in good}
    kept = {k: kept[k] for (k, _), (c, _) in classes(kept.items()).items() if c == k}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = {k: t for k, t in kept.items() if not leaks(items, t)}
    out = {r["doc_id"]: r for r in P.run(spark, sf).collect()}
    assert set(out) == set(kept)
    tok = bpe.tokenizer(*bpe.default_vocabulary())
    changed = {r["doc_id"]: r["text"] for r in pii.replace(docs.where(docs["doc_id"].isin([*kept])).select("doc_id", "text"), pii.session_key(spark)).collect()}
    assert all(tok.decode(r["ids"]).decode() == changed[k] for k, r in out.items())


def test_stages_on_empty_tables(spark, sf, docs):
    none = docs.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, none, sf).count() == 0


@pytest.mark.parametrize("gone", ["corpus_pipeline", "docloom.llm"])
def test_entry_without_llm(gone):
    code = f"import sys; sys.modules['{gone}'] = None; import __spark_entry__ as e; q = e.queries(); assert 'search_topn' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q), list(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_all_operators_are_registered():
    import __spark_entry__ as e

    assert {f"op{k}" for k in range(1, 11)} | {"pipeline"} <= {k.split("_")[0] for k in e.queries()}
    assert set(e.oracle_sql()) <= set(e.queries())
    assert classifier and pii
