import hashlib

import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import bpe

TOK = bpe.tokenizer(*bpe.default_vocabulary())
REF = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=TOK.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_same_ids_and_round_trip(text):
    ids = TOK.encode(text)
    assert ids == REF.encode_ordinary(text)
    assert TOK.decode(ids) == text.encode()


def test_odd_texts():
    for text in ("", " ", "a\x1cb\x85c", "\n\n  x", "ab" * 4000, " " * 9000, "é" * 3000, "x²½ Ⅷ ٣", "don't we'll", "\ud7ff\U0010ffff"):
        assert TOK.encode(text) == REF.encode_ordinary(text)
        assert TOK.decode(TOK.encode(text)) == text.encode()


def test_query(spark, sf, rows):
    got = {r["doc_id"]: r for r in bpe.op5_byte_bpe(spark, sf).collect()}
    assert got.keys() == rows.keys()
    for k, text in rows.items():
        ids = REF.encode_ordinary(text)
        assert got[k]["n_tokens"] == len(ids)
        assert got[k]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_nulls_empty_and_clashing_names(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 6), (None, "abc", 7), (3, "abc", 8), (3, "abc", 8)], "doc_id long, text string, ids int")
    out = bpe.encode_documents(df, ("n_tokens", "ids", "round_trip")).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, len(r["ids"]), r["round_trip"]) for r in out) == [(False, 1, 0, True), (False, 2, 0, True), (False, 3, 1, True), (False, 3, 1, True), (True, 0, 1, True)]
    assert bpe.encode_documents(df.limit(0)).count() == 0
