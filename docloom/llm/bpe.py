"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A piece's bytes are the leaves. Leaf i holds (rank of the pair that starts at i, i), or nothing; an inner node the least
of its two children, so the root is the leftmost minimum pair rank. A merge joins two live neighbours and makes three
point updates, each logarithmic in the piece's length, so a piece of a million bytes costs n log n, not n squared.

Defined results: a null text counts as empty (no ids, empty decoded bytes); empty tables give empty results; repeated
rows are encoded alike; other columns pass through unless an output column has their name, which then replaces them.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from docloom.llm.common import release, slices, table

#: Unicode White_Space, which \s means to the library whose ids are matched; letters and numbers of Latin-1.
WHITE = r"\t-\r \x85\xa0  -     　"
LATIN_L = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
LATIN_N = "0-9²³¹¼-¾"
VOCABULARY = "byte_bpe_50k.tiktoken"
NONE = 1 << 62


class _Pieces(dict):
    """piece -> its ids in decimal, joined by one space; keeps short pieces only and forgets all when full."""

    def __init__(self, merge, most: int):
        super().__init__()
        self.merge, self.most = merge, most

    def __missing__(self, piece: str) -> str:
        ids = " ".join(map(str, self.merge(piece.encode())))
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[piece] = ids
        return ids


class BytePairTokenizer:
    """Encodes texts by ranks, each match of the pattern separately; no special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most_cached: int = 400_000):
        self.ranks, self.bytes_of = ranks, {i: b for b, i in ranks.items()}
        pattern = pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")
        self.split = regex.compile(pattern).findall
        latin = pattern.replace(r"[^" + WHITE + r"\p{L}\p{N}]", f"[^{WHITE}{LATIN_L}{LATIN_N}]").replace(r"\p{L}", f"[{LATIN_L}]").replace(r"\p{N}", f"[{LATIN_N}]")
        self.split_latin = re.compile(latin).findall if r"\p" not in latin else self.split
        self.cache = _Pieces(self.merge, most_cached)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, ranks = len(piece), self.ranks
        size = 1 << (n - 1).bit_length()
        tree = [NONE] * (2 * size)
        end = list(range(1, n + 1))  # of the live token that starts here
        before = list(range(-1, n - 1))  # start of the live token to the left
        for i in range(n - 1):
            rank = ranks.get(piece[i : i + 2])
            if rank is not None:
                tree[size + i] = rank << 32 | i
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b

        while (root := tree[1]) != NONE:
            i = root & 0xFFFFFFFF
            j = end[i]
            end[i] = stop = end[j]
            left = before[i]
            here = there = NONE
            if stop < n:
                before[stop] = i
                rank = ranks.get(piece[i : end[stop]])
                if rank is not None:
                    here = rank << 32 | i
            if left >= 0 and (rank := ranks.get(piece[left:stop])) is not None:
                there = rank << 32 | left
            for k, value in ((size + j, NONE), (size + i, here), (size + left, there)) if left >= 0 else ((size + j, NONE), (size + i, here)):
                tree[k] = value
                while k > 1:
                    other = tree[k ^ 1]
                    if other < value:
                        value = other
                    k >>= 1
                    if tree[k] == value:
                        break
                    tree[k] = value
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def pieces(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.split(text)
        return self.split_latin(text)

    def encode_joined(self, text: str) -> str:
        """Decimal ids joined by one space."""
        return " ".join(map(self.cache.__getitem__, self.pieces(text)))

    def encode(self, text: str) -> list[int]:
        return list(map(int, self.encode_joined(text).split()))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> BytePairTokenizer:
    """One for each Python worker."""
    with open(path, "rb") as f:
        return BytePairTokenizer({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


def default_vocabulary() -> tuple[str, str]:
    """The path on the machine that runs this, and the pattern; each executor looks up its own path."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


#: What encode_documents can add: its Spark and Arrow types.
OUTPUTS = {"n_tokens": (T.LongType(), pa.int64()), "ids": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())), "ids_sha256": (T.StringType(), pa.string()), "decoded_sha256": (T.StringType(), pa.string()), "round_trip": (T.BooleanType(), pa.bool_())}


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))


def encode_documents(docs: DataFrame, outputs: tuple[str, ...] = ("n_tokens", "ids"), text_col: str = "text", vocabulary: tuple[str, str] | None = None, keep_text: bool = False) -> DataFrame:
    """docs without text_col (unless keep_text) and with the outputs, any of OUTPUTS. The decoded bytes come from decode()."""
    rest = [c for c in docs.columns if c not in outputs and (keep_text or c != text_col)]
    text_at = text_col if text_col in rest else "__bpe_text"
    source = docs.select(*rest, *([] if text_col in rest else [docs[text_col].alias(text_at)]))
    schema = T.StructType([source.schema[c] for c in rest])
    for name in outputs:
        schema = schema.add(name, OUTPUTS[name][0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(*(vocabulary or default_vocabulary()))
        decoder = {str(i): b for i, b in tok.bytes_of.items()}.__getitem__
        for whole in batches:
            for batch in slices(whole, text_at, 1_000_000) if whole.num_rows else [whole]:
                got: dict[str, list] = {name: [] for name in outputs}
                for text in batch.column(text_at).to_pylist():
                    joined = tok.encode_joined(text or "")
                    ids = joined.split()
                    if "n_tokens" in got:
                        got["n_tokens"].append(len(ids))
                    if "ids" in got:  # as 4-byte numbers, never as Python's
                        got["ids"].append(np.fromiter(map(int, ids), np.int32, len(ids)))
                    if "ids_sha256" in got:
                        got["ids_sha256"].append(hashlib.sha256(joined.encode()).hexdigest())
                    if "decoded_sha256" in got or "round_trip" in got:
                        decoded = b"".join(map(decoder, ids))
                        if "decoded_sha256" in got:
                            got["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
                        if "round_trip" in got:
                            got["round_trip"].append(decoded == (text or "").encode())
                made = [_lists(got[n]) if n == "ids" else pa.array(got[n], OUTPUTS[n][1]) for n in outputs]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in rest] + made, names=[*rest, *outputs])
        release()

    return source.mapInArrow(run, schema)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, ("n_tokens", "ids_sha256", "decoded_sha256"))


#: Ids of a merge by rank can't be stated in SQL; the tests compare with another implementation and a round trip.
ORACLES: dict[str, str] = {}
QUERIES = {"op5_byte_bpe": op5_byte_bpe}


def pipeline_encode(docs: DataFrame) -> DataFrame:
    """The pipeline's last stage: ids of every document, with proof that they decode to its text."""
    return encode_documents(docs.select("doc_id", "lang", "source", "text"), ("n_tokens", "ids", "round_trip"))
