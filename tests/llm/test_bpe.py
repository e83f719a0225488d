import hashlib

import pyarrow as pa
import pytest
import tiktoken
from hauldeck.llm import bpe, queries
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpus_cases import LONG, made  # noqa: F401

RANKS = bpe.read_ranks(queries.vocabulary_path("byte_bpe_multi_50k.tiktoken"))
REFERENCE = tiktoken.Encoding("own", pat_str=queries.word_pattern(), mergeable_ranks=RANKS, special_tokens={})
ENCODER = bpe.Encoder(bpe.Merges(RANKS), queries.word_pattern())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("ab \n\t'sS.,é1٣  \x1c\x85😀"), st.characters(codec="utf-8"))), min_size=1, max_size=4))
def test_ids_equal_the_library(texts):
    assert ENCODER.block(pa.array(texts, pa.string())).to_pylist() == [REFERENCE.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("word", ["a" * 3000, "ab" * 500, "abababa" * 9, "\n" * 99, "aaab" * 200])
def test_long_words(word):
    assert ENCODER.block(pa.array([word]))[0].as_py() == REFERENCE.encode_ordinary(word)


def test_a_merge_that_opens_a_lower_rank():
    """ab (9) is made before c joins it, yet abc has rank 5: of 'abcab', abc must come before the second ab."""
    one = {bytes([b]): 100 + b for b in range(256)}
    ranks = one | {b"ab": 9, b"abc": 5, b"cab": 7}
    pieces = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    for word in (b"abcab", b"ababcabc", b"cabab", b"abcabcab"):
        expected = pieces.encode_ordinary(word.decode())
        assert bpe.replay([word], bpe.Merges(ranks))[0].tolist() == expected and bpe.replay_long(word, ranks).tolist() == expected


def test_round_trip_of_a_table(spark, made):
    rows = [(1, None), (2, ""), (3, "A b"), (3, "A b"), (None, "ü <|endoftext|>"), (4, LONG)]
    ids = bpe.encode(made(rows), RANKS, queries.word_pattern(), keep=["doc_id", "text"], back=True)
    got = ids.withColumn("back", bpe.decode(spark, RANKS)(F.col("ids"))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.ids == REFERENCE.encode_ordinary(r.text or "") and bytes(r.back) == (r.text or "").encode()
    assert bpe.encode(made([]), RANKS, queries.word_pattern()).count() == 0


def test_query(spark):
    for r in queries.op3_byte_bpe(spark, "/root/testdata/sf0.001").join(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text"), "doc_id").collect():
        ids = REFERENCE.encode_ordinary(r.text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())
