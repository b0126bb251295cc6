import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import bpe

if not os.path.exists(bpe.VOCABULARY):
    pytest.skip("no vocabulary here", allow_module_level=True)
tiktoken = pytest.importorskip("tiktoken")
ENCODER = bpe.Encoder(bpe.read_vocabulary())
# fixed values: the pattern of the public vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
OTHER = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ENCODER.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs", "Cn", "Co"]), max_size=60))
def test_same_as_library(text):
    assert list(ENCODER.encode(text)) == OTHER.encode_ordinary(text)


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=300))
def test_heap_and_array_agree(word):
    assert bpe.merge_short(word, ENCODER.ranks) == bpe.merge_long(word, ENCODER.ranks)


def test_rows(spark):
    df = spark.createDataFrame([(1, "Hello <|endoftext|> world's"), (2, None), (3, ""), (4, "ab" * 50_000), (None, "x")], "doc_id long, text string").selectExpr("*", "1 AS ids")
    got = {r.doc_id: list(r.ids) for r in bpe.encode(df).collect()}
    assert got[1] == OTHER.encode_ordinary("Hello <|endoftext|> world's") and got[2] == got[3] == [] and got[4] == OTHER.encode_ordinary("ab" * 50_000) and None in got
    assert bpe.encode(df.limit(0)).count() == 0
