import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codexlake.llm import tokenize

tiktoken = pytest.importorskip("tiktoken")
PATH = f"{tokenize.TOKENIZER_DIR}/{tokenize.BYTE_BPE_50K}"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files")
# Fixed value: the public pattern that splits text before the vocabulary's merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=tokenize.load_ranks(PATH), special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from("ab'sT \n\t\r\x1c 　é²Ⅷ五_-’🙂​́12"), st.characters(blacklist_categories=("Cs", "Cn"))), max_size=40))
def test_equals_public_library(text):
    own = test_equals_public_library.__dict__
    if "r" not in own:
        own["r"] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=tokenize.load_ranks(PATH), special_tokens={})
    assert tokenize.encoder(PATH).encode(text) == own["r"].encode_ordinary(text)


def test_long_pieces_take_the_heap(reference):
    for text in ("x" * 5000, "abc" * 900, "é" * 700, "<|endoftext|>", " " * 900 + "a", "na" * 400):
        assert tokenize.encoder(PATH).encode(text) == reference.encode_ordinary(text)
    ranks = tokenize.load_ranks(PATH)
    piece = ("banana" * 40).encode()
    assert tokenize.merge_scan(piece, ranks) == tokenize.merge_heap(piece, ranks)


def test_rows_nulls_repeats_and_extra_columns(spark, reference):
    rows = [(1, None, "a"), (2, "", "a"), (3, "Two  spaces \n here", "a"), (3, "Two  spaces \n here", "a"), (None, "x y", "b"), (5, "word " * 30000, "b")]
    df = spark.createDataFrame([(*r, "i", 0) for r in rows], "doc_id bigint, text string, source string, ids string, n_tokens int")
    got = sorted(((r.doc_id or 0, list(r.ids)) for r in tokenize.encode_texts(df).collect()))
    assert got == sorted((i or 0, reference.encode_ordinary(t or "")) for i, t, _ in rows)
    counts = tokenize.encode_texts(df, counts_only=True, keep=("source",))
    assert counts.columns == ["doc_id", "source", "n_tokens"]
    assert sorted(r.n_tokens for r in counts.collect()) == sorted(len(x) for _, x in got)
    assert tokenize.encode_texts(df.limit(0)).collect() == []
