from pathlib import Path

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridloom.llm.bpe import PATTERN, Encoder, decode_column, encode_column, merge, read_ranks
from gridloom.llm.text_queries import TOKENIZERS

FILE = str(Path(TOKENIZERS) / "byte_bpe_50k.tiktoken")
RANKS = read_ranks(FILE)
OURS = Encoder(RANKS)
OTHER = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
THIRD = Tokenizer.from_file(str(Path(TOKENIZERS) / "byte_bpe_50k.json"))
THIRD.encode_special_tokens = True


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=80))
def test_like_two_other_encoders(text):
    ids = OURS.encode(text)
    assert ids == OTHER.encode_ordinary(text) == THIRD.encode(text, add_special_tokens=False).ids
    assert OURS.decode(ids) == text


def test_special_strings_are_text():
    text = "a<|endoftext|>b"
    assert OURS.encode(text) == OTHER.encode_ordinary(text)


def test_long_pieces():
    piece = b"ab" * 30_000
    ids = merge(piece, RANKS)
    assert ids == OTHER.encode_ordinary(piece.decode())
    assert OURS.encode(None) == OURS.encode("") == []


def test_columns(spark):
    rows = [(1, "Hello wörld", "x"), (2, None, "x"), (3, "", "x"), (4, " \n", "x"), (1, "Hello wörld", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = encode_column(df, "text", ["doc_id"], FILE)
    assert sorted((r.doc_id, r.ids) for r in got.collect()) == sorted((i, OTHER.encode_ordinary(t or "")) for i, t, _ in rows)
    assert sorted((r.doc_id, r.text) for r in decode_column(got, "ids", ["doc_id"], FILE).collect()) == sorted((i, t or "") for i, t, _ in rows)
    assert encode_column(df.limit(0), "text", ["doc_id"], FILE).count() == 0
    with pytest.raises(ValueError):
        encode_column(df, "text", ["ids"], FILE)
