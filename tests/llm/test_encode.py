"""Problem 7: ids equal the public encoder's, for every kind of text."""

import random

import pytest
import tiktoken
from tiktoken.load import load_tiktoken_bpe

from chatloom.llm.bpe import SPLIT_PATTERN, TOKENIZERS, tokenizer
from chatloom.llm.encode import encode_documents


@pytest.fixture(scope="module")
def public():
    return tiktoken.Encoding("public", pat_str=SPLIT_PATTERN, mergeable_ranks=load_tiktoken_bpe(f"{TOKENIZERS}/byte_bpe_50k.tiktoken"), special_tokens={})


def texts():
    rng = random.Random(1)
    some = ["", "a", "Hello, world's  end\n\n\t ", "昨天在天台上的衣柜还在晾。", "👨‍👩‍👧 naïve Straße", "<|endoftext|> x", "x" * 3000, "\x00\x7f", "1234567890" * 20]
    return some + ["".join(rng.choice("abc ABC.,'\n\t01é昨👍​") for _ in range(rng.randrange(400))) for _ in range(60)]


def test_equals_the_public_encoder(public):
    packed = tokenizer("byte_bpe_50k", TOKENIZERS).packed
    for t in texts():
        assert list(memoryview(packed(t)).cast("i")) == public.encode_ordinary(t)


def test_documents(spark, public):
    rows = [(i, t) for i, t in enumerate([*texts()[:12], None])]
    got = {r.doc_id: r.ids for r in encode_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: public.encode_ordinary(t or "") for i, t in rows}
