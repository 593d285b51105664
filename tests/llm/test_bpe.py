import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cellplan.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  ", "\n", "a", " a", "a ", "a  b", "a\n\nb", "a \nb", "a\n b", "x\t y", "it's we'll", "<|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "a\x1cb \x1d c", "a\x85b\xa0 c", "aaaaaaaaaaaaaaaaaaaaaa", "日本語 テキスト", "🙂🙂 é", "123 4567", "ab　 c", "Größe über", "''''", "\r\n\r\n x", " ".join("z" * 50)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids(library, texts):
    return [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def compare(library, texts):
    want = ids(library, texts)
    packed = bpe.made(bpe.encoder, PATH).values(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in packed] == want
    assert bpe.made(bpe.counter, PATH).values(texts) == [len(x) for x in want]
    vocab = bpe.made(bpe.Vocabulary, PATH)
    assert [bpe.decode(x, vocab) for x in packed] == [library.decode(x, skip_special_tokens=False) for x in want]


def test_odd_texts(library):
    compare(library, ODD)
    compare(library, [a + b for a in ODD for b in ODD])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\tathesrd'1.é"), st.characters(exclude_categories=["Cs", "Cn"]))), max_size=6))
def test_any_text(library, texts):
    compare(library, texts)


def test_long_and_random(library):
    r = random.Random(5)
    compare(library, ["".join(r.choice("aetiosr nhdl") for _ in range(4000)) for _ in range(20)] + ["a" * 30_000, "thn" * 9000])


def test_frames(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, None, None), (3, "a", "y"), (3, "a", "y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    out = bpe.bpe_encode(df, with_decoded=True).collect()
    assert len(out) == len(rows)
    assert sorted((x.doc_id if x.doc_id is not None else -1, x.decoded) for x in out) == sorted((d if d is not None else -1, t or "") for d, t, _ in rows)
    assert {x.doc_id: x.decoded for x in bpe.bpe_decode(bpe.bpe_encode(df)).collect()}[3] == "a"
    n = bpe.op6_token_counts(df).collect()
    assert sum(x.n_tokens for x in n) == sum(len(x) for x in ids(library, [t or "" for _, t, _ in rows]))
    assert {x.n_bytes for x in n if x.doc_id is None} == {0}
    assert bpe.op2_bpe_codec(df.limit(0)).count() == 0
