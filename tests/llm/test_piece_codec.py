import hashlib
import random

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from strandlake.llm import piece_codec
from tests.llm.help import AWKWARD, awkward

library = sentencepiece.SentencePieceProcessor(model_file=piece_codec.tokenizer_path())
codec = piece_codec.PieceCodec(piece_codec.load_vocabulary(piece_codec.tokenizer_path()))


def same(text):
    ids = library.encode(text)
    assert codec.encode(text).tolist() == ids
    back = library.decode(ids)
    assert codec.decode(ids) == back
    assert codec.digests(text) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aet hn ▁.,!\n\té"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text(text):
    same(text)


@pytest.mark.parametrize("text", ["", " ", "▁", "  a  b ", "\n\n", "a" * 70, "€𝄞\x00ß", " ́", *[" " * n + "x" for n in range(1, 40)], *[" " * n for n in range(1, 40)]])
def test_awkward_texts(text):
    same(text)


def test_long_words_and_full_tables(monkeypatch):
    monkeypatch.setattr(piece_codec, "KEPT_WORDS", 5)
    rng = random.Random(4)
    same(" ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 12))) for _ in range(300)))
    same("".join(rng.choices("abcdefghé", k=3000)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 31999), max_size=20))
def test_decoding_of_any_ids(ids):
    assert codec.decode(ids) == library.decode(ids)


def test_tables(spark):
    df = awkward(spark)
    got = sorted(map(tuple, piece_codec.token_digests(df).collect()), key=repr)
    expected = []
    for i, t, *_ in AWKWARD:
        ids = library.encode(t or "")
        expected.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(expected, key=repr)
    back = piece_codec.decoded(piece_codec.encoded(df)).select("text", "ids", "decoded").collect()
    assert all(r.decoded == (r.text or "") and r.ids == library.encode(r.text or "") for r in back)
    whole = piece_codec.tokenised(df)
    assert sorted(map(tuple, whole.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()), key=repr) == got
    assert piece_codec.token_digests(df.limit(0)).count() == 0
