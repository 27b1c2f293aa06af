"""Cases of the two encoders that whole tables seldom hold."""

import pytest
from test_text_operators import MULTI, STRANGE, reference_encoder

from lectern.llm import byte_bpe, packing
from lectern.llm.queries import tokenizer_path

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("cache", [0, 3, 40])
def test_op4_splits_with_more_matches_than_the_cache(monkeypatch, cache):
    monkeypatch.setattr(byte_bpe, "CACHE", cache)
    monkeypatch.setattr(byte_bpe, "STEP", 2_000)
    bpe, theirs = byte_bpe.ByteBPE.from_file(tokenizer_path(MULTI), public_tokenizers.PATTERN), reference_encoder()
    texts = STRANGE + [" ".join(f"w{k} {k * 7}" for k in range(500)), None] + STRANGE
    for text, ids in zip(texts, bpe.encode_batch(texts), strict=True):
        assert ids.tolist() == theirs.encode_ordinary(text or "")


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|endoftext|><|endoftext|>\n\n x <|endoftext", "x" + " " * 1_000_000 + "y <|endoftext|>", "\n" * 1_000_000, " " * 99_999 + "z"])
def test_op8_ids_are_those_of_the_contract(text):
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    assert packing.encoder(tokenizer_path("byte_bpe_50k.json"))(text) == theirs.encode(text, add_special_tokens=False).ids


def test_op8_long_blank_runs_without_added_tokens():
    text = "a" + "\n" * 1_000_000 + "b"
    assert packing.encoder(tokenizer_path(MULTI))(text) == byte_bpe.load(tokenizer_path(MULTI), public_tokenizers.PATTERN).encode_batch([text])[0].tolist()
