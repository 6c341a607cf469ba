"""Words, pretokens and fragments of the BPE encoder as columns, against the library."""

import random
import sys

import pyarrow as pa
import pytest


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    from tidewake.llm.bpe import WordEncoder

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return WordEncoder(path), tokenizer


def test_new_words_cost_no_call_each(library):
    """Ten thousand new words of 202 pretokens: work in Python follows the pretokens, not the words."""
    from tidewake.llm.bpe import EncodedWords

    encoder, tokenizer = library
    parts = [a + b for a in "abcdefghij" for b in "klmnopqrst"]
    text = " ".join(f"{a}-{b}" for a in parts for b in parts)
    cache, calls = EncodedWords(encoder), 0

    def count(frame, event, value):
        nonlocal calls
        calls += event in ("call", "c_call")

    before = sys.getprofile()
    sys.setprofile(count)
    try:
        ids, ends = cache.ids(pa.array([text.encode()], pa.large_binary()))
    finally:
        sys.setprofile(before)
    assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids and ends.tolist() == [0, len(ids)]
    assert calls < 5000


@pytest.mark.parametrize("size, step", [(300_000, 4000), (50, 170)])
def test_pieces_of_all_kinds(library, size, step):
    from tidewake.llm.bpe import EncodedWords

    encoder, tokenizer = library
    pieces = [
        "'", "'s", "'re", "'ll", "'v", "e", "''", "don", "T", "1", "½", "²", "-", "é", "É", "Ⱥ", "İ", "ß", "́", "<|endoftext|>", "<|startoftext|>",
        "<|end", "日本", "ſ", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", "\xad", "x", "ΣΑΣ", "ﬁ", "\U0001F642", "\x00", "\x7f", "_", "ll", "'VE",
        "ǅ", "ª", "µ"]
    rng = random.Random(7)
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(14))) for _ in range(4000)]
    cache = EncodedWords(encoder)
    cache.words.size = cache.parts.size = size
    for at in range(0, len(texts), step):
        some = texts[at : at + step]
        for text, (ids,) in zip(some, cache.of([t.encode() for t in some])):
            assert ids == tokenizer.encode(text, add_special_tokens=False).ids, text
    assert cache.of([]) == [] and cache.of([b"", b" \n"]) == [[[]], [[]]]


def test_caches_are_bounded_in_keys_and_bytes(library, monkeypatch):
    from tidewake.llm import bpe

    encoder, tokenizer = library
    monkeypatch.setattr(bpe, "CACHE_BYTES", 100_000)
    cache = bpe.EncodedWords(encoder)
    cache.words.size = cache.parts.size = 1000
    for i in range(12):
        text = " ".join([f"common w{i}" + "xyz" * 5000, *(f"v{i}v{j}" for j in range(300))])
        assert cache.of([text.encode()]) == [[tokenizer.encode(text, add_special_tokens=False).ids]]
        for known in (cache.words, cache.parts):
            assert len(known.keys) <= 1000 and known.keys.nbytes + known.ids.nbytes <= 100_000
            assert len(known.keys) == len(known.starts) == len(known.sizes) == len(known.used)
    assert b"common" in cache.words.keys.to_pylist()
