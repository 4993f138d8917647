"""The encoder's memory of words, of which only those not met again are forgotten."""

import random

import public_tokenizers

from colloquy.llm import packing


def test_words_met_again_are_not_learnt_again(monkeypatch):
    encode = packing.Encoder(packing.definition(public_tokenizers.path("byte_bpe_50k.json")), memo=100)
    learnt, learn = [], encode.learn
    monkeypatch.setattr(encode, "learn", lambda parts: learnt.extend(parts) or learn(parts))
    common = [f"often{i}" for i in range(20)]
    for k in range(20):
        text = " ".join(["x", *common, *[f"rare{k}q{i}" for i in range(10)]])
        assert encode([text]) == [encode.whole(text)]
    assert all(learnt.count(w) == 1 for w in common)
    assert len(encode.memo) + len(encode.older) <= 100


def test_odd_texts_are_encoded_as_whole():
    rng = random.Random(3)
    signs = ["a", "B", "é", " ", "\n", "word", "\t", "<|endoftext|>", "1", "漢", "  ", "\x7f", "Ā"]
    odd = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 8))) for _ in range(1000)]
    encode = packing.Encoder(packing.definition(public_tokenizers.path("byte_bpe_50k.json")), memo=200)
    assert encode(odd) == [encode.whole(t) for t in odd]


def test_new_words_of_letters_are_merged_without_the_tokenizer(monkeypatch):
    """Any spelling, in any mix with signs, gets the tokenizer's own ids."""
    encode = packing.Encoder(packing.definition(public_tokenizers.path("byte_bpe_50k.json")))
    rng = random.Random(7)
    bits = ["th", "e", "ing", "an", "A", "É", "ça", "ø", "aaaa", "zq", ",", ".", "...", "-", '"', "(", ")!", "tion", "ɏ", "ss", "?"]
    words = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 9))) for _ in range(4000)]
    texts = ["".join(w + rng.choice(" \n") for w in words[i : i + 50]) + "end" for i in range(0, len(words), 50)]
    whole = [encode.whole(t) for t in texts]

    def no_tokenizer(*_, **__):
        raise AssertionError("the tokenizer was asked")

    monkeypatch.setattr(encode, "tokenizer", type("No", (), {"encode_batch_fast": no_tokenizer, "encode": no_tokenizer})())
    assert encode(texts) == whole
