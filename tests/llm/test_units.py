"""Units made of pieces."""

import random

import numpy as np
import pytest

from graphweft.llm import tokenbin


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_pieces_equal_the_tokenizer(path):
    r = random.Random(6)
    letters = "abcdefgxyzABCXYZéñßÀÖØöøÿĀſ×÷ªµºƀǅ"
    marks = ["", ",", ".", "!!", "'", "'s", "'ll", "...", "\"),", "_", "-x", "<|endoftext|>", "1", " ", "\n"]
    units = ["".join(r.choices(letters, k=r.randrange(9))) + r.choice(marks) + r.choice(marks) for _ in range(6000)]
    texts = [" ".join(units[i : i + 50]) for i in range(0, len(units), 50)]
    own = tokenbin.UnitEncoder(path)
    plain = [e.ids for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == plain


def test_new_words_with_marks_are_encoded_once(path):
    own = tokenbin.UnitEncoder(path)
    own.encode(["x Zwölfeck Zwölfeck, Zwölfeck. Zwölfeck!"])
    assert set(own.known) == {"Zwölfeck", "Zwölfeck,", "Zwölfeck.", "Zwölfeck!"} and set(own.marks) == {"", ",", ".", "!"}
