"""The dictionary of the token output is made by a task."""

import pytest

from graphweft.llm import tokenbin


def test_the_driver_makes_no_dictionary(spark, monkeypatch):
    import public_tokenizers

    docs = spark.createDataFrame([(i, f"some words of a text, number {i} " * 9) for i in range(300)], "doc_id long, text string")
    monkeypatch.setattr(tokenbin.UnitEncoder, "__init__", lambda *a, **k: pytest.fail("the driver loads the tokenizer"))
    assert len(tokenbin.train_dictionary(docs, public_tokenizers.path("byte_bpe_50k.json"), size=4096)) > 0
