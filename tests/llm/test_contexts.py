"""Every word has a restaurant for what follows it, wherever it is kept."""

import random
import zlib

import numpy as np
import pytest

from graphweft.llm import lmscore


@pytest.mark.parametrize("contexts", [0, 3])
def test_rare_contexts_tell_texts_apart(spark, contexts):
    r = random.Random(8)
    texts = [" ".join(x for k in r.choices(range(20), k=60) for x in (f"a{k}", f"b{k}")) for _ in range(80)]
    split = [" ".join(t.split(" ")[::2] + t.split(" ")[1::2]) for t in texts]
    rows = [*enumerate(texts), *((1000 + i, s) for i, s in enumerate(split))]
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    df = spark.createDataFrame([(i, t) for i, t in rows if i < 1000 or i in held], "doc_id long, text string")
    got = {x.doc_id: x.score / x.n_tokens for x in lmscore.scores(df, contexts=contexts).collect()}
    known = [v for i, v in got.items() if i < 1000 and i in held]
    mixed = [v for i, v in got.items() if i >= 1000]
    assert min(known) > max(mixed)


def test_scores_do_not_depend_on_the_layout(spark, monkeypatch):
    """Restaurants in one range or several, spread or whole: the same model, but for its draws."""
    r = random.Random(5)
    texts = [" ".join(x for k in r.choices(range(30), k=80) for x in (f"a{k}", f"b{k}", f"c{r.randrange(9)}")) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    whole = {x.doc_id: x for x in lmscore.scores(df).collect()}
    monkeypatch.setattr(lmscore, "RANGE_BYTES", 5000)
    spread = {x.doc_id: x for x in lmscore.scores(df, contexts=10).collect()}
    assert whole.keys() == spread.keys()
    for i, x in whole.items():
        assert (x.n_tokens, x.n_known, x.train_tokens) == (spread[i].n_tokens, spread[i].n_known, spread[i].train_tokens)
        assert abs(x.base_score - spread[i].base_score) < 1e-6 and abs(x.score / spread[i].score - 1) < 0.02


def test_probabilities_in_whole_restaurants_sum_to_one():
    rng = np.random.default_rng(2)
    p = rng.random(40)
    p /= p.sum()
    own = lmscore.Restaurants(np.repeat(np.arange(7), 40), np.tile(np.arange(40), 7), rng.integers(0, 4, 280) * rng.integers(0, 30, 280))
    tables = own.seated(p, 0.6, rng)
    assert ((tables > 0) == (own.m > 0)).all() and (tables <= own.m).all()
    assert np.allclose(np.bincount(own.context, weights=own.predictive(tables, p, 0.6)), 1)
