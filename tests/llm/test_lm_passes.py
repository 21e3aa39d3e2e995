"""Scores don't depend on how much of the filters is broadcast at once."""

import random

import pytest
from pyspark.sql import functions as F

from echosieve.llm import lm_score


@pytest.mark.parametrize("max_bits", [900_000, 1 << 18])
def test_filters_in_passes_give_the_same_scores(spark, max_bits):
    rng = random.Random(7)
    rows = [(i, " ".join(f"w{rng.randrange(9000)}" for _ in range(rng.randrange(0, 600)))) for i in range(500)] + [(None, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    learn = F.coalesce("doc_id", F.lit(0)) % 5 != 1
    of = lambda **k: sorted(((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm_score.score(docs, learn, **k).collect()), key=str)
    whole, parts = of(), of(max_bits=max_bits)
    assert len(whole) == len(parts) == len(rows)
    for a, b in zip(whole, parts, strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:])
