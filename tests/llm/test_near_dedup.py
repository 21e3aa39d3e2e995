"""The pipeline's near-dedup against brute-force Jaccard similarity."""

import random

import pytest

from echosieve.llm import near_dedup

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def five_word_sets(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def made_texts():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(2000)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    texts = []
    for k in range(30):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(60, 200))] + passage * (k % 3 == 0)
        texts.append(base)
        for changed in (1, 2, 3, 4, 6, 9):  # both sides of 0.8
            copy = list(base)
            for i in rng.sample(range(len(base)), changed):
                copy[i] = rng.choice(vocabulary)
            texts.append(copy)
    texts += [passage + [rng.choice(vocabulary) for _ in range(n)] for n in range(2, 12)]  # mostly one passage
    return [" ".join(t) for t in texts] + [None, "", " \n", "a b", "A  b", "c", texts[0][0].upper()]


@pytest.mark.parametrize("common", [4, 1])
def test_groups_are_those_of_brute_force(spark, monkeypatch, common):
    pipeline = pytest.importorskip("corpus_pipeline")
    monkeypatch.setattr(near_dedup, "COMMON", common)
    texts = made_texts()
    sets = [five_word_sets(t) for t in texts]
    root = list(range(len(texts)))
    linked = 0
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                linked += 1
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA).repartition(5)
    found = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    assert linked > 60 and found == dict(enumerate(root))
    assert sorted(r.doc_id for r in pipeline.STAGES[2][1](spark, docs, "").collect()) == sorted(set(root))
