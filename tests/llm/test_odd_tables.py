"""Every operator function and the pipeline on tables with odd texts, ids and column names."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from echosieve.llm import ann, language_id, line_dedup, lm_score, mixing, near_dedup, packing, quality, simhash, substring_dedup, token_count

VOCABULARY = "word_bpe_49k.json"
CLASHES = ("takes", "es_id", "es_hash", "es_w", "es_places", "es_salt_key", "es_range", "row", "id", "hash", "chunk", "whole", "number", "length", "take", "key", "fp", "h", "a b", "x.y", "es_kept", "learn", "piece")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    line = "this line is long enough to count as one"
    plain = " ".join(f"word{i % 97} of{i % 89}" for i in range(60))
    texts = [(1, plain), (1, plain), (2, plain + " x"), (3, None), (3, ""), (4, " \n\t"), (None, plain), (None, plain), (None, None), (5, "a" * 2_000_000), (6, "long words " * 180_000), (7, f"{line}\n{plain}"), (8, f"{line}\n{plain} y\n{line}"), (9, f"{line}\nz")]
    df = spark.createDataFrame([(i, t, "en" if k % 3 else None, f"s{k % 2}" if k % 5 else None, 0) for k, (i, t) in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    bad = spark.range(1).select(F.lit(10).cast("long").alias("doc_id"), F.expr("cast(concat(X'ff41fe20', repeat('good words ', 60), X'c328') as string)").alias("text"), F.lit("en").alias("lang"), F.lit("s0").alias("source"), F.lit(0).cast("long").alias("n_chars"))
    df = df.unionByName(bad)
    for c in CLASHES:
        df = df.withColumn(c, F.lit(f"own {c}"))
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    df.coalesce(3).write.parquet(path)
    return spark.read.parquet(path)


IDS = Counter({1: 2, 2: 1, 3: 2, 4: 1, None: 3, 5: 1, 6: 1, 7: 1, 8: 1, 9: 1, 10: 1})
WHOLE = {
    "quality": (lambda d: quality.judge(d, keep_text=True), {"es_kept"}),
    "lines": (line_dedup.drop_common_lines, set()),
    "windows": (substring_dedup.drop_repeated_windows, set()),
    "tokens": (lambda d: token_count.count_pieces(d, VOCABULARY), set()),
    "languages": (lambda d: language_id.predict(d, language_id.learn(d)), set()),
}


@pytest.mark.parametrize("name", WHOLE)
def test_operators_keep_rows_and_columns(odd, name):
    run, replaced = WHOLE[name]
    out = run(odd)
    rows = out.collect()
    assert set(odd.columns) <= set(out.columns) and len(set(out.columns)) == len(out.columns)
    assert Counter(r.doc_id for r in rows) == IDS
    assert all(r[c] == f"own {c}" for r in rows for c in CLASHES if c not in replaced)


@pytest.mark.parametrize("run", [simhash.near_duplicates, near_dedup.near_duplicates, mixing.mix, lambda d: lm_score.score(d, F.col("doc_id") % 2 == 0)])
def test_operators_of_fixed_columns(odd, run):
    assert Counter(r.doc_id for r in run(odd).select("doc_id").collect()) == IDS


@pytest.mark.parametrize("one_of_each", [simhash.one_of_each, near_dedup.one_of_each])
def test_one_of_each(odd, one_of_each):
    rows = one_of_each(odd).collect()
    ids = Counter(r.doc_id for r in rows)
    assert ids[1] == 1 and ids[5] == 1 and ids[9] == 1 and all(r[c] == f"own {c}" for r in rows for c in CLASHES)


def test_mix_and_pieces(odd):
    mixed = mixing.mixed_documents(odd)
    rows = mixed.collect()
    assert mixed.columns == [*odd.columns, "es_position"] and rows and all(r[c] == f"own {c}" for r in rows for c in CLASHES)
    cut = packing.pieces(odd, VOCABULARY)
    assert Counter(r.doc_id for r in cut.collect() if r.piece == 0) == IDS
    more = cut
    for c in CLASHES:
        if c not in ("length", "piece"):
            more = more.withColumn(c, F.lit(c))
    packed = packing.pack(more)
    assert packed.columns == [*more.columns, "sequence_id", "offset"]
    used = Counter()
    for r in packed.collect():
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 4096


def test_pipeline(spark, odd):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = odd.inputFiles()[0].removeprefix("file:").rsplit("/", 2)[0]
    docs = odd
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == odd.columns, name
    assert {r.doc_id for r in pipeline.run(spark, sf).collect()} <= {*IDS}


def test_repeated_query_ids(spark):
    df = spark.createDataFrame([(50, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0])], "vec_id bigint, embedding array<float>")
    rows = ann.nearest(df, F.col("vec_id") % 50 == 0, k=2).collect()
    lists = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in rows)
    assert lists == sorted([(50, 1, 50, 1.0), (50, 2, 1, 0.995037)] * 2 + [(50, 1, 2, 0.995037), (50, 2, 1, 0.099504)])
