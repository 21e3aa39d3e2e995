"""Each corpus operator against a brute-force version, on small tables with every kind of odd row."""

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import xxhash
from pyspark.sql import functions as F

from echosieve.llm import ann, language_id, line_dedup, lm_score, mixing, packing, quality, simhash, substring_dedup, token_count
from echosieve.llm import queries as Q
from echosieve.llm.common import id_remainder

SF = Path("/root/testdata/sf0.001")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def made_docs():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdeéüñ") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", ".", ",\n", "\n"]) for _ in range(n))
    shared, line = text(60), "This Line is found in Many documents, everywhere."
    docs = [text(rng.randrange(1, 200)) for _ in range(40)]
    for i in range(0, 40, 3):
        docs[i] += f"\n{line.upper() if i % 2 else line}  \n" + docs[i][:20]
    for i in range(0, 40, 4):
        docs[i] += " " + shared
    docs += [docs[5], docs[5], docs[6] + " x", None, "", " \t\n", "a", "É É", "x" * 3000, text(9000), "\n\n", "I" * 30, "!!! ??? 123", "\x0b\x1c\xa0 İstanbul ǅ ﬁ 中文 \U0001f600" * 3]
    docs += [text(60) + " # * $ |||" * 40, (text(4) + " ") * 40]
    langs, sources = ["en", "de", None, "fr"], ["s1", "s2", "é", None, "s1", "s1"]
    return [(i, t, langs[i % 4], sources[i % 6], None if t is None else len(t)) for i, t in enumerate(docs)]


DOCS = made_docs()


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(DOCS, SCHEMA).repartition(5).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def sf(docs, tmp_path_factory):
    return str(Path(docs.inputFiles()[0].removeprefix("file:")).parent.parent)


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("nothing")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return str(d)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Repeated rows, repeated and null ids, and columns named like the operators' own."""
    d = tmp_path_factory.mktemp("odd")
    rows = [*DOCS[:12], DOCS[3], DOCS[3], (3, "another text " * 30, "en", "s1", 5), (None, DOCS[4][1], None, None, None), (None, DOCS[4][1], None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("n_lines", "n_words", "kept", "size", "target", "score", "lang_pred", "fp", "component_id", "piece", "n_pieces", "h", "key", "range"):
        df = df.withColumn(c, F.lit(c))
    df.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [1.0, 1.0], 0), (2, None, 0), (50, [1.0, 0.5], 0), (50, [0.0, 1.0], 1)], "vec_id bigint, embedding array<float>, label int").withColumn("score", F.lit("x")).write.parquet(f"{d}/embeddings.parquet")
    return str(d)


NAMES = [n for n in Q.QUERIES]


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, nothing, name):
    assert Q.QUERIES[name](spark, nothing).collect() == []


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, odd, name):
    rows = Q.QUERIES[name](spark, odd).collect()
    if "vectors" in name:
        assert {r.query_id for r in rows} == {50}
    elif "packing" in name:
        assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter([*range(12), 3, 3, 3, None, None, None])
    else:
        assert Counter(r.doc_id for r in rows) == Counter([*range(12), 3, 3, 3, None, None, None])


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got, want = Q.QUERIES[name](spark, str(SF)), con.sql(Q.ORACLE_SQL[name])
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    show = lambda rows: sorted(tuple("~" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert show(got.select(*cols).collect()) == show(want.select(*cols).fetchall())


# --- nearest vectors ------------------------------------------------------------


def test_nearest_recall_and_order(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 16)).astype(np.float32)
    x[100:130] = x[99]
    bad = [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [float("inf")] * 16), (9005, [1.0]), (9006, []), (9007, [None] * 16), (None, [1.0] * 16)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + bad, "vec_id bigint, embedding array<float>")
    rows = ann.nearest(df, F.col("vec_id") % 50 == 0, shard_rows=700, least=64).collect()
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    y = x.astype(np.float64)
    norm = np.sqrt((y * y).sum(1))
    hit = 0
    for q in range(0, 3000, 50):
        score = y @ y[q] / norm / norm[q]
        best = sorted((-s, i) for i, s in enumerate(score) if i != q)[:5]
        assert len(got[q]) == 5 and [round(s, 12) for _, s in got[q]] == sorted((round(s, 12) for _, s in got[q]), reverse=True)
        assert all(abs(score[i] - s) < 1e-12 for i, s in got[q])
        hit += len({i for _, i in best} & {i for i, _ in got[q]})
    assert hit / 300 >= 0.9
    assert [i for i, _ in got[100]] == [99, 101, 102, 103, 104]


def test_forest_takes_longest_prefixes_first():
    x = np.random.default_rng(1).standard_normal((200, 8))
    forest = ann.Forest(x, 4, 32, 5)
    keys = ann.hash_strings(x, 4, 32, 5)
    for i, got in enumerate(forest.candidates(x[:5], 20)):
        prefix = [max(32 - int(int(keys[j, t]) ^ int(keys[i, t])).bit_length() for t in range(4)) for j in range(200)]
        depth = max(d for d in range(33) if sum(p >= d for p in prefix) >= 20)
        # all rows of longer prefixes, and as many of the last level as are needed
        assert {j for j in range(200) if prefix[j] > depth} <= set(got) <= {j for j in range(200) if prefix[j] >= depth} and len(got) == 20


def test_search_is_exact_over_all_candidates(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.standard_normal((300, 6)), 1)
    df = spark.createDataFrame([(i // 2, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    rows = ann.nearest(df, F.col("vec_id") % 50 == 0, share=1.0, shard_rows=90).collect()
    got = Counter((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in rows)
    norm = np.sqrt((x * x).sum(1))
    want = Counter()
    for i in range(300):
        if i // 2 % 50 == 0:
            score = x @ x[i] / (norm * norm[i])
            others = sorted((-s, j // 2) for j, s in enumerate(score) if j != i)[:5]
            want.update((i // 2, r + 1, v, round(-s, 9)) for r, (s, v) in enumerate(others))
    assert got == want


# --- language ---------------------------------------------------------------------


def test_language_profiles(spark):
    rng = random.Random(2)
    alphabets = {"xx": "abcdefgh", "yy": "mnopqrst", "zz": "aeiouлдж"}
    text = lambda a: " ".join("".join(rng.choice(a) for _ in range(5)) for _ in range(40))
    rows = [(text(a), n) for n, a in alphabets.items() for _ in range(30)]
    learned = language_id.learn(spark.createDataFrame(rows + [(None, "xx"), ("abc", None)], "text string, lang string"))
    assert list(learned) == ["xx", "yy", "zz"]
    held = [(text(a), n) for n, a in alphabets.items() for _ in range(20)] + [(None, "und"), ("", "und"), ("123 !?", "und")]
    got = language_id.predict(spark.createDataFrame(held, "text string, want string"), learned).collect()
    assert all(r.lang_pred == r.want and 0 <= r.score <= 1 for r in got) and all((r.score == 0) == (r.want == "und") for r in got)
    assert language_id.predict(spark.createDataFrame(held, "text string, want string"), {}).first().lang_pred == "und"


def test_language_score_is_the_cosine_of_bundles(spark):
    texts = [("Ab", "xx"), ("a  b cé", "yy"), ("жд ж", "yy"), ("éa!", "xx"), ("中a文", None)]

    def bundle(text, dim=64):
        out = np.zeros(dim)
        symbols = [0, *(ord(c) if c.isalpha() else 0 for c in text.lower()), 0]
        symbols = [c for k, c in enumerate(symbols) if k == 0 or c or symbols[k - 1]]
        for grams in zip(symbols, symbols[1:], symbols[2:]):
            v = [language_id.letter_vector(c, dim, 7).astype(int) for c in grams]
            out += np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]
        return out

    df = spark.createDataFrame(texts, "text string, lang string")
    learned = language_id.learn(df, dim=64)
    for lang in ("xx", "yy"):
        assert (learned[lang] == sum(bundle(t) for t, x in texts if x == lang)).all()
    for r in language_id.predict(df, learned, dim=64).collect():
        own = bundle(r.text)
        cosine = {x: own @ p / np.linalg.norm(own) / np.linalg.norm(p) for x, p in learned.items()}
        assert r.score == pytest.approx(max(0.0, *cosine.values()), abs=1e-5) and (r.lang_pred == max(cosine, key=cosine.get) or abs(cosine["xx"] - cosine["yy"]) < 1e-5)


def test_languages_of_one_script_that_share_no_letter_classes(spark):
    """Two languages whose letters are other ones of the same script, equal modulo small numbers."""
    rng = random.Random(9)
    alphabets = {"aa": "абвгдежз", "bb": "екопуфхц", "cc": "عغفقكلمن"}
    text = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(30))
    learned = language_id.learn(spark.createDataFrame([(text(a), n) for n, a in alphabets.items() for _ in range(10)], "text string, lang string"))
    held = [(text(a), n) for n, a in alphabets.items() for _ in range(20)]
    assert all(r.lang_pred == r.want for r in language_id.predict(spark.createDataFrame(held, "text string, want string"), learned).collect())


# --- language model ------------------------------------------------------------------


def test_lm_base_and_model(spark, docs, monkeypatch):
    monkeypatch.setattr(lm_score, "HEAVY_SHARE", 300)  # some words come by broadcast, others by the join
    rows = {r.doc_id: r for r in lm_score.score(docs, id_remainder("doc_id", 5) != 1).collect()}
    tokens = {i: [*map(lower, words(t)), None] for i, t, *_ in DOCS}
    counts = Counter(w for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in t)
    n, v = sum(counts.values()), len(counts)
    assert len(rows) == len(DOCS)
    for i, t in tokens.items():
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(counts[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
        assert r.score < 0
    assert sum(r.score for r in rows.values()) > sum(r.base_score for r in rows.values())


def test_lm_score_against_brute_force(docs):
    rows = {r.doc_id: r for r in lm_score.score(docs, id_remainder("doc_id", 5) != 1, bits_per_token=200, max_bits=1 << 18).collect()}
    tokens = {i: [*map(lower, words(t)), None] for i, t, *_ in DOCS}
    train = [t for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    counts, both = Counter(w for t in train for w in t), Counter((u, w) for t in train for u, w in zip([None, *t], t))
    n, v = sum(counts.values()), len(counts)
    level = lambda c: c.bit_length()
    mean = lambda c: 1.5 * 2 ** (level(c) - 1) - 0.5 if c else 0.0
    uses, types = Counter(), Counter()
    for (u, _), c in both.items():
        uses[level(counts[u])] += c
        types[level(counts[u])] += 1
    for i, t in tokens.items():
        want = 0.0
        for u, w in zip([None, *t], t):
            k = level(counts[u])
            m = uses[k] / (uses[k] + types[k]) if k else 0.0
            single = (mean(counts[w]) + 0.5) / (n + 0.5 * (v + 1))
            want += math.log10(min(1.0, m * min(1.0, mean(both[u, w]) / max(1.0, mean(counts[u]))) + (1 - m) * single))
        assert rows[i].score == pytest.approx(want)


def test_filter_never_underestimates():
    rng = np.random.default_rng(0)
    h = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64))
    counts = rng.integers(1, 300, len(h))
    f = lm_score.Filter(4, 3000)
    segment, key = f.place(h, 4)
    for k in range(4):
        f.put(k, key[segment == k], lm_score.levels(counts)[segment == k])
    assert (f.level(h) >= lm_score.levels(counts)).all()
    assert (f.level(h) == lm_score.levels(counts)).mean() > 0.8
    assert (f.level(rng.integers(0, 2**63, 5000).astype(np.uint64)) == 0).mean() > 0.8
    key = np.sort(key)
    big = counts * np.where(counts > 290, 10**6, 1)
    for x, y in zip((key, big, counts % 60), lm_score._unpacked(**lm_score._packed(key, big, counts % 60)), strict=True):
        assert (x == y).all()
    assert lm_score.levels(np.array([1, 2, 3, 4, 255, 256])).tolist() == [1, 2, 2, 3, 8, 9]


# --- lines ---------------------------------------------------------------------------------


def line_key(line):
    return lower(line.strip(" \t\n\x0b\f\r"))


def expected_lines(rows, chars=20, least=3):
    found = defaultdict(set)
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            found[line_key(x)].add(i)
    gone = lambda i, x: len(line_key(x)) >= chars and len(found[line_key(x)]) >= least and i != max(found[line_key(x)])
    return {i: [x for x in (t or "").split("\n") if not gone(i, x)] for i, t, *_ in rows}


@pytest.mark.parametrize(("batches", "fanout"), [(1, 3), (5, 2)])
def test_lines(docs, batches, fanout):
    want = expected_lines(DOCS)
    for r in line_dedup.drop_common_lines(docs, batches=batches, fanout=fanout).collect():
        text = DOCS[r.doc_id][1] or ""
        assert r.text == "\n".join(want[r.doc_id])
        assert (r.es_n_lines, r.es_n_dropped) == (len(text.split("\n")), len(text.split("\n")) - len(want[r.doc_id]))


def test_line_runs_tell_fresh_lines(spark):
    batch = lambda keys, i: spark.createDataFrame([(k, k, 1, i) for k in keys], "h1 bigint, h2 bigint, docs bigint, last bigint")
    batches = [{1, 2, 3}, {3, 4}, {1, 4, 5}, {6}, {2, 6, 7}]
    first = {k: 9 - i for i, keys in reversed([*enumerate(batches)]) for k in keys}
    with line_dedup.LineRuns(spark, fanout=2) as store:
        seen = set()
        for i, keys in enumerate(batches):
            told = {r.h1: r for r in store.told(batch(keys, 9 - i)).collect()}
            assert {k for k, r in told.items() if r.fresh} == keys - seen
            assert {k: r.last for k, r in told.items()} == {k: 9 - i if k not in seen else None for k in keys}
            store.add(batch(keys, 9 - i))
            seen |= keys
            rows = [r for depth in store.held() for r in store.level(depth).collect()]
            assert Counter(r.h1 for r in rows if r.fresh) == Counter(seen)
        assert store.runs() <= 3
        plan = store.compacted(store.held()[0])._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Bucketed: true" in plan
        plan = store.told(batch({1}, 0).groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("last").alias("last")))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1
        merged = {r.h1: r for r in store.merged().collect()}
        assert {k: r.last for k, r in merged.items()} == first
        assert merged[1].docs == 2 and merged[6].docs == 2 and merged[7].docs == 1
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("echosieve")]


# --- quality --------------------------------------------------------------------------------------


def test_counts(docs):
    for r in quality.text_counts(docs.select("doc_id", "text")).collect():
        text = DOCS[r.doc_id][1] or ""
        w = words(text)
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if words(x)]
        assert (r.es_n_words, r.es_word_chars, r.es_n_symbols) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text))
        assert (r.es_n_dup_lines, r.es_n_repeat_words) == (len(lines) - len(set(lines)), len(covered))


def test_sketch_buckets(spark):
    values = [*range(200), 1023, 1024, 1025, 99999, 10**9, 2**40 + 12345]
    df = spark.createDataFrame([(v,) for v in values], "v bigint").select("v", quality.bucket(F.col("v")).alias("b"), quality.bucket_low(quality.bucket(F.col("v"))).alias("low"))
    rows = df.orderBy("v").collect()
    assert all(r.low <= r.v < r.low * 33 / 32 + 1 for r in rows)
    assert [r.b for r in rows] == sorted(r.b for r in rows)


def test_outliers_go_and_clean_documents_stay(spark):
    rng = random.Random(1)
    text = lambda: " ".join(rng.choice("abcdefghij") * rng.randrange(2, 9) + str(rng.randrange(999)) for _ in range(80))
    rows = [(i, text(), "en", "s") for i in range(150)] + [(900, text() + " ###### $$$$ " * 10, "en", "s"), (901, "w" * 90 + " " + " ".join("w" * 60 + str(i) for i in range(80)), "en", "s"), (902, "few words", "en", "s")]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"), keep_text=True).collect()}
    assert all(got[i].es_kept for i in range(150))
    assert not any(got[i].es_kept for i in (900, 901, 902)) and got[902].es_base_failed
    assert got[5].text == rows[5][1]


# --- tokens -----------------------------------------------------------------------------------------


def test_automaton():
    rng = random.Random(4)
    for _ in range(30):
        pieces = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 5))) + b" " * (rng.random() < 0.3) for _ in range(12)}
        pieces |= {b"a", b"b", b" "}
        automaton = token_count.Automaton(pieces)
        for _ in range(50):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 12)))
            at, n, text = 0, 0, word + b" "
            while at < len(text):
                size = next((k for k in range(len(text) - at, 0, -1) if text[at : at + k] in pieces), 0)
                if not size:
                    n = 1
                    break
                at, n = at + size, n + 1
            assert automaton.count(word + b" ") == n, (pieces, word)


def test_piece_counts(docs):
    import public_tokenizers

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    pieces = set(token_count.load_pieces(path))
    longest = max(map(len, pieces))

    def count(word):
        text, at, n = word + b" ", 0, 0
        while at < len(text):
            at += next(k for k in range(min(longest, len(text) - at), 0, -1) if text[at : at + k] in pieces)
            n += 1
        return n

    for r in token_count.count_pieces(docs, path).collect():
        w = (DOCS[r.doc_id][1] or "").encode().lower().split()
        assert (r.n_words, r.n_pieces) == (len(w), sum(map(count, w)))


# --- mixing ----------------------------------------------------------------------------------------------


def expected_targets(sizes, share=1.5, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), {}
    while True:
        rest = total - sum(full.values())
        open_ = [s for s in names if s not in full]
        part = {s: rest * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s: 2.0 * sizes[s] for s in open_ if part[s] > 2 * sizes[s]}
        if not over:
            return full | part
        full |= over


def test_mix(docs):
    rows = mixing.mix(docs).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for i, t, _, s, _ in DOCS:
        sizes[s] += len(words(t))
    want = expected_targets(sizes)
    for r in rows:
        assert r.size == len(words(DOCS[r.doc_id][1])) and r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size and all(0 <= t.position <= 1 for t in r.takes) and sum(t.words for t in r.takes) == r.taken
        taken[r.source] += r.taken
    assert len(rows) == len(DOCS)
    assert all(abs(taken[s] - want[s]) < 1 for s in sizes)
    again = {r.doc_id: r for r in mixing.mix(docs.repartition(3)).collect()}
    assert all(again[r.doc_id] == r for r in rows)


def test_positions_follow_the_schedule(spark):
    rows = spark.createDataFrame([(s, u / 20) for s in range(3) for u in range(21)], "place int, u double")
    for r in rows.select("place", "u", mixing._position(F.col("u"), F.col("place")).alias("t")).collect():
        rates, done, whole = mixing.SCHEDULES[r.place], 0.0, 0.0
        for a, b, v, w in zip(mixing.KNOTS, mixing.KNOTS[1:], rates, rates[1:], strict=False):
            whole += (b - a) * (v + w) / 2
            x = min(max(r.t - a, 0.0), b - a)
            done += v * x + (w - v) * x * x / (2 * (b - a))
        assert done / whole == pytest.approx(r.u, abs=1e-9)


def test_mix_is_sorted_by_position(docs):
    rows = mixing.mix(docs.repartition(3)).collect()
    first = [r.takes[0].position if r.takes else 2.0 for r in rows]
    assert first == sorted(first) and first[0] < 2.0


def test_mixed_documents(docs):
    takes = {r.doc_id: r for r in mixing.mix(docs).collect()}
    out = mixing.mixed_documents(docs).collect()
    assert [r.es_position for r in out] == sorted(r.es_position for r in out)
    got = defaultdict(int)
    for r in out:
        got[r.doc_id] += len(words(r.text))
    assert all(got[i] == t.taken for i, t in takes.items())


# --- windows -------------------------------------------------------------------------------------------------


def expected_windows(rows, size):
    first = {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        w = words(t)
        for k in range(len(w) - size + 1):
            first.setdefault(tuple(w[k : k + size]), i)
    out = {}
    for i, t, *_ in rows:
        w = words(t)
        gone = {k + j for k in range(len(w) - size + 1) if first[tuple(w[k : k + size])] < i for j in range(size)}
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


@pytest.mark.parametrize(("size", "chunk", "cells"), [(13, 8 << 20, 4), (3, 1000, 4), (5, 20_000, 4), (5, 1 << 20, 1)])
def test_windows(docs, size, chunk, cells):
    want = expected_windows(DOCS, size)
    rows = substring_dedup.drop_repeated_windows(docs, size, cells, chunk_bytes=chunk).collect()
    assert {r.doc_id: (r.es_n_words, r.es_n_removed, r.text) for r in rows} == want
    assert sum(x[1] for x in want.values()) > 0


def test_gaps():
    for x in ([], [0], [0, 1, 255, 256, 1000, 70000], [254, 255, 510]):
        assert substring_dedup._ids(substring_dedup._steps(np.array(x, np.int64))).tolist() == x
    for step in (3, 300, 70_000, 1 << 33):
        x = np.arange(50) * step + 7
        assert (substring_dedup._ids(substring_dedup._steps(x)) == x).all()


@pytest.mark.parametrize("segment", [1 << 21, 1 << 10])
def test_sketch_passes_few_unique_windows(monkeypatch, segment):
    """The share of unique windows that pass the prefilter is the same however many segments there are."""
    monkeypatch.setattr(substring_dedup, "_SEGMENT_WINDOWS", segment)
    rng = random.Random(1)
    texts = [" ".join(f"w{rng.randrange(1 << 30)}" for _ in range(400)) for _ in range(60)]
    sketch = substring_dedup.Sketch(60 * 400, 4, 3)
    tables = [pa.table({"text": texts[i::6], "id": list(range(i, 60, 6))}) for i in range(6)]
    sent = [r | {"chunk": i} for i, t in enumerate(tables) for r in substring_dedup._count(13, sketch)((pa.scalar(i, pa.int32()),), t).to_pylist()]
    sent = pa.RecordBatch.from_pylist(sorted(sent, key=lambda r: r["segment"]), substring_dedup._CELLS)
    masks = pa.Table.from_batches(substring_dedup._merge(sketch.width)(iter([sent])))
    passed = total = 0
    for i, t in enumerate(tables):
        a, b, _, _ = substring_dedup._chunk_windows(t, 13)
        own = masks.filter(pc.equal(masks.column("chunk"), i))
        passed += int(substring_dedup._maybe(a, b, sketch, own).sum())
        total += len(a)
    assert total == 60 * 388 and passed / total < 0.1


# --- fingerprints -----------------------------------------------------------------------------------------------


def expected_fingerprint(text, size=4):
    w = words(lower(text))
    parts = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def expected_components(fps, budget=4):
    parent = {i: i for i in fps}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    items = sorted(fps.items())
    for a, (i, x) in enumerate(items):
        for j, y in items[a + 1 :]:
            if (x ^ y).bit_count() <= budget:
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    return {i: root(i) for i in fps}


def test_simhash(docs):
    fps = {i: expected_fingerprint(t) for i, t, *_ in DOCS}
    want = expected_components(fps)
    rows = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: (r.fp % 2**64, r.component_id) for r in rows} == {i: (fps[i], want[i]) for i in fps}
    kept = simhash.one_of_each(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want.values()))
    assert all(r.text == DOCS[r.doc_id][1] for r in kept)


@pytest.mark.parametrize("group", [8, 10_000])
def test_fingerprint_links(spark, group):
    rng = random.Random(5)
    near = [rng.getrandbits(64) for _ in range(30)]
    fps = {*near, 0, 2**64 - 1}
    for _ in range(300):
        x = rng.choice(sorted(fps))
        for _ in range(rng.randrange(1, 7)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    edges = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp bigint"), group=group).collect()
    want = expected_components({x: x for x in fps})
    parent = {x: x for x in fps}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for r in edges:
        p, q = sorted((root(r.u % 2**64), root(r.v % 2**64)))
        parent[q] = p
    assert {x: root(x) for x in fps} == want
    assert len(edges) < 5 * 10 * len(fps)


@pytest.mark.parametrize("more", [1, 2, 4])
def test_every_link_agrees_in_some_key(spark, more):
    deal = simhash.Deal(4 + more, 4)
    assert len(deal.keys) == {1: 5, 2: 15, 4: 70}[more] and min(deal.widths) >= {1: 12, 2: 20, 4: 32}[more]
    rng = np.random.default_rng(more)
    x = rng.integers(0, 2**63, 300).astype(np.uint64)
    y = x ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (300, 4)).astype(np.uint64), axis=1)
    same = np.zeros(300, bool)
    for key, width in zip(deal.keys, deal.widths, strict=True):
        a, b = deal.first(x, key), deal.first(y, key)
        assert (np.bitwise_count(a) == np.bitwise_count(x)).all() and (np.bitwise_count(a ^ b) == np.bitwise_count(x ^ y)).all()
        same |= a >> np.uint64(64 - width) == b >> np.uint64(64 - width)
    assert same.all()
    fps = np.unique(np.concatenate((x, y)))
    df = spark.createDataFrame([(int(v),) for v in fps.view(np.int64)], "fp bigint")
    edges = {(r.u, r.v) for r in simhash.fingerprint_links(df, deal=deal, at_once=50).collect()}
    parent = {int(v): int(v) for v in fps.view(np.int64)}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for u, v in edges:
        parent[max(root(u), root(v))] = min(root(u), root(v))
    assert all(root(int(a)) == root(int(b)) for a, b in zip(x.view(np.int64), y.view(np.int64)))
    assert len({root(v) for v in parent}) == len({*expected_components({int(v): int(np.uint64(v)) for v in fps}).values()})


def test_trie_join_finds_every_link():
    rng = np.random.default_rng(2)
    x = np.unique(rng.integers(0, 2**16, 600).astype(np.uint64) << np.uint64(48))
    label = simhash.trie_links(x, 0, 2, at_once=50, small=4).label
    want = expected_components({int(v): int(v) for v in x}, 2)
    assert [int(x[k]) for k in label] == [want[int(v)] for v in x]


# --- packing ---------------------------------------------------------------------------------------------------------


def test_packing(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer = Tokenizer.from_file(path)
    rows = packing.pack(packing.pieces(docs, path, 512), 512).collect()
    got, placed = defaultdict(list), defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        placed[r.sequence_id].append((r.offset, r.length))
    for i, t, *_ in DOCS:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert sorted(got[i]) == [(k, a, len(ids[a : a + 512]), zlib.crc32(ids[a : a + 512].tobytes())) for k, a in enumerate(range(0, len(ids), 512))]
    for parts in placed.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 512
    assert len(placed) <= -(-sum(r.length for r in rows) // 512) * 1.05 + 1


@pytest.mark.parametrize("seed", range(4))
def test_program_holds_the_histogram(seed):
    rng = random.Random(seed)
    histogram = Counter(min(300, int(rng.lognormvariate(4, 1)) + 1) for _ in range(4000 if seed else 3))
    plan = packing.solve(histogram, 300, rounds=60, small=20)
    held = Counter()
    for config, copies in plan:
        assert copies > 0 and sum(k * n for k, n in config.items()) <= 300
        for k, n in config.items():
            held[k] += n * copies
    assert held == histogram
    bound = -(-sum(k * n for k, n in histogram.items()) // 300)
    assert sum(n for _, n in plan) <= bound * 1.02 + 1
    assert packing.solve({}, 300) == []


def test_price_is_the_best_configuration():
    rng = np.random.default_rng(3)
    sizes, price = np.array([3, 5, 7]), rng.random(3)
    got = packing._price(sizes, price, 20)
    best = max((a * price[0] + b * price[1] + c * price[2] for a in range(7) for b in range(5) for c in range(3) if 3 * a + 5 * b + 7 * c <= 20))
    assert (got * sizes).sum() <= 20 and (got * price).sum() == pytest.approx(best)


# --- pipeline -------------------------------------------------------------------------------------------------------------


def expected_groups(texts, size=5, threshold=0.8):
    """The smallest id that each is linked to by the Jaccard similarity of word shingles."""
    sets = {}
    for i, t in texts.items():
        w = words(lower(t))
        sets[i] = {" ".join(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    root = {i: i for i in texts}
    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and len(a & b) >= threshold * len(a | b):
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    return root


def test_pipeline(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = pipeline.STAGES[0][1](spark, docs, sf)
    first = {r.doc_id: r for r in quality.judge(docs).collect()}
    rows = {r.doc_id: r for r in kept.collect()}
    assert set(rows) == {i for i, r in first.items() if r.es_kept} and all(tuple(r) == DOCS[i] for i, r in rows.items())
    lines = pipeline.STAGES[1][1](spark, spark.createDataFrame([tuple(r) for r in rows.values()], SCHEMA), sf)
    want = expected_lines([tuple(r) for r in rows.values()])
    got = {r.doc_id: r for r in lines.collect()}
    assert {i: r.text for i, r in got.items()} == {i: "\n".join(x) for i, x in want.items()} and all(r.n_chars == len(r.text) for r in got.values())
    single = pipeline.STAGES[2][1](spark, spark.createDataFrame([tuple(r) for r in got.values()], SCHEMA), sf)
    components = expected_groups({i: r.text for i, r in got.items()})
    left = {r.doc_id: r for r in single.collect()}
    assert set(left) == set(components.values()) and left == {i: got[i] for i in left}
    mixed = pipeline.STAGES[3][1](spark, spark.createDataFrame([tuple(r) for r in left.values()], SCHEMA), sf).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in left.values():
        sizes[r.source] += len(words(r.text))
    for r in mixed:
        taken[r.source] += len(words(r.text))
    assert all(abs(taken[s] - t) < 1 for s, t in expected_targets(sizes).items())
    out = pipeline.run(spark, sf).collect()
    assert Counter(r.doc_id for r in out if r.piece == 0) == Counter(r.doc_id for r in mixed)
    assert sum(r.length for r in out if r.piece == 0) > 0


def test_program_places_short_pieces():
    """Pieces up to ``small`` wait only while they are few; in a corpus of short ones the program places most."""
    rng = np.random.default_rng(5)
    histogram = {int(k): int(n) for k, n in enumerate(rng.integers(50, 200, 150)) if k >= 20}
    assert packing.waiting(histogram, 200, 0.05) < 60 and packing.waiting({**histogram, 3000: 10_000}, 200, 0.05) == 200
    fitted, best_fit = 0, packing._Bins.best_fit

    def counted(self, k, n):
        nonlocal fitted
        fitted += k * n
        best_fit(self, k, n)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(packing._Bins, "best_fit", counted)
        plan = packing.solve(histogram, 1024)
    tokens = sum(k * n for k, n in histogram.items())
    assert fitted < 0.5 * tokens and sum(c for _, c in plan) <= -(-tokens // 1024) + 1


def test_nothing_else_imports_these():
    root = Path(__file__).resolve().parent.parent.parent / "echosieve"
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert "echosieve.llm" not in f.read_text()
    assert "echosieve.llm" in sys.modules
