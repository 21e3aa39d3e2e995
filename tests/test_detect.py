import random

import pytest
from pyspark.sql import functions as F

from echosieve.config import DetectConfig, IntraConfig, Scope
from echosieve.operators.components import connected_components
from echosieve.operators.detect import _ratio_ok, capped, detect_clones, expand_pairs, ranked_groups, shared_windows
from echosieve.operators.intra import detect_intra, ranked_intra, regions
from echosieve.operators.numbering import attach_numbers, number_rows
from echosieve.operators.scope import categorize_changed, changed_blocks, filter_changed, filter_scope, within_and_across


def found(spark, blocks, **cfg):
    rows = [(i, s, t) for i, (s, t) in enumerate(blocks)]
    return detect_clones(spark.createDataFrame(rows, "block_id bigint, struct_ids array<bigint>, text_ids array<bigint>"), DetectConfig(**cfg))


def grouped(d):
    out = {}
    for r in d.groups.collect():
        out.setdefault(r.group_id, set()).add(r.block_id)
    return sorted(map(sorted, out.values()))


def other(seed, n=45, kinds=1000):
    rng = random.Random(seed)
    return [rng.randrange(1000, 1000 + kinds) for _ in range(n)]


BODY = other(1, kinds=9)


def test_identical_and_renamed(spark):
    texts = [[10_000 * i + j for j in range(45)] for i in range(2)]
    blocks = [(BODY, texts[0]), (BODY, texts[1]), (other(3), None)]
    assert grouped(found(spark, blocks)) == [[0, 1]]
    assert grouped(found(spark, blocks, text_weight=0.3, threshold=0.95)) == []
    assert grouped(found(spark, [(BODY, BODY), (BODY, BODY)], text_weight=0.5, threshold=0.95)) == [[0, 1]]


@pytest.mark.parametrize("n", [2, 16, 20, 50])
def test_identical_blocks_are_one_group(spark, n):
    d = found(spark, [(BODY, BODY)] * n)
    assert grouped(d) == [list(range(n))]
    assert d.averages.first().avg_similarity == 1.0
    assert expand_pairs(d).count() == n * (n - 1) // 2


def test_windows_over_the_cap_count_for_nothing(spark):
    assert grouped(found(spark, [(BODY, BODY)] * 51)) == []
    # 102 blocks allow 51 in a window
    assert grouped(found(spark, [(BODY, BODY)] * 51 + [(other(i), None) for i in range(51)])) == [list(range(51))]


def test_short_blocks_have_too_few_windows(spark):
    assert grouped(found(spark, [(BODY[:11], None)] * 2)) == []
    assert grouped(found(spark, [(BODY[:12], None)] * 2)) == [[0, 1]]


def test_periodic_block_misses_the_adaptive_minimum(spark):
    periodic = [1, 2, 3, 4] * 25
    assert grouped(found(spark, [(periodic, None)] * 2, threshold=0.97)) == []
    assert grouped(found(spark, [(periodic, None)] * 2, threshold=0.80)) == [[0, 1]]


def test_chain_is_one_group_with_the_mean_of_its_pairs(spark):
    a = other(1, 100)
    b = a[:85] + other(2, 15)
    c = other(3, 15) + b[15:]
    d = found(spark, [(a, None), (b, None), (c, None)], threshold=0.8)
    assert grouped(d) == [[0, 1, 2]]
    assert sorted((r.a, r.b) for r in expand_pairs(d).collect()) == [(0, 1), (1, 2)]
    assert d.averages.first().avg_similarity == pytest.approx(0.85)


def test_early_exit_and_plain_blend_differ(spark):
    s = other(9, 100)
    a = [2000 + i for i in range(100)]
    b = [9000 + i for i in range(28)] + a[28:]
    blocks = [(s, a), (s, b)]
    assert grouped(found(spark, blocks, text_weight=0.3, mode="compat")) == []
    d = found(spark, blocks, text_weight=0.3, mode="exact")
    assert grouped(d) == [[0, 1]] and d.averages.first().avg_similarity == pytest.approx(0.916)


def test_copies_and_a_variant_weigh_by_their_pairs(spark):
    near = BODY[:40] + other(5, 5)
    d = found(spark, [(BODY, None)] * 3 + [(near, None)], threshold=0.8)
    pairs = {(r.a, r.b): r.similarity for r in expand_pairs(d).collect()}
    assert len(pairs) == 6
    assert d.averages.first().avg_similarity == pytest.approx(sum(pairs.values()) / 6)


@pytest.mark.parametrize("ratio", [None, 0.8, 1.0])
@pytest.mark.parametrize("most", [1, 7, 4096])
def test_windows_of_many_classes_are_divided(spark, ratio, most):
    rng = random.Random(3)
    length = {i: rng.choice([10, 12, 15, 20, 30, 45, 46]) for i in range(40)}
    holds = {i: {0} | {rng.randrange(1, 12) for _ in range(5)} for i in length}
    prints = spark.createDataFrame([(i, 1 + i % 2, length[i], fp) for i, fps in holds.items() for fp in fps], "class_id bigint, n bigint, len bigint, fp bigint")
    kept = capped(prints, 1000)
    allowed = None if ratio is None else _ratio_ok(ratio)
    got = {(r.a, r.b): (r.len_a, r.len_b, r.shared) for r in shared_windows(kept, ratio, allowed, most).collect()}
    fits = lambda x, y: ratio is None or 2.0 * min(x, y) / (x + y) >= ratio
    want = {(i, j): (length[i], length[j], len(holds[i] & holds[j])) for i in length for j in length if i < j and fits(length[i], length[j])}
    want |= {(i, i): (length[i], length[i], len(holds[i])) for i in length if i % 2}
    assert got == want


def test_nothing_to_compare(spark):
    assert grouped(found(spark, [(BODY, BODY)])) == []
    empty = spark.createDataFrame([], "block_id bigint, struct_ids array<bigint>, text_ids array<bigint>")
    assert grouped(detect_clones(empty)) == []


def test_rank(spark):
    rows = spark.createDataFrame([(1, 2, 5, 0.9), (2, 3, 9, 0.8), (3, 2, 4, 0.9), (4, 2, 1, 0.95)], "group_id int, size int, first_block int, avg_similarity double")
    assert [r.group_id for r in ranked_groups(rows).collect()] == [2, 4, 3, 1]


def test_components(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(40), rng.randrange(40)) for _ in range(25)] + [(7, 7), (None, 3)]
    parent = list(range(200))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None and u != v:
            x, y = sorted((root(u), root(v)))
            parent[y] = x
    got = {r.vertex: r.component for r in connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    linked = {x for u, v in edges if u is not None and u != v for x in (u, v)}
    assert got == {x: root(x) for x in linked}


def test_numbering(spark):
    df = spark.createDataFrame([(i * 37 % 101,) for i in range(101)], "x int").repartition(7)
    assert sorted((r.x, r.n) for r in number_rows(df, ["x"], "n").collect()) == [(i, i) for i in range(101)]


def test_wide_rows_stay_out_of_the_numbering(spark):
    df = spark.range(101).selectExpr("id * 37 % 101 as x", "repeat('w', 100) as wide").repartition(7)
    out = attach_numbers(df, ["x"], ["x"], "n")
    assert sorted((r.x, r.n, len(r.wide)) for r in out.collect()) == [(i, i, 100) for i in range(101)]
    assert "rangepartitioning" not in out._jdf.queryExecution().toString().lower()


# --- inside a block ---------------------------------------------------------------


def test_regions_are_found_once_and_apart():
    run = list(range(100, 130))
    ids = [1, 2, 3] + run + [4, 5] + run + [6]
    assert regions(ids, None, IntraConfig(min_region=10)) == [(3, 30, 35, 30, 1.0)]
    assert regions(run + run, None, IntraConfig(min_region=10)) == [(0, 30, 30, 30, 1.0)]
    assert regions(ids, None, IntraConfig(min_region=31)) == []
    assert regions(run, None, IntraConfig(min_region=20)) == []


def expected_regions(ids, texts, cfg):
    """By extending every pair of equal windows, one step at a time."""
    n, w, found = len(ids), cfg.window, set()
    at = {}
    for i in range(n - w + 1):
        at.setdefault(tuple(ids[i : i + w]), []).append(i)
    for i, j in ((i, j) for x in at.values() if len(x) <= cfg.max_positions for i in x for j in x if j - i >= w):
        ahead = back = 0
        while ahead < min(n - j, j - i) and ids[i + ahead] == ids[j + ahead]:
            ahead += 1
        while back < i and ids[i - back - 1] == ids[j - back - 1]:
            back += 1
        a, b, size = i - back, j - back, ahead + back
        if n >= 2 * cfg.min_region and size >= cfg.min_region and a + size <= b:
            share = sum(x == y for x, y in zip(texts[a : a + size], texts[b : b + size], strict=True)) / size if texts else 1.0
            similarity = 1.0 - cfg.text_weight + cfg.text_weight * share if texts and cfg.text_weight else 1.0
            if similarity >= cfg.threshold:
                found.add((a, size, b, size, similarity))
    kept = []
    common = lambda s, t, m, k: max(0, min(s + m, t + k) - max(s, t))
    for p in sorted(found, key=lambda p: (-p[1], -p[4], p[0], p[2])):
        if not any(all(2 * common(p[x], q[x], p[1], q[1]) > min(p[1], q[1]) for x in (0, 2)) for q in kept):
            kept.append(p)
    return kept


@pytest.mark.parametrize("most", [2, 3, 1000])
def test_regions_as_by_extending_every_seed(most):
    rng, some = random.Random(most), 0
    for case in range(400):
        pool = [[rng.randrange(4) for _ in range(rng.randrange(1, 30))] for _ in range(3)]
        ids = [x for _ in range(rng.randrange(1, 9)) for x in (rng.choice(pool) if rng.random() < 0.8 else [rng.randrange(9)])]
        texts = [rng.randrange(2) for _ in ids] if case % 2 else None
        cfg = IntraConfig(min_region=rng.choice([4, 8, 12]), window=rng.choice([1, 3, 4, 7]), max_positions=most, text_weight=0.3 if texts else 0.0, threshold=0.85)
        want = expected_regions(ids, texts, cfg)
        assert regions(ids, texts, cfg) == want, (ids, cfg)
        some += len(want)
    assert some > 50


def test_region_texts_weigh():
    run = [1000] * 3 + list(range(200, 227))
    ids = run + [7] + run
    texts = list(range(len(ids)))
    assert regions(ids, texts, IntraConfig(min_region=10, text_weight=0.3)) == []
    assert regions(ids, texts, IntraConfig(min_region=10, text_weight=0.3, threshold=0.7))[0][4] == pytest.approx(0.7)


def test_detect_intra(spark):
    run = list(range(100, 130))
    rows = [(1, run + [5] + run), (2, list(range(80))), (3, run)]
    df = spark.createDataFrame(rows, "block_id bigint, struct_ids array<bigint>")
    out = ranked_intra(detect_intra(df)).collect()
    assert [(r.block_id, r.longest) for r in out] == [(1, 30)]


# --- scope and changes ---------------------------------------------------------------


@pytest.fixture
def placed(spark):
    groups = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 3), (4, 3)], "block_id bigint, group_id bigint")
    files = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1), (4, 1)], "block_id bigint, file_id int")
    return groups, files


def _sets(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.group_id, r.file_id), set()).add(r.block_id)
    return out


def test_scopes(placed):
    groups, files = placed
    assert _sets(filter_scope(groups, files, Scope.INTER_FUNCTION)) == {(0, None): {0, 1, 2}, (3, None): {3, 4}}
    assert _sets(filter_scope(groups, files, Scope.INTER_FILE)) == {(0, None): {0, 1, 2}}
    assert _sets(filter_scope(groups, files, Scope.INTRA_FILE)) == {(0, 0): {0, 1}, (3, 1): {3, 4}}
    assert _sets(filter_scope(groups, files, Scope.INTRA_FUNCTION)) == {}


def test_within_and_across(placed):
    groups, files = placed
    assert {(r.group_id, r.category) for r in within_and_across(groups, files, F.lit(1)).collect()} == {(0, "cross"), (3, "within")}
    assert {(r.group_id, r.category) for r in within_and_across(groups, files, F.lit(0)).collect()} == {(0, "within"), (0, "cross")}


def test_changes(spark, placed):
    groups, _ = placed
    blocks = spark.createDataFrame([(0, "a", 1, 9), (1, "a", 10, 30), (2, "a", 31, 40), (3, "b", 10, 30), (4, "b", 50, 60)], "block_id bigint, path string, start_line int, end_line int")
    changes = spark.createDataFrame([("a", 20, 25), ("c", 1, 99)], "path string, start_line int, end_line int")
    changed = changed_blocks(blocks, changes)
    assert [r.block_id for r in changed.collect()] == [1]
    assert {r.block_id for r in filter_changed(groups, changed).collect()} == {0, 1, 2}
    assert [(r.group_id, r.category) for r in categorize_changed(groups, changed).collect()] == [(0, "existing")]
    all_new = spark.createDataFrame([(3,), (4,)], "block_id bigint")
    assert [(r.group_id, r.category) for r in categorize_changed(groups, all_new).collect()] == [(3, "new")]


@pytest.mark.parametrize(("text", "mask", "shown"), [("all", 7, "all"), (" Inter-File , intra-function", 5, "inter-file, intra-function"), ("inter-function", 3, "inter-file, intra-file"), ("intra-file,,", 2, "intra-file")])
def test_scope_names(text, mask, shown):
    assert Scope.parse(text) == mask and Scope.parse(text).text() == shown


@pytest.mark.parametrize("text", ["", " , ", "files"])
def test_scope_errors(text):
    with pytest.raises(ValueError):
        Scope.parse(text)
