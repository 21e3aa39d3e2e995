import random
from collections import Counter
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest

from echosieve.functions.similarity import lcs_length
from echosieve.operators import candidates
from echosieve.plans import queries as core
from echosieve.storage import shared_dir

SF = Path("/root/testdata/sf0.001")
WINDOW, LEAST, PERCENT = 10, 3, 80


@pytest.fixture(scope="module")
def texts():
    """Texts that share common lines, near copies, copies, and texts of one bag in another order."""
    rng = random.Random(5)
    line = [" ".join(f"l{k}x{i}" for i in range(14)) for k in range(3)]
    out = []
    for i in range(60):
        own = [f"w{rng.randrange(40)}" for _ in range(rng.choice([20, 25, 60, 90]))]
        out.append(" ".join([*own, *rng.sample(line, rng.randrange(4))]))
        if i % 5 == 0:
            near = out[-1].split()
            near[rng.randrange(len(near))] = "other"
            out += [" ".join(near), out[-1]]
        if i % 7 == 0:
            rng.shuffle(own)
            out.append(" ".join([*own, *line]))
    return out + [None, "", "short text"]


def expected(texts, cap, least, percent, bags):
    rows = {i: t.split() for i, t in enumerate(texts) if t and len(t.split()) >= 30}
    windows = {i: {tuple(t[k : k + WINDOW]) for k in range(len(t) - WINDOW + 1)} for i, t in rows.items()}
    held = Counter(w for x in windows.values() for w in x)
    kept = {i: {w for w in x if 2 <= held[w] <= cap} for i, x in windows.items()}
    first = {}
    for i, t in rows.items():
        first.setdefault(tuple(t), i)
    out = {}
    for a, b in combinations(rows, 2):
        shared, x, y = len(kept[a] & kept[b]), len(rows[a]), len(rows[b])
        common = (Counter(rows[a]) & Counter(rows[b])).total()
        if shared >= least and (percent is None or 200 * min(x, y) >= percent * (x + y)) and (not bags or 200 * common >= percent * (x + y)):
            a, b = sorted((first[tuple(rows[a])], first[tuple(rows[b])]))
            out[a, b] = (len(rows[a]), len(rows[b]), shared, common if bags or a == b else 0)
    return out


@pytest.mark.parametrize("least, percent, bags", [(1, None, False), (LEAST, PERCENT, False), (LEAST, PERCENT, True)])
@pytest.mark.parametrize("hot, passes, unit", [(1, 1, 7), (4, 2, 30), (1, 2, 16_384), (64, 1, 16_384)])
def test_pairs(spark, texts, monkeypatch, least, percent, bags, hot, passes, unit):
    monkeypatch.setattr(candidates, "UNIT_CLASSES", unit)
    docs = spark.createDataFrame([*enumerate(texts)], "block_id long, text string")
    full, classes, members = candidates.text_classes(docs, 30)
    assert classes.count() < members.count()
    cap = 45
    got = candidates.similar_pairs(full, WINDOW, cap, least, percent, bags, passes, hot).collect()
    found = {(r.a, r.b): (r.len_a, r.len_b, r.shared, r.common) for r in got}
    assert len(found) == len(got) and found == expected(texts, cap, least, percent, bags)


def test_little_is_written(spark):
    """Token arrays and windows were written before, 8 times the documents."""
    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir()) if folder.exists() else set()
    core.QUERIES["bag_dice_pairs"](spark, str(SF)).count()
    written = sum(f.stat().st_size for d in set(folder.iterdir()) - before for f in d.glob("*.parquet"))
    assert written < 2 * (SF / "documents.parquet").stat().st_size


def common_length(x, y):
    row = [0] * (len(y) + 1)
    for a in x:
        last = row
        row = [0]
        for k, b in enumerate(y):
            row.append(last[k] + 1 if a == b else max(row[k], last[k + 1]))
    return row[-1]


@pytest.mark.parametrize("hot, unit", [(1, 7), (64, 16_384)])
def test_aligned_pairs(spark, texts, monkeypatch, hot, unit):
    """Pairs are aligned where their bags are compared; texts of one bag in another order are told apart."""
    monkeypatch.setattr(candidates, "UNIT_CLASSES", unit)
    docs = spark.createDataFrame([*enumerate(texts)], "block_id long, text string")
    full, _, _ = candidates.text_classes(docs, 30)
    got = candidates.similar_pairs(full, WINDOW, 45, LEAST, PERCENT, True, hot=hot, aligned=True).collect()
    bags, want = expected(texts, 45, LEAST, PERCENT, True), {}
    for (a, b), (x, y, shared, _) in bags.items():
        common = common_length(texts[a].split(), texts[b].split())
        if 200 * common >= PERCENT * (x + y):
            want[a, b] = (x, y, shared, common)
    assert 0 < len(want) < len(bags)
    assert len(got) == len(want) and {(r.a, r.b): (r.len_a, r.len_b, r.shared, r.common) for r in got} == want


@pytest.mark.parametrize("name", ["lcs_dice_documents", "clone_detection"])
def test_whole_cascade_writes_little(spark, name):
    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir()) if folder.exists() else set()
    core.QUERIES[name](spark, str(SF)).count()
    written = sum(f.stat().st_size for d in set(folder.iterdir()) - before for f in d.glob("*.parquet"))
    assert written < 2 * (SF / "documents.parquet").stat().st_size


def test_tables_go_early(spark):
    """Tables that aren't read any more lay beside the cells' shuffle files before."""
    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir()) if folder.exists() else set()
    core.QUERIES["clone_groups"](spark, str(SF)).count()
    left = {d.name.removeprefix("echosieve-").rsplit("-", 1)[0] for d in set(folder.iterdir()) - before}
    assert "needed" in left and not left & {"keys", "rare", "hot", "counted", "class-texts"}


@pytest.mark.parametrize("hot, unit", [(1, 7), (64, 16_384)])
def test_share_of_windows(spark, texts, monkeypatch, hot, unit):
    """Pairs that share too few windows for their lengths don't leave the cells."""
    monkeypatch.setattr(candidates, "UNIT_CLASSES", unit)
    docs = spark.createDataFrame([*enumerate(texts)], "block_id long, text string")
    full, _, _ = candidates.text_classes(docs, 30)
    got = candidates.similar_pairs(full, WINDOW, 45, LEAST, hot=hot, share=0.35).collect()
    every = expected(texts, 45, LEAST, None, False)
    want = {(a, b): v for (a, b), v in every.items() if a == b or v[2] >= int(0.35 * (min(v[:2]) - WINDOW + 1))}
    assert 0 < len(want) < len(every)
    assert len(got) == len(want) and {(r.a, r.b): (r.len_a, r.len_b, r.shared, r.common) for r in got} == want


@pytest.mark.parametrize("least, percent, unit", [(1, None, 7), (LEAST, PERCENT, 16_384)])
def test_pairs_of_blocks_are_made_in_the_cells(spark, texts, monkeypatch, least, percent, unit):
    """Pairs of classes were joined with the members on both sides: each pair went through two shuffles."""
    monkeypatch.setattr(candidates, "UNIT_CLASSES", unit)
    monkeypatch.setattr(candidates, "RETURNED", 5)
    docs = spark.createDataFrame([(100 - i, t) for i, t in enumerate(texts)], "block_id long, text string")
    full, classes, members = candidates.text_classes(docs, 30)
    several = {r.class_id for r in classes.filter("n > 1").collect()}
    got = candidates.similar_pairs(full, WINDOW, 45, least, percent, hot=4, members=members).collect()
    rows = {100 - i: t.split() for i, t in enumerate(texts) if t and len(t.split()) >= 30}
    windows = {i: {tuple(t[k : k + WINDOW]) for k in range(len(t) - WINDOW + 1)} for i, t in rows.items()}
    held = Counter(w for x in windows.values() for w in x)
    want = {}
    for a, b in combinations(sorted(rows), 2):
        shared, x, y = sum(2 <= held[w] <= 45 for w in windows[a] & windows[b]), len(rows[a]), len(rows[b])
        if shared >= least and (percent is None or 200 * min(x, y) >= percent * (x + y)):
            want[a, b] = (x, y, shared)
    assert len(several) > 1 and len(got) == len(want) and {(r.a, r.b): (r.len_a, r.len_b, r.shared) for r in got} == want


@pytest.mark.parametrize("name", ["shared_window_counts", "candidates_static", "length_ratio_pairs"])
def test_pairs_are_not_shuffled(spark, name):
    """The only shuffle over the cells' rows deals the classes out to the cells; a join of the pairs came after it before."""
    plan = core.QUERIES[name](spark, str(SF))._jdf.queryExecution().optimizedPlan().toString()
    above, found, _ = plan.partition("FlatMapGroupsInArrow")
    assert found and "Join" not in above


def test_waves(spark, texts, monkeypatch):
    """All classes went to all their cells at once before: copies grow with the number of cells."""
    units = candidates._Units([(n, 10) for n in range(30, 200)], PERCENT)
    assert units.waves(1e9) == [(0, units.total**2)]
    monkeypatch.setattr(candidates, "UNIT_CLASSES", 20)
    units = candidates._Units([(n, 10) for n in range(30, 200)], PERCENT)
    sent = {u * units.total + v: units.tokens[u] + units.tokens[v] * (u != v) for u in range(units.total) for v in units.meets[u] if u <= v}
    most = 4 * sum(units.tokens)
    waves = units.waves(most)
    assert len(waves) > 2 and waves[0][0] == 0 and waves[-1][1] == units.total**2 and all(x[1] == y[0] for x, y in zip(waves, waves[1:], strict=False))
    assert max(sum(n for cell, n in sent.items() if low <= cell < high) for low, high in waves) <= 1.1 * most
    docs = spark.createDataFrame([*enumerate(texts)], "block_id long, text string")
    monkeypatch.setattr(candidates, "UNIT_CLASSES", 7)
    written = []
    monkeypatch.setattr(candidates, "materialize", lambda df, name, *a, keep=candidates.materialize, **k: written.append(name) or keep(df, name, *a, **k))
    got = candidates.similar_pairs(candidates.text_classes(docs, 30)[0], WINDOW, 45, LEAST, PERCENT, True).collect()
    assert written.count("met") > 1
    assert {(r.a, r.b): (r.len_a, r.len_b, r.shared, r.common) for r in got} == expected(texts, 45, LEAST, PERCENT, True)


@pytest.mark.parametrize("name", ["duplicated_lines_by_source", "groups_page", "scope_intra_file", "summary", "within_vs_cross_file", "cross_language_groups", "diff_filtered_groups", "duplicates_existing_vs_new", "group_avg_similarity", "groups_ranked", "scope_inter_file", "file_duplicates"])
def test_groups_come_from_waves(spark, monkeypatch, name):
    """The groups' search sends its classes to the cells in waves; its rows are those of one wave."""
    want = sorted(core.QUERIES[name](spark, str(SF)).collect(), key=str)
    monkeypatch.setattr(candidates, "UNIT_CLASSES", 5)
    monkeypatch.setattr(candidates, "COPIES", 0.3)
    written = []
    monkeypatch.setattr(candidates, "materialize", lambda df, name, *a, keep=candidates.materialize, **k: written.append(name) or keep(df, name, *a, **k))
    got = sorted(core.QUERIES[name](spark, str(SF)).collect(), key=str)
    assert written.count("met") > 1 and got == want


@pytest.mark.parametrize("name", ["groups_page", "scope_intra_file", "summary", "within_vs_cross_file", "cross_language_groups", "diff_filtered_groups", "duplicates_existing_vs_new", "group_avg_similarity", "groups_ranked", "file_duplicates", "scope_inter_file"])
def test_groups_search_writes_in_small_parts(spark, monkeypatch, name):
    """All windows lay in one shuffle before, and a wave sent four copies of the tokens."""
    monkeypatch.setattr(candidates, "UNIT_CLASSES", 5)
    written, copies = [], []

    def waves(units, most, of=candidates._Units.waves):
        sent = {u * units.total + v: units.tokens[u] + units.tokens[v] * (u != v) for u in range(units.total) for v in units.meets[u] if u <= v}
        out = of(units, most)
        copies.extend(sum(n for cell, n in sent.items() if low <= cell < high) / most * candidates.COPIES for low, high in out)
        return out

    monkeypatch.setattr(candidates._Units, "waves", waves)
    monkeypatch.setattr(candidates, "materialize", lambda df, name, *a, keep=candidates.materialize, **k: written.append(name) or keep(df, name, *a, **k))
    core.QUERIES[name](spark, str(SF)).count()
    assert written.count("rare") >= 3 and max(copies) < 2.5


@pytest.mark.parametrize("name", ["length_ratio_pairs", "candidates_static"])
def test_windows_of_pairs_come_in_three_passes(spark, monkeypatch, name):
    """One or two passes before; the windows of a pass lie in one shuffle, beside the texts."""
    written = []
    monkeypatch.setattr(candidates, "materialize", lambda df, name, *a, keep=candidates.materialize, **k: written.append(name) or keep(df, name, *a, **k))
    core.QUERIES[name](spark, str(SF)).count()
    assert written.count("rare") == 3


def test_waves_send_two_copies(monkeypatch):
    """Four copies of the tokens before."""
    monkeypatch.setattr(candidates, "UNIT_CLASSES", 20)
    units = candidates._Units([(n, 10) for n in range(30, 200)], PERCENT)
    sent = {u * units.total + v: units.tokens[u] + units.tokens[v] * (u != v) for u in range(units.total) for v in units.meets[u] if u <= v}
    waves = units.waves(candidates.COPIES * sum(units.tokens))
    assert max(sum(n for cell, n in sent.items() if low <= cell < high) for low, high in waves) < 2.5 * sum(units.tokens)


def test_bucket_of_one_class():
    """The header of a single class could not be read."""
    columns = [7], [2], [30], [4]
    assert candidates._spread(candidates._squeezed(*map(candidates.np.array, columns)), 4, 1).tolist() == [*columns]


def test_classes_of_a_bucket_are_packed_small():
    """32 bytes a class and bucket before, beside some 7 for each window; there are the more buckets, the more tokens."""
    import numpy as np

    ids = np.sort(np.random.default_rng(1).integers(0, 500_000, 2000))
    columns = ids, np.ones(2000, np.int64), ids % 3000 + 30, ids % 4 + 1
    data = candidates._squeezed(*columns)
    assert (candidates._spread(data, 4, 2000) == np.array(columns)).all() and len(data) < 8 * 2000


def test_overlaps_take_either_way(monkeypatch):
    """Common bags by products of matrices or by lookups, whichever is estimated to be cheaper."""
    import numpy as np

    rng = np.random.default_rng(2)
    bags = [Counter(rng.integers(0, 60, 80).tolist()) for _ in range(30)]
    ids = [np.array(sorted(b), np.uint64) for b in bags]
    packed = [memoryview(candidates._packed(x, 6)) for x in ids]
    counts = [memoryview(np.array([b[int(k)] for k in x], np.int32).tobytes()) for b, x in zip(bags, ids, strict=True)]
    i, j = (x.ravel() for x in np.meshgrid(np.arange(15), np.arange(15, 30)))
    want = [(bags[a] & bags[b]).total() for a, b in zip(i, j, strict=True)]
    for choice in (True, False):
        monkeypatch.setattr(candidates, "_by_matrix", lambda *_, choice=choice: choice)
        assert candidates._Bags(packed, counts, np.full(30, 80), np.arange(5), 80.0).common(i, j).tolist() == want


@pytest.mark.parametrize("together, size", [(1, 1 << 20), (2, 1 << 12), (16, 1 << 20), (10**6, 1 << 20)])
def test_alignment(monkeypatch, together, size):
    """Near copies, texts of one bag in another order, ends that differ and long texts among short ones, aligned together and alone."""
    monkeypatch.setattr(candidates, "ALIGNED", size)
    monkeypatch.setattr(candidates, "TOGETHER", together)
    rng = random.Random(3)
    sides = []
    for k in range(160):
        x = [rng.randrange(rng.choice([3, 30, 400])) for _ in range(rng.choice([30, 62, 63, 64, 126, 127, 300, 900]))]
        y = [rng.randrange(400) if rng.random() < rng.choice([0, 0.05, 0.2]) else t for t in x if rng.random() > rng.choice([0, 0.02, 0.15])]
        if k % 4 == 1:
            y = [*y[len(y) // 6 :], *y[: len(y) // 6]]
        if k % 4 == 2:
            rng.shuffle(y)
        sides.append((x, y or [1]) if k % 2 else (y or [1], x))
    bags = [np.unique(np.array(t, np.uint64), return_inverse=True) for pair in sides for t in pair]
    texts = candidates._Texts([memoryview(candidates._packed(u, 6)) for u, _ in bags], [memoryview(p.astype(candidates._places(len(u))).tobytes()) for u, p in bags])
    i, j = np.arange(0, len(bags), 2), np.arange(1, len(bags), 2)
    least = np.array([-(-PERCENT * (len(x) + len(y)) // 200) for x, y in sides])
    want = np.array([lcs_length(x, y) for x, y in sides])
    assert 20 < (want >= least).sum() < 140
    got = texts.common(i, j, least)
    assert (np.where(want >= least, want, -1) == np.where(got >= least, got, -1)).all()
    assert (texts.common(i, j, np.zeros(len(i), np.int64)) == want).all()


def test_alignment_takes_many_pairs_at_once(monkeypatch):
    """A pair of near copies costs no pass of its own."""
    monkeypatch.setattr(candidates, "_alone", None)
    rng = random.Random(4)
    texts = [[rng.randrange(200) for _ in range(450)] for _ in range(64)]
    near = [[rng.randrange(200) if rng.random() < 0.05 else t for t in x] for x in texts]
    bags = [np.unique(np.array(t, np.uint64), return_inverse=True) for t in [*texts, *near]]
    held = candidates._Texts([memoryview(candidates._packed(u, 6)) for u, _ in bags], [memoryview(p.astype(np.uint16).tobytes()) for _, p in bags])
    got = held.common(np.arange(64), np.arange(64, 128), np.full(64, 360))
    assert got.tolist() == [lcs_length(x, y) for x, y in zip(texts, near, strict=True)]


def test_alignment_is_spread():
    """A few million tokens come in several units if they are aligned; many come in units of the usual size."""
    lengths = [(n, 500) for n in range(400, 500)]
    tokens = sum(n * k for n, k in lengths)
    spread, usual = (candidates._Units(lengths, PERCENT, candidates._unit_tokens(tokens, aligned)) for aligned in (True, False))
    assert spread.total >= 2 * usual.total
    assert max(spread.tokens) <= max(1 << 21, tokens // candidates.ALIGNED_UNITS)
    assert candidates._unit_tokens(10**9, True) == candidates.UNIT_TOKENS
