import numpy as np

from codexlake.llm import knn

SCHEMA = "id string, embedding array<float>, h string, v string"
DIM = 32


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x", "y") for i, v in rows], SCHEMA)


def brute(rows, k, least):
    rows = sorted({(i, tuple(map(float, np.float32(v)))) for i, v in rows})
    m = np.array([v for _, v in rows])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(m @ m.T, 9)
    out = set()
    for a, (i, _) in enumerate(rows):
        near = sorted(((-s[a, b], j) for b, (j, _) in enumerate(rows) if j != i and s[a, b] >= least))[:k]
        out |= {(i, j) for _, j in near}
    return out


def test_recall_and_precision(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(60, DIM))
    rows = [(f"{k:03}-{j}", c + 0.35 * rng.normal(size=DIM)) for k, c in enumerate(centres) for j in range(8)]
    want = brute(rows, 5, 0.6)
    got = {(r.id, r.neighbour) for r in knn.nearest(table(spark, rows), 5, dim=DIM, min_similarity=0.6, cell_vectors=100).collect()}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


def test_copies_ties_and_unusable_rows(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=DIM)
    good = [(f"c{i:02}", base) for i in range(30)] + [("near", base + 0.01 * rng.normal(size=DIM)), ("c00", base), ("far", -base)]
    bad = [("n0", None), ("n1", [0.0] * DIM), ("n2", [1.0]), ("n3", [float("nan")] + [1.0] * (DIM - 1)), ("n4", [None] + [1.0] * (DIM - 1)), (None, base), ("n5", [float("inf")] * DIM)]
    got = knn.nearest(table(spark, good + bad), 3, dim=DIM, min_similarity=0.5).collect()
    assert {(r.id, r.neighbour) for r in got} == brute(good, 3, 0.5)
    assert {r.id for r in got} == {i for i, _ in good} - {"far"}
    pairs = [tuple(r) for r in knn.pairs_of(knn.nearest(table(spark, good), 3, dim=DIM, min_similarity=0.5)).collect()]
    assert len(pairs) == len(set(pairs)) and all(a < b for a, b in pairs)


def test_few_rows_and_none(spark):
    assert knn.nearest(table(spark, []), 3, dim=DIM).collect() == []
    assert knn.nearest(table(spark, [("a", np.ones(DIM))]), 3, dim=DIM).collect() == []
    got = {(r.id, r.neighbour) for r in knn.nearest(table(spark, [("a", np.ones(DIM)), ("b", np.arange(DIM) + 1.0)]), 3, dim=DIM).collect()}
    assert got == {("a", "b"), ("b", "a")}


def clustered(rng, clusters, each, spread):
    centres = rng.normal(size=(clusters, DIM))
    return [(f"{k:03}-{j:03}", c + spread * rng.normal(size=DIM)) for k, c in enumerate(centres) for j in range(each)]


def test_cells_that_come_out_too_large_are_dealt_again(spark):
    rng = np.random.default_rng(2)
    rows = clustered(rng, 120, 8, 0.3) + [(f"hot-{j:03}", v) for j, v in enumerate(np.repeat(rng.normal(size=(60, DIM)), 8, axis=0) * 0.5 + 2 + 0.15 * rng.normal(size=(480, DIM)))]
    want = brute(rows, 3, 0.8)
    for sizes in ({"cell_vectors": 60, "max_pivots": 4, "sample_vectors": 800}, {"cell_vectors": 40, "max_pivots": 6}):
        got = {(r.id, r.neighbour) for r in knn.nearest(table(spark, rows), 3, dim=DIM, min_similarity=0.8, **sizes).collect()}
        assert len(got & want) >= 0.9 * len(want) and len({i for i, _ in got}) >= 0.97 * len({i for i, _ in want})


def test_few_pairs_are_verified():
    rng = np.random.default_rng(3)
    vectors = knn.unit(np.array([v for _, v in clustered(rng, 150, 6, 0.1)]) + 0.0)
    wide = knn.unit(np.hstack([vectors, 0.02 * rng.normal(size=(len(vectors), 480))]).astype(np.float32))
    lines = rng.standard_normal((wide.shape[1], knn.PROJECTIONS)).astype(np.float32)
    asked = np.arange(0, len(wide), 3)
    found, verified = set(), 0
    for q, c, _, n in knn.search_cell(wide, asked, 6, lines, float(np.sqrt(0.8))):
        found |= set(zip(q.tolist(), c.tolist()))
        verified += n
    similar = wide[asked] @ wide.T
    top = np.argpartition(-similar, 6, axis=1)[:, :6]
    want = {(int(asked[r]), int(c)) for r in range(len(asked)) for c in top[r] if similar[r, c] >= 0.6}
    assert len(found & want) >= 0.99 * len(want) and verified <= 0.05 * len(asked) * len(wide)


def test_collisions_count_windows():
    rng = np.random.default_rng(4)
    vectors = knn.unit(rng.normal(size=(70, DIM)))
    lines = rng.standard_normal((DIM, 40)).astype(np.float32)
    arrays, asked = knn.SortedProjections(vectors, lines), np.array([0, 5, 69])
    values = vectors @ lines
    for half in (0.05, 0.5, 3.0):
        low, high = values[asked] - np.float32(half), values[asked] + np.float32(half)
        want = ((values[None] >= low[:, None]) & (values[None] <= high[:, None])).sum(axis=2)
        assert np.abs(arrays.collisions(asked, np.float32(half)).astype(int) - want).max() <= 1


def test_copies_needed_are_the_fewest_that_cover():
    asked, held = np.array([[0, 1, 2], [3, 4, 5], [6, 7, 8]]), np.array([[1, 0, 2], [3, 9, 9], [9, 9, 7]])
    assert knn.copies_needed(asked, held, 0.6) == (2, 1) and knn.copies_needed(asked, held, 1.0) == (3, 2)
    assert knn.copies_needed(np.array([[0, 1]]), np.array([[2, 3]])) == (2, 2) and knn.copies_needed(asked[:0], held[:0]) == (2, 1)


def test_vectors_without_structure_are_held_in_more_cells(spark):
    rng = np.random.default_rng(8)
    rows = clustered(rng, 400, 4, 0.6)
    want = brute(rows, 3, 0.6)
    found = {}
    for name, kw in (("fixed", {"held_in": 2}), ("few", {"most_cells": 2}), ("measured", {})):
        got = {(r.id, r.neighbour) for r in knn.nearest(table(spark, rows), 3, dim=DIM, min_similarity=0.6, cell_vectors=20, **kw).collect()}
        found[name] = len(got & want) / len(want)
    assert found["fixed"] < 0.85 and found["fixed"] <= found["few"] < found["measured"] and found["measured"] >= 0.9
