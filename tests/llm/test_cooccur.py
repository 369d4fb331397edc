from collections import Counter
from itertools import combinations

import numpy as np

from codexlake.llm import cooccur

SCHEMA = "entity_id string, topic string, n_ab string, item string"


def brute(rows):
    baskets = {}
    for b, i in rows:
        if b is not None and i is not None:
            baskets.setdefault(b, set()).add(i)
    one, two = Counter(), Counter()
    for items in baskets.values():
        one.update(items)
        two.update(combinations(sorted(items), 2))
    return {(a, b): (one[a], one[b], n, len(baskets)) for (a, b), n in two.items()}


def rows_of(seed=0):
    rng = np.random.default_rng(seed)
    rows = [(f"e{e}", f"t{min(int(t), 60):02}") for e in range(200) for t in rng.zipf(1.4, rng.integers(0, 9))]
    return rows + [("big", f"t{i:02}") for i in range(61)] + [(f"e{e}", "common") for e in range(90)] + rows[:50] + [(None, "t01"), ("e1", None), ("e1", ""), ("e2", "")]


def test_counts_in_any_blocking(spark, monkeypatch):
    rows = rows_of()
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    for block, at_once, small in ((4096, 2_000_000, 2_000), (7, 50, 0), (7, 50, 6), (7, 2_000_000, 1_000)):
        monkeypatch.setattr(cooccur, "ITEM_BLOCK", block)
        monkeypatch.setattr(cooccur, "SMALL_BASKET", small)
        monkeypatch.setattr(cooccur, "PRODUCTS_AT_ONCE", at_once)
        got = {(r.item_a, r.item_b): (r.n_a, r.n_b, r.n_ab, r.n_baskets) for r in cooccur.together(df, "entity_id", "topic").collect()}
        assert got == brute(rows)


def test_gram_of_baskets_counts_pairs(monkeypatch):
    rng = np.random.default_rng(3)
    entries = sorted({(int(r), int(i)) for r, i in zip(rng.integers(0, 40, 400), rng.integers(0, 30, 400))})
    record, item = (np.array(x) for x in zip(*entries))
    want = Counter(p for r in set(record.tolist()) for p in combinations(sorted(item[record == r].tolist()), 2))
    for at_once in (2_000_000, 100, 1):
        monkeypatch.setattr(cooccur, "PRODUCTS_AT_ONCE", at_once)
        got = Counter()
        for a, b, n in cooccur.gram_of_baskets(record, item, 30):
            for x, y, k in zip(a.tolist(), b.tolist(), n.tolist()):
                got[x, y] += k
        assert got == want
    assert not [len(a) for a, _, _ in cooccur.gram_of_baskets(record[:0], item[:0], 0) if len(a)]


def test_limits(spark):
    rows = rows_of(1)
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = {(r.item_a, r.item_b) for r in cooccur.together(df, "entity_id", "topic", min_together=3, min_share_of=40, min_lift=2).collect()}
    assert got == {p for p, (a, b, n, k) in brute(rows).items() if n >= 3 and 40 * n >= k and n * k >= 2 * a * b}


def test_empty(spark):
    assert cooccur.together(spark.createDataFrame([], SCHEMA), "entity_id", "topic").collect() == []
