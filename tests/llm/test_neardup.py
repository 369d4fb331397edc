import re

import numpy as np

from codexlake.llm import neardup

SCHEMA = "id string, narrative string, summary string, field string, n string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def sets_of(rows, size):
    out = {}
    for i, *texts in rows:
        for field, text in zip(("narrative", "summary"), texts):
            words = re.findall(r"[^\W_]+", (text or "").lower())
            if i is not None and len(words) >= size:
                out[field, i] = {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}
    return out


def brute(rows, size, least):
    sets = sorted(sets_of(rows, size).items())
    return {(f, i, j) for a, ((f, i), x) in enumerate(sets) for (g, j), y in sets[a + 1 :] if f == g and i != j and len(x & y) >= least * len(x | y)}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.integers(len(words))] = f"w{rng.integers(10_000)}"
    return " ".join(words)


def rows_of():
    rng = np.random.default_rng(0)
    rows = []
    for g in range(25):
        words = [f"w{x}" for x in rng.integers(0, 10_000, 60)]
        rows += [(f"{g:02}-{j}", edited(rng, words, 2 * j), " ".join(words[: 3 + g])) for j in range(5)]
    rows += [("same-1", "One two, THREE four five!", None), ("same-2", "one two three four five", ""), ("short", "one two", " "), (None, "one two three four five", "x"), rows[0], ("long", "long text goes on " * 40_000, None), ("long2", "long text goes on " * 30_000, None)]
    return rows


def test_pairs_equal_brute_force(spark):
    rows = rows_of()
    members, links = neardup.classes_and_links(table(spark, rows), "id", ("narrative", "summary"), words=3, threshold=0.5)
    got = [tuple(r) for r in neardup.pairs_of(members, links).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 3, 0.5)
    assert all(r.jaccard >= 0.5 and r.class_a < r.class_b for r in links.collect())
    assert {(r.field, r.id) for r in members.collect()} == set(sets_of(rows, 3))


def test_a_family_that_holds_a_third_of_the_rows_keeps_its_links(spark):
    rng = np.random.default_rng(1)
    words, copied = ([f"w{x}" for x in rng.integers(0, 10_000, 150)] for _ in range(2))
    rows = [(f"family-{j:02}", edited(rng, words, 3), None) for j in range(40)]
    rows += [(f"copied-{j:02}", " ".join(copied), None) for j in range(30)] + [(f"variant-{j}", edited(rng, copied, 4), None) for j in range(5)]
    rows += [(f"other-{j:02}", edited(rng, [f"w{x}" for x in rng.integers(0, 10_000, 150)], 0), None) for j in range(45)]
    members, links = neardup.classes_and_links(table(spark, rows), "id", ("narrative", "summary"), words=3, threshold=0.5)
    assert {tuple(r) for r in neardup.pairs_of(members, links).collect()} == brute(rows, 3, 0.5)


def test_texts_on_one_template_keep_all_links(spark):
    rng = np.random.default_rng(2)
    def words(n):
        return [f"w{x}" for x in rng.integers(0, 100_000, n)]
    template = words(160)
    rows = [(f"t{j:04}", " ".join(template + words(30)), None) for j in range(60)] + [(f"x{j:04}", " ".join(words(190)), None) for j in range(1440)]
    members, links = neardup.classes_and_links(table(spark, rows), "id", ("narrative",), words=3, threshold=0.5)
    got = {(r.class_a, r.class_b) for r in links.collect()}
    assert len(got) == 1770 and got == {(i, j) for _, i, j in brute(rows[:60], 3, 0.5)} and members.count() == 1500


def test_bands_of_many_texts_are_dealt_to_blocks(spark):
    rng = np.random.default_rng(3)
    words = [f"w{x}" for x in rng.integers(0, 10_000, 120)]
    rows = [(f"f{j:02}", edited(rng, words, 2), None) for j in range(50)] + [(f"x{j}", edited(rng, [f"w{x}" for x in rng.integers(0, 10_000, 120)], 0), None) for j in range(20)]
    for block in (3, 10):
        members, links = neardup.classes_and_links(table(spark, rows), "id", ("narrative",), words=3, threshold=0.5, block_texts=block)
        assert {tuple(r) for r in neardup.pairs_of(members, links).collect()} == brute(rows, 3, 0.5)


def test_runs_are_paired_alike_however_batches_are_cut():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    band = np.sort(rng.integers(0, 60, 400))
    band[100:160] = band[100]
    node, n = np.arange(400), rng.integers(5, 20, 400)
    want = {(i, j) for i in range(400) for j in range(i + 1, 400) if band[i] == band[j] and np.count_nonzero(band == band[i]) <= 30 and min(n[i], n[j]) >= 0.5 * max(n[i], n[j])}
    hot = {i for i in range(400) if np.count_nonzero(band == band[i]) > 30}
    for size in (1, 7, 33, 64, 400):
        batches = [pa.RecordBatch.from_arrays([pa.array(x[a : a + size]) for x in (band, node, n)], names=["band", "node", "n"]) for a in range(0, 400, size)]
        out = pa.Table.from_batches(list(neardup._runs_to_pairs(iter(batches), 0.5, 30))).to_pylist()
        assert {(r["a"], r["b"]) for r in out if r["n"] is None} == want and {r["a"] for r in out if r["n"] is not None} == hot


def test_groups_are_connected_components(spark):
    rows = rows_of()
    members, links = neardup.classes_and_links(table(spark, rows), "id", ("narrative", "summary"), words=3, threshold=0.5)
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for f, a, b in brute(rows, 3, 0.5):
        x, y = find((f, a)), find((f, b))
        parent[max(x, y)] = min(x, y)
    got = neardup.groups_of(members, links).collect()
    assert {(r.field, r.id): (r.field, r.group_id) for r in got} == {k: find(k) for k in sets_of(rows, 3)}


def test_chains_join_into_one_group(spark):
    names = [f"n{i:03}" for i in range(40)]
    members = spark.createDataFrame([("f", n, n) for n in names], "field string, id string, class_id string")
    links = spark.createDataFrame([("f", a, b, 0.9) for a, b in zip(names, names[1:])], "field string, class_a string, class_b string, jaccard double")
    got = neardup.groups_of(members, links).collect()
    assert {r.group_id for r in got} == {"n000"} and sorted(r.n_links for r in got) == [1, 1] + [2] * 38


def test_defaults_and_empty(spark):
    members, links = neardup.classes_and_links(table(spark, []), "id", ("narrative",))
    assert members.collect() == links.collect() == [] and neardup.groups_of(members, links).collect() == []
    rows = [("a", "one two three four five six", None), ("b", "ONE two three four five six.", None), ("c", "one two three four", None)]
    members, links = neardup.classes_and_links(table(spark, rows), "id", ("narrative", "summary"))
    assert {(r.id, r.class_id) for r in members.collect()} == {("a", "a"), ("b", "a")} and links.collect() == []


def test_rounds_give_the_same_links(spark):
    rng = np.random.default_rng(5)
    words = [f"w{x}" for x in rng.integers(0, 10_000, 120)]
    rows = [(f"f{j:02}", edited(rng, words, 2), None) for j in range(30)] + [(f"x{j}", edited(rng, [f"w{x}" for x in rng.integers(0, 10_000, 120)], 0), None) for j in range(10)]
    members, links = neardup.classes_and_links(table(spark, rows), "id", ("narrative",), words=3, threshold=0.5, band_rows=2000, pairs_at_once=(200, 150))
    got = [tuple(r) for r in neardup.pairs_of(members, links).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 3, 0.5)


def test_bitmaps_never_rule_out_a_pair_that_shares_enough():
    rng = np.random.default_rng(6)
    for n in (1, 3, 16, 17, 90, 700):
        for share in (0.0, 0.2, 0.6, 1.0):
            for m in (n, 2 * n, 5 * n):
                common = rng.integers(0, 2**63, int(share * n)).astype(np.uint64)
                x, y = (np.unique(np.concatenate((common, rng.integers(0, 2**63, k - len(common)).astype(np.uint64)))) for k in (n, m))
                bits = [np.frombuffer(neardup.bitmap(z), np.uint8)[None] for z in (x, y)]
                most = neardup.most_shared(np.array([len(x)]), np.array([len(y)]), *bits)[0]
                assert len(np.intersect1d(x, y)) <= most <= (len(x) + len(y)) // 2
    x, y = (np.unique(rng.integers(0, 2**63, 500).astype(np.uint64)) for _ in range(2))
    assert neardup.most_shared(np.array([500]), np.array([500]), *(np.frombuffer(neardup.bitmap(z), np.uint8)[None] for z in (x, y)))[0] < 0.5 * 1000 / 1.5
