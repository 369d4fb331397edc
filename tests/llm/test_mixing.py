from codexlake.llm import mixing

RECORDS = "id bigint, source string, size bigint, copies int, hash string"
TARGETS = "source string, target_share double, max_repeats int, size int"


def run(spark, records, targets, **kw):
    copies, shares = mixing.mix(spark.createDataFrame([(*r, 0, "") for r in records], RECORDS), spark.createDataFrame([(*t, 0) for t in targets], TARGETS), **kw)
    return [r.asDict() for r in copies.collect()], {r.source: r.asDict() for r in shares.collect()}


def test_budgets_caps_and_shares(spark):
    records = [(i, "a", 10) for i in range(600)] + [(i, "b", 7) for i in range(1000, 1050)] + [(i, "c", 3) for i in range(2000, 2100)] + [(1, None, 5), (None, "a", 10), (9000, "b", None)]
    targets = [("a", 0.5, 1), ("b", 0.4, 3), ("gone", 0.1, 2)]
    copies, shares = run(spark, records, targets)
    total = sum(r[2] or 0 for r in records)
    drawn = {s: sum(c["size"] * c["copies"] for c in copies if c["source"] == s) for s in ("a", "b", "c")}
    assert drawn["c"] == 0 and shares["c"]["actual_share"] == 0 and shares[None]["drawn"] == 0
    assert total * 0.5 - 10 < drawn["a"] <= total * 0.5
    assert drawn["b"] == 350 * 3 and all(c["copies"] == 3 for c in copies if c["source"] == "b")
    assert shares["gone"]["drawn"] == 0 and shares["gone"]["wanted"] == int(total * 0.1)
    assert abs(sum(s["actual_share"] for s in shares.values()) - 1) < 1e-9
    assert {s: shares[s]["drawn"] for s in drawn} == drawn


def test_budgets_nest(spark):
    records, targets = [(i, "a", 1 + i % 13) for i in range(3000)], [("a", 1.0, 1)]
    before = set()
    for size in (10, 500, 5000, 15000):
        copies, _ = run(spark, records, targets, total_size=size)
        now = {c["id"] for c in copies}
        assert before <= now and size - 13 < sum(c["size"] for c in copies) <= size
        before = now


def test_repeated_rows_and_empty_tables(spark):
    copies, shares = run(spark, [(1, "a", 4)] * 5, [("a", 1.0, 1)], total_size=10)
    assert copies == [] or sum(c["size"] * c["copies"] for c in copies) <= 10
    assert run(spark, [], []) == ([], {})
    copies, shares = run(spark, [], [("a", 1.0, 1)])
    assert copies == [] and shares["a"]["actual_share"] == 0
    copies, _ = run(spark, [(1, "a", 4)], [])
    assert copies == []
