import numpy as np
import pytest

from codexlake.llm import spans

SCHEMA = "doc_id bigint, text string, a string, doc string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def brute(rows, length):
    seen, out = {}, set()
    for d, t in rows:
        for i in range(len(t or "") - length + 1):
            seen.setdefault(t[i : i + length], set()).add(d)
    for d, t in set(rows):
        start = end = None
        for i in range(len(t or "") - length + 1):
            if len(seen[t[i : i + length]]) > 1:
                if end is not None and i <= end:
                    end = i + length
                else:
                    if end is not None:
                        out.add((d, start, end))
                    start, end = i, i + length
        if end is not None:
            out.add((d, start, end))
    return out


def rows_of(seed, alphabet="abcdef ÄÖ🙂\n"):
    rng = np.random.default_rng(seed)

    def noise(n):
        return "".join(rng.choice(list(alphabet), n))

    passages = [noise(n) for n in (119, 120, 121, 160, 400)]
    rows = []
    for d in range(40):
        parts = [noise(int(rng.integers(0, 90)))]
        for p in rng.choice(5, 2):
            a = int(rng.integers(0, 30))
            parts += [passages[p][a:] if rng.random() < 0.5 else passages[p], noise(int(rng.integers(0, 60)))]
        rows.append((d, "".join(parts)))
    return rows + [(100, passages[4] * 2), (101, "z" * 300), (102, "z" * 500), (103, "q" * 400), (104, None), (105, ""), (106, rows[0][1]), (107, rows[0][1])]


@pytest.mark.parametrize("shard", [spans.SHARD_CONTEXTS, 2, 0])
def test_equal_to_brute_force(spark, shard):
    rows = rows_of(3)
    got = [tuple(r) for r in spans.shared_spans(table(spark, rows), shard_contexts=shard).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 120)


def test_a_header_of_many_texts_is_spread_over_tasks(spark, monkeypatch):
    rng = np.random.default_rng(6)

    def noise(n):
        return "".join(rng.choice(list("abcdefghij \n"), n))

    header, other = noise(500), noise(200)
    rows = [(d, (header if d % 3 == 0 else "") + noise(130) + (other[: int(rng.integers(100, 200))] if d % 20 == 0 else "")) for d in range(180)]
    rows += [(d, header[:-1] + noise(20)) for d in range(200, 210)] + [(300, header + header), (301, noise(400)), rows[0]]
    want = brute(rows, 120)
    for share in (spans.HOT_SHARE, 1, 10**9):
        monkeypatch.setattr(spans, "HOT_SHARE", share)
        got = [tuple(r) for r in spans.shared_spans(table(spark, rows)).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_shared_anchors_are_found_alike_however_batches_are_cut():
    import pyarrow as pa

    rng = np.random.default_rng(7)
    a = np.sort(rng.integers(-40, 40, 500))
    salt = np.where(a == 5, rng.integers(1, 9, 500), 0)
    columns = {"a": a, "c": rng.integers(0, 3, 500), "doc": rng.integers(0, 4, 500), "first": np.arange(500), "windows": np.ones(500, int), "salt": salt}
    groups = {k: np.flatnonzero(a == k) for k in set(a.tolist())}
    want = {int(i): bool(k == 5 or len(set(columns["c"][at])) > 1) for k, at in groups.items() for i in at if k == 5 or len(set(columns["doc"][at])) > 1}
    for size in (1, 7, 64, 500):
        batches = [pa.RecordBatch.from_pydict({k: pa.array(v[i : i + size]) for k, v in columns.items()}) for i in range(0, 500, size)]
        out = pa.Table.from_batches(list(spans._met(iter(batches)))).to_pylist()
        assert len(out) == len(want) and {r["first"]: r["parts"] for r in out} == want


def test_repeated_rows_share_nothing_with_themselves(spark):
    text = "".join(np.random.default_rng(0).choice(list("abcdefgh"), 300))
    assert spans.shared_spans(table(spark, [(1, text), (1, text), (2, "x" * 200)])).collect() == []
    assert {tuple(r) for r in spans.shared_spans(table(spark, [(1, text), (1, text), (2, "yy" + text)])).collect()} == {(1, 0, 300), (2, 2, 302)}


def test_long_texts_fall_into_pieces(spark, monkeypatch):
    rng = np.random.default_rng(5)
    text = "".join(rng.choice(list("abcdefghij"), 3000))
    monkeypatch.setattr(spans, "PIECE", 250)
    monkeypatch.setattr(spans, "CHUNK", 300)
    found = list(spans._pieces([text], [7], 120))
    assert all(len(codes) <= 369 for codes, *_ in found) and sum(len(codes) - 119 for codes, *_ in found) == 3000 - 119
    rows = [(1, text * 30), (2, text[100:400])]
    assert {tuple(r) for r in spans.shared_spans(table(spark, rows)).collect()} == brute(rows, 120)


def test_portion_and_empty(spark):
    text = "".join(np.random.default_rng(1).choice(list("abcdefgh"), 200))
    df = table(spark, [(1, text), (2, text + "-tail" * 40), (3, None), (None, text)])
    got = {r.doc_id: (r.n_chars, r.n_spans, r.shared_chars, r.shared_share) for r in spans.shared_portion(df, spans.shared_spans(df)).collect()}
    assert got == {1: (200, 1, 200, 1.0), 2: (400, 1, 200, 0.5), 3: (0, 0, 0, 0.0)}
    assert spans.shared_spans(table(spark, [])).collect() == []
    with pytest.raises(ValueError):
        spans.shared_spans(df, length=10)


def test_automaton_knows_documents():
    auto = spans.Automaton()
    for text, d in (("abcabcx", 1), ("zabcab", 2), ("qqqqqq", 3)):
        auto.add(text, d, d)
    auto.finish()
    assert auto.shared("abcabcx", 4) == [(0, 1)] and auto.shared("zabcab", 4) == [(1, 2)] and auto.shared("qqqqqq", 3) == []
