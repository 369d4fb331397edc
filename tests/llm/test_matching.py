import pytest

from codexlake.llm import matching

CLAIMS = "citation_id bigint, source string, author string, work_id string, confidence string"
WORKS = "work_id bigint, title string, families array<string>, year int, key string, chunk string"
CATALOGUE = [
    (1, "The Humid Tunnels of Korukirack", ["Mirubin", "Grenudek"], 1951),
    (2, "A History of Volentifell and its Ballads", ["Valagni"], 1989),
    (3, "Notes towards a Catalogue of the Nelovaia Dikes, Volume III", ["Velelis"], 1915),
    (4, "Notes towards a Catalogue of the Nelovaia Dikes, Volume II", ["Velelis"], 1915),
    (5, "Studies in Isazuley Roads: Gradual Evidence from Corudaros", ["Emuller"], 1948),
    (6, "A History of Twinstead and its Mills", ["Harbin"], 1900),
    (7, "A History of Twinstead and its Mills", ["Zelkova"], 1950),
    *((100 + i, f"A History of Place{chr(97 + i % 26)}{chr(97 + i // 26)}vik and its Ports", [f"Family{i}"], 1900) for i in range(60)),
]
CASES = [
    ("the humid tunnels of korukirack", None, 1),
    ("“Humid Tunels of Korukirack”, 2nd ed.", "Dr. A. Mirubin & Q. Other", 1),
    ("The Humid Tunnels of Korukirack", "Grenduek, Z. et al.", 1),
    ("The Humid Tunnels of Korukirack", "Somebody Else", None),
    ("A Hist. of Volentifell & its Ballads (1989)", "VALAGNI, F.", 2),
    ("and its Ballads, A History of Volentifell", None, 2),
    ("A History of Volentifell and its Ballads, Journal of Bell Studies 4", "Valagni", 2),
    ("Notes towards a Catalogue of the Nelovaia Dikes (vol. 3)", "Velelis", 3),
    ("notes towards a catalogue of the nelovaia dikes, volume ii", None, 4),
    ("Notes towards a Catalogue of the Nelovaia Dikes", "Velelis", None),
    ("Studies in Isazuley Roads", "Emuller", 5),
    ("A History of Twinstead and its Mills", "Zelkova, B.", 7),
    ("A History of Twinstead and its Mills (1900)", None, 6),
    ("A History of Twinstead and its Mills", None, None),
    ("A History of Nowhereton", "Valagni", None),
    ("Regional archive", None, None),
    ("", None, None),
    (None, "Valagni", None),
    ("!!!", " ", None),
    ("word " * 5000, None, None),
]


def run(spark, cases, catalogue=CATALOGUE, **kw):
    claims = spark.createDataFrame([(i, s, a, "x", "y") for i, (s, a, *_) in enumerate(cases)] + [(0, *cases[0][:2], "z", "z"), (None, "The Humid Tunnels of Korukirack", None, "", "")], CLAIMS)
    works = spark.createDataFrame([(*w, "x", "y") for w in catalogue], WORKS)
    rows = matching.match(claims, works, **kw).collect()
    assert len({r.citation_id for r in rows}) == len(rows) and all(0 < r.confidence <= 1 for r in rows)
    return {r.citation_id: r.work_id for r in rows}


@pytest.mark.parametrize("chunk_keys", [200_000, 40])
def test_cases(spark, chunk_keys):
    got = run(spark, CASES, [*CATALOGUE, (None, "x y z", None, None), (900, None, ["A"], 1), (901, "", None, None)], chunk_keys=chunk_keys)
    assert {i: got.get(i) for i in range(len(CASES))} == {i: w for i, (_, _, w) in enumerate(CASES)}


@pytest.mark.parametrize("chunk_keys", [200_000, 40])
def test_long_runs_of_equal_keys_are_compared_whole(spark, chunk_keys):
    volumes = [(1000 + i, f"Annals of the Orusel Bells, Volume {i}", ["Ordovan"], 1900) for i in range(1, 31)]
    same = [(2000 + i, "A Survey of Mirrored Canals", [f"Holder{chr(97 + i)}son"], 1900) for i in range(20)]
    cases = [(f"Annals of the Orusel Bells, Volume {i}", "Ordovan", 1000 + i) for i in (1, 7, 18, 30)] + [("A Survey of Mirrored Canals", f"Holdr{chr(97 + i)}son", 2000 + i) for i in (0, 9, 19)]
    got = run(spark, cases, [*CATALOGUE, *volumes, *same], chunk_keys=chunk_keys)
    assert {i: got.get(i) for i in range(len(cases))} == {i: w for i, (_, _, w) in enumerate(cases)}


def test_confidences_do_not_depend_on_chunks(spark):
    works = [*CATALOGUE, *((3000 + i, f"The {a} {b} of Place{chr(97 + i % 26)}rook", ["Ordovan"], 1900 + i) for i, (a, b) in enumerate((x, y) for x in ("Silver", "Copper", "Glass") for y in ("Barges", "Dikes", "Mills", "Canals")))]
    cases = [(t.replace("Barges", "Bargse"), f[0], None) for _, t, f, _ in works] + [(t, None, None) for _, t, _, _ in works]
    claims = spark.createDataFrame([(i, s, a, "x", "y") for i, (s, a, _) in enumerate(cases)], CLAIMS)
    table = spark.createDataFrame([(*w, "x", "y") for w in works], WORKS)
    got = [{(r.citation_id, r.work_id): r.confidence for r in matching.match(claims, table, chunk_keys=n).collect()} for n in (200_000, 100, 30)]
    assert len(got[0]) > 100 and got[0] == got[1] == got[2]


def test_long_sources_have_short_keys(spark):
    long = " ".join(f"word{i}" for i in range(3000))
    assert max(map(len, matching.Title(long).keys(["ordovan"]))) < 200
    assert run(spark, [(long, "Ordovan"), (long + " Silver Barges", None)], [(1, long, ["Ordovan"], 1900), (2, "Silver Barges", ["X"], 1900)])[0] == 1


def best_total(pairs):
    def best(rows, taken):
        if not rows:
            return 0.0
        (c, own), rest = rows[0], rows[1:]
        return max([best(rest, taken)] + [w + best(rest, taken | {x}) for x, w in own if x not in taken])

    own = {}
    for c, x, w in pairs:
        own.setdefault(c, []).append((x, w))
    return best(sorted(own.items()), frozenset())


def test_assignment_has_the_greatest_total_where_greedy_loses(spark):
    import random

    schema = "citation_id bigint, work_id bigint, confidence double"
    greedy_loses = [(1, 10, 0.95), (1, 11, 0.9), (2, 10, 0.94)]
    got = {(r.citation_id, r.work_id) for r in matching.assigned(spark.createDataFrame(greedy_loses, schema)).collect()}
    assert got == {(1, 11), (2, 10)}
    rng = random.Random(5)
    pairs = [(c, w, round(rng.uniform(0.3, 1), 3)) for c in range(9) for w in rng.sample(range(7), 3)]
    rows = matching.assigned(spark.createDataFrame([*pairs, (None, 1, 1.0), (1, None, 1.0)], schema)).collect()
    assert len({r.citation_id for r in rows}) == len({r.work_id for r in rows}) == len(rows)
    assert sum(r.confidence for r in rows) >= best_total(pairs) - matching.BID * len(rows)
    assert matching.assigned(spark.createDataFrame([], schema)).collect() == []


def test_one_to_one_gives_each_work_once(spark):
    cases = [("The Humid Tunnels of Korukirack", "Mirubin", 1), ("The Humid Tunels of Korukirack", "Mirubin", 1), ("A History of Volentifell and its Ballads", "Valagni", 2)]
    got = run(spark, cases, one_to_one=True)
    assert got == {0: 1, 2: 2}


def test_empty_sides(spark):
    assert run(spark, CASES, []) == {}
    claims = spark.createDataFrame([], CLAIMS)
    works = spark.createDataFrame([(*w, "x", "y") for w in CATALOGUE], WORKS)
    assert matching.match(claims, works).collect() == []


@pytest.mark.parametrize(("a", "b", "want"), [("mirubin", "mirbin", True), ("mirubin", "mriubin", True), ("mirubin", "mirubinn", True), ("mirubin", "marubin", True), ("mirubin", "marubim", False), ("abc", "abd", False), ("abcd", "badc", False)])
def test_one_slip(a, b, want):
    assert matching.alike(a, b) is want and matching.alike(b, a) is want


def test_roman_numbers():
    assert [matching.number_of(x) for x in ("I", "iv", "IX", "12", "XL")] == [1, 4, 9, 12, 40]
