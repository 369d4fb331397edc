import itertools

import pytest

from codexlake.functions import stemming
from codexlake.operators import search

# Published pairs of the algorithm, and words of each of its steps.
PAIRS = dict(zip(*[iter("""
consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistently consist
consolation consol consolatory consolatori consoles consol consolidating consolid consolingly consol consonant conson consorting consort conspicuously conspicu
conspiracy conspiraci conspirators conspir constables constabl constancy constanc knack knack knackeries knackeri knavish knavish kneaded knead knees knee kneel kneel
knelt knelt knightly knight knitted knit knives knive knobs knob knocker knocker knopp knopp knots knot
ties tie cries cri dying die skies sky news news succeed succeed gas gas this this kiwis kiwi gaps gap us us happy happi say say by by cry cri
hopping hop hoping hope agreed agre feed feed plastered plaster bled bled motoring motor sing sing conflated conflat troubling troubl sized size falling fall fizzed fizz
relational relat conditional condit rational ration valency valenc hesitancy hesit digitizer digit conformably conform radically radic differently differ
vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formality formal sensitivity sensit
triplicate triplic formative format formalize formal electrical electr goodness good revival reviv adjustable adjust defensible defens adoption adopt effective effect
generously generous communication communic arsenal arsenal controlling control rolling roll barges barg barging barg courtly court
""".split())] * 2))

# Text of the fields name, short description and summary; asked stems; rank. Worked out by hand: a cover of k words with
# weights w and m other positions inside gives k / sum(1 / w) / (1 + m).
CASES = [
    (("Barge", "", ""), "barge", 1.0),
    (("", "barge", ""), "barge", 0.4),
    (("", "", "barge"), "barge", 0.2),
    (("Barges", "barge", "barging"), "barge", 1.6),
    (("Boat", "", ""), "barge", 0.0),
    (("", "", ""), "barge", 0.0),
    ((None, None, None), "barge", 0.0),
    ((None, "barge", None), "barge", 0.4),
    (("Court barge", "", ""), "barge court", 1.0),
    (("Court of barge", "", ""), "barge court", 0.5),
    (("Court x y barge", "", ""), "barge court", 1 / 3),
    (("", "court barge", ""), "barge court", 0.4),
    (("", "", "court barge"), "barge court", 0.2),
    (("Court", "barge", ""), "barge court", 2 / (1 + 2.5)),
    (("Court", "", "barge"), "barge court", 2 / (1 + 5)),
    (("Court of the", "barge", ""), "barge court", 2 / (1 + 2.5)),
    (("Court x", "barge", ""), "barge court", 2 / 3.5 / 2),
    (("Court", "the barge", ""), "barge court", 2 / 3.5 / 2),
    (("court barge court", "", ""), "barge court", 2.0),
    (("court court barge", "", ""), "barge court", 1.0),
    (("barge court x x court barge", "", ""), "barge court", 2.0),
    (("court barge mill", "", ""), "barge court mill", 1.0),
    (("court barge court mill", "", ""), "barge court mill", 1.0),
    (("court mill x barge court", "", ""), "barge court mill", 1 / 2 + 1 / 2),
    (("court barge", "", ""), "barge court mill", 0.0),
    (("barge barge", "", ""), "barge barges", 2.0),
    (("the of", "", ""), "the of", 0.0),
    (("barge", "", ""), "the of", 0.0),
    (("barge", "", ""), "", 0.0),
    (("court-barge", "", ""), "barge court", 1.0),
    (("court-barge", "", ""), "court-barge", 1.0),
    (("court barge", "", ""), "court-barge", 0.0),
    (("BARGING", "", ""), "Barge!", 1.0),
    (("barge" + " x" * 40 + " court", "", ""), "barge court", 1 / 41),
    (("barge's court", "", ""), "barge court", 1 / 2),
    (("3.5 barges", "", ""), "3.5", 1.0),
    (("3.5 barges", "", ""), "3 5", 0.0),
]


@pytest.mark.parametrize(("word", "want"), PAIRS.items())
def test_stems_of_the_published_algorithm(word, want):
    assert stemming.stem(word) == want


def test_a_hint_stands_in_every_word_of_its_stem():
    endings = ("", "s", "es", "ed", "ing", "ly", "ness", "ation", "ational", "ization", "ity", "iveness", "fulness", "ously", "ility", "y", "ies", "er", "ement", "able")
    for word, ending in itertools.product(PAIRS, endings):
        made = word.rstrip("ey") + ending
        assert stemming.hint(stemming.stem(made)) in made


def test_positions_go_on_behind_the_last_lexeme_of_a_field():
    got = stemming.positions([("The Silver Barges of the", 1.0), ("the barge", 0.4), (None, 0.2), ("a well-known silver", 0.2)])
    assert got == {"silver": [(2, 1.0), (10, 0.2)], "barg": [(3, 1.0), (5, 0.4)], "well-known": [(7, 0.2)], "well": [(8, 0.2)], "known": [(9, 0.2)]}


def test_positions_are_bounded():
    got = stemming.positions([("barge " * 300 + "x " * 17_000 + "court", 1.0)])
    assert len(got["barg"]) == stemming.MAX_POSITIONS and got["court"] == [(stemming.LAST_POSITION, 1.0)]


@pytest.mark.parametrize(("fields", "query", "want"), CASES)
def test_cover_density(fields, query, want):
    assert stemming.cover_density(sorted(set(stemming.stems(query))), list(zip(fields, search.WEIGHTS.values()))) == pytest.approx(want)


def test_text_ranks_of_a_table_equal_the_golden_ones(spark):
    for query in ("barge", "barge court", "barge court mill", "the of", "court-barge"):
        rows = [(f"{i:02}", *fields) for i, (fields, q, _) in enumerate(CASES) if q == query]
        table = spark.createDataFrame(rows, "id string, canonical_name string, short_description string, summary string")
        want = [(i, round(w, 6)) for (i, *_), w in zip(rows, (w for _, q, w in CASES if q == query)) if w > 0]
        got = [tuple(r) for r in search.text_ranked(table, query).collect()]
        assert got == sorted(want, key=lambda r: (-r[1], r[0]))


def test_search_text_holds_every_lexeme(spark):
    table = spark.createDataFrame([("a", "Silver Barges", None, "The barge sank"), ("b", "", "of", None)], "id string, canonical_name string, short_description string, summary string")
    got = {(r.id, r.lexeme): [tuple(p) for p in r.places] for r in search.search_text(table).collect()}
    assert got == {("a", "silver"): [(1, 1.0)], ("a", "barg"): [(2, 1.0), (4, 0.2)], ("a", "sank"): [(5, 0.2)]}


def test_ranks_of_one_scan_go_to_python_only_where_a_stem_may_stand(spark, data):
    from codexlake.corpus import Corpus

    plan = search.text_ranked(Corpus(spark, data).published, "barges")._jdf.queryExecution().toString()
    assert "Contains" in plan or "contains" in plan
