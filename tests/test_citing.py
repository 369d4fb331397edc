import random

from pyspark.sql import functions as F

from codexlake.corpus import Corpus
from codexlake.functions import text
from codexlake.operators import citing


def matches(spark, cited, works):
    citations = spark.createDataFrame(cited, "id long, claimed_source string, claimed_author string")
    return {r.id: (r.work_id, r.status, r.overlap) for r in citing.best_matches(citations, spark.createDataFrame(works, "work_id long, title string, author_families array<string>")).collect()}


def test_words_of_most_titles_make_candidates(spark):
    works = [(i, f"Notes towards a Catalogue of Place{i:03}", [f"Family{i}"]) for i in range(100)] + [(200, "Silver Barges", ["Ordovan"])]
    cited = [(1, "Notes towards a Catalogue of Plaec042", "A. Family42"), (2, "Notes towards a Catalogue", None), (3, "Silver Barges", "Ordovan"), (4, "Gardens", "Family1"), (5, None, "Family1"), (6, "", None)]
    got = matches(spark, cited, works)
    assert got[1] == (0, "ambiguous", 0.75)  # all places overlap alike, and the smaller work goes first, whoever wrote it
    assert got[2] == (0, "ambiguous", 1.0) and got[3] == (200, "verified", 1.0)
    assert {got[i] for i in (4, 5, 6)} == {(None, "not_found", None)}


def test_words_that_meet_often_are_dealt_out_whole(spark, monkeypatch):
    works = [(i, f"Notes towards a Catalogue of Place{i:03}", [f"Family{i:03}"]) for i in range(100)]
    cited = [(i, f"Notes towards a Catalogue of Plaec{i:03}", f"Family{i:03}") for i in range(100)]
    monkeypatch.setattr(citing, "MEETINGS", 500)
    assert matches(spark, cited, works) == {i: (0, "ambiguous" if i else "verified", 0.75) for i in range(100)}


def test_overlaps_lose_no_pair_of_any_sizes(spark):
    rng = random.Random(0)
    words = [f"word{i}" for i in range(12)]
    sets = [[" ".join(sorted(rng.sample(words, rng.choice([1, 2, 3, 5, 7, 9])))) for _ in range(60)] for _ in range(2)]
    sets = [sorted(set(x)) for x in sets]
    got = {(r.claim, r.title): r.overlap for r in citing.overlaps(*(spark.createDataFrame([(x,) for x in xs], f"{name} string") for xs, name in zip(sets, ("claim", "title")))).collect()}
    want = {}
    for a in sets[0]:
        for b in sets[1]:
            x, y = set(a.split()), set(b.split())
            if len(x & y) / min(len(x), len(y)) >= citing.WEAK:
                want[a, b] = len(x & y) / min(len(x), len(y))
    assert got == want


def test_fallback_counts_where_the_first_source_does_not_verify(spark):
    works = spark.createDataFrame([(1, "Silver Barges", ["Ordovan"]), (2, "Copper Wheels Turning", ["Tamsin"])], "work_id long, title string, author_families array<string>")
    other = spark.createDataFrame([(3, "Silver Barges", ["Ordovan"]), (4, "Copper Wheels Turning", ["Marrow"]), (5, "Glass Towers", ["Marrow"])], works.schema)
    cited = spark.createDataFrame([(1, "Silver Barges", "A. Ordovan"), (2, "Copper Wheels Turning", "B. Marrow"), (3, "Glass Towers", None), (4, "Copper Wheels Turning", None), (5, "Nothing", "X")], "id long, claimed_source string, claimed_author string")
    got = {r.id: (r.work_id, r.status, r.via) for r in citing.best_matches(cited, works, other).collect()}
    assert got == {1: (1, "verified", "primary"), 2: (4, "verified", "fallback"), 3: (5, "ambiguous", "fallback"), 4: (2, "ambiguous", "primary"), 5: (None, "not_found", None)}


def test_best_matches_equal_all_pairs(spark, data):
    corpus = Corpus(spark, data)
    citations, works = corpus.citations, corpus.raw("bib_works")
    words = text.significant_words
    held = [(r.work_id, set(r.words), r.author_families or []) for r in works.select("work_id", words(F.col("title")).alias("words"), "author_families").collect()]
    want = {}
    for c in citations.select("id", "claimed_author", words(F.col("claimed_source")).alias("words")).collect():
        ranked = []
        for work_id, title, families in held:
            least = min(len(c.words or ()), len(title))
            overlap = len(title.intersection(c.words)) / least if least else 0.0
            author = c.claimed_author is not None and any(len(f) > 2 and f.lower() in c.claimed_author.lower() for f in families)
            if overlap >= citing.WEAK:
                ranked.append((-overlap, work_id, author and overlap >= citing.STRONG))
        best = min(ranked, default=None)
        want[c.id] = (best[1], "verified" if best[2] else "ambiguous") if best else (None, "not_found")
    assert {r.id: (r.work_id, r.status) for r in citing.best_matches(citations, works).collect()} == want
