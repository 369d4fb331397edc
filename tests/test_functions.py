import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codexlake.functions import scoring, stemming, text, vector
from codexlake.operators.citing import classified


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("query", "name", "want"), [("word", "two words", 0.8), ("einstien", "Albert Einstein", 5 / 9), ("newt", "Isaac Newton", 0.8), ("zzzz", "Isaac Newton", 0.0), ("ww2", "World War II", 0.25), ("x", "", 0.0)])
def test_word_similarity_golden(spark, query, name, want):
    assert one(spark, text.word_similarity(F.lit(query), F.lit(name))) == pytest.approx(want)


def test_significant_words_split_at_accents(spark):
    assert one(spark, text.significant_words(F.lit("Naïve Garden of the GARDENS, café-Éclairs"))) == ["garden", "gardens", "cafe", "clairs"]


def test_overlap_of_empty_sets_is_zero(spark):
    assert one(spark, text.word_overlap(F.array().cast("array<string>"), F.array(F.lit("a")))) == 0.0


@pytest.mark.parametrize(("overlap", "author", "want"), [(0.6, True, "verified"), (0.6, False, "ambiguous"), (0.59, True, "ambiguous"), (0.45, False, "ambiguous"), (0.44, True, "not_found")])
def test_classification_bounds(spark, overlap, author, want):
    assert one(spark, classified(F.lit(overlap), F.lit(author))) == want


@pytest.mark.parametrize(("high", "medium", "want"), [(0, 0, 1.0), (0, 3, 0.7), (1, 0, 0.7), (0, 5, 0.5), (4, 0, 0.0)])
def test_consensus_from_whole_tenths(spark, high, medium, want):
    notes = F.array(*[F.struct(F.lit(s).alias("severity")) for s in ["high"] * high + ["medium"] * medium + ["low"]])
    assert one(spark, scoring.consensus(notes)) == want


@pytest.mark.parametrize(("n", "d", "want"), [(1, 1, 0.0), (0, 0, 0.0), (5, 1, 0.0), (5, 3, 0.5), (5, 5, 1.0), (5, 9, 1.0)])
def test_entropy_proxy(spark, n, d, want):
    assert one(spark, scoring.entropy_proxy(F.lit(n), F.lit(d))) == want


def test_reciprocal_rank_is_a_double(spark):
    assert one(spark, scoring.reciprocal_rank(F.lit(1))) == 1 / 61


def test_cosine_and_usable(spark):
    assert one(spark, vector.cosine_distance(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(2.0)))) == 1.0
    assert one(spark, vector.cosine_distance(F.array(F.lit(0.0)), F.array(F.lit(2.0)))) is None
    for bad in (F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(float("nan"))), F.lit(None).cast("array<double>")):
        assert one(spark, vector.usable(bad, 2)) is False


@pytest.mark.parametrize(("value", "want"), [("  Great Wall!! of China ", "great-wall-of-china"), ("---", ""), ("É", "")])
def test_slugify(spark, value, want):
    assert one(spark, text.slugify(F.lit(value))) == want


def test_paragraphs_and_surname(spark):
    assert one(spark, text.paragraphs(F.lit("a\n\n\n b \n\n\n\n"))) == ["a", "b"]
    assert one(spark, text.surname(F.lit(" Ada  King "))) == "King"


@given(st.lists(st.sampled_from(["barge", "court", "of", "tower"]), max_size=12))
def test_cover_density_of_one_lexeme_is_the_sum_of_weights(words):
    assert stemming.cover_density(["barg"], [(" ".join(words), 0.4)]) == pytest.approx(0.4 * words.count("barge"))


def test_cover_density_of_two():
    near, far = stemming.cover_density(["court", "tower"], [("court tower", 1.0)]), stemming.cover_density(["court", "tower"], [("court x x x tower", 1.0)])
    assert near == 1.0 and far == pytest.approx(0.25)
    assert stemming.cover_density(["court", "tower"], [("court", 1.0)]) == 0.0


def test_stems():
    assert [stemming.stem(w) for w in ("ponies", "towers", "settled", "running", "glass", "of")] == ["poni", "tower", "settl", "run", "glass", "of"]
