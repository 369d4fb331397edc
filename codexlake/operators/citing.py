"""Matching of citations to candidate works by word overlap, and the tally of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexlake.functions import scoring, text
from codexlake.runtime import staged

# The shares of common words from which a match is strong or weak.
STRONG, WEAK = 0.6, 0.45
#: A word is dealt to one more task for each so many pairs of sets that meet in it.
MEETINGS = 250_000


def classified(overlap: Column, author_matches: Column) -> Column:
    return F.when((overlap >= STRONG) & author_matches, "verified").when(overlap >= WEAK, "ambiguous").otherwise("not_found")


def _places(sets: DataFrame, name: str, meetings: DataFrame) -> DataFrame:
    """(name, n, word, salts, rare): the words of each set that the other side has too; rare says that the word is one
    of the set's n - least + 1 that meet least often, of which a set with `least` common words must hold one."""
    least = F.ceil(F.col("n") * F.lit(WEAK) - F.lit(1e-9))
    rows = sets.select(name, F.explode("words").alias("word")).join(meetings, "word", "left")
    rows = rows.groupBy(name).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("met", F.lit(0)).alias("met"), "word"))).alias("words"))
    rows = rows.select(name, F.size("words").alias("n"), F.posexplode("words").alias("place", "w")).filter("w.met > 0")
    return rows.select(name, "n", "w.word", F.ceil(F.col("w.met") / MEETINGS).cast("int").alias("salts"), (F.col("place") <= F.col("n") - least).alias("rare"))


def overlaps(claims: DataFrame, titles: DataFrame) -> DataFrame:
    """(claim, title, overlap) of the sets of words that share WEAK of the smaller one's words or more.

    claims: (claim), titles: (title), each a set's sorted words with spaces between, once. Words are put in one order
    by how often the two sides meet in them; whatever the pair, the smaller set's rarest words include a common one, so
    only these are joined, with all words of the other side, and no pair is lost. Words that meet often are salted.
    """
    asked = claims.select("claim", F.split("claim", " ").alias("words"))
    held = titles.select("title", F.split("title", " ").alias("words"))
    often = asked.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("cf"))
    meetings = often.join(held.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df")), "word").select("word", (F.col("cf") * F.col("df")).alias("met"))
    left = _places(asked, "claim", meetings).withColumn("salt", F.pmod(F.xxhash64("claim"), F.col("salts")).cast("int")).drop("salts").withColumnsRenamed({"n": "a", "rare": "rare_a"})
    right = _places(held, "title", meetings).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts").withColumnsRenamed({"n": "b", "rare": "rare_b"})
    left, right = staged(left, "claim-words"), staged(right, "title-words")
    one = left.filter("rare_a").join(right, ["word", "salt"]).filter("a <= b")
    two = left.join(right.filter("rare_b"), ["word", "salt"]).filter("a > b")
    met = one.select("claim", "title").unionByName(two.select("claim", "title")).distinct()
    x, y = F.split("claim", " "), F.split("title", " ")
    return met.select("claim", "title", (F.size(F.array_intersect(x, y)) / F.least(F.size(x), F.size(y))).alias("overlap")).filter(F.col("overlap") >= WEAK)


def candidates(citations: DataFrame, works: DataFrame) -> DataFrame:
    """Citations with all works whose titles overlap with theirs by WEAK or more: a join on words, not on all pairs.

    Equal sets of words are compared once; titles and sources without significant words have no candidates.
    """
    def worded(df: DataFrame, of: str, name: str) -> DataFrame:
        return df.withColumn(name, F.array_join(F.sort_array(text.significant_words(F.col(of))), " ")).filter(F.col(name) != "")

    works = staged(worded(works, "title", "words").select("work_id", "words", "author_families"), "works")
    cited = staged(worded(citations, "claimed_source", "claim").select("id", "claim", "claimed_author"), "cited")
    near = overlaps(cited.select("claim").distinct(), works.select(F.col("words").alias("title")).distinct()).withColumnRenamed("title", "words")
    return near.join(cited, "claim").join(works, "words")


def best_of_source(citations: DataFrame, works: DataFrame) -> DataFrame:
    """(id, work_id, status, overlap, confidence) of citations with a candidate: that of greatest overlap, of equals the
    smaller work_id."""
    scored = candidates(citations, works).withColumn("author_matches", scoring.author_named(F.col("claimed_author"), F.col("author_families")))
    scored = scored.withColumn("status", classified(F.col("overlap"), F.col("author_matches")))
    scored = scored.withColumn("confidence", F.least(F.lit(1.0), F.col("overlap") * F.when(F.col("author_matches"), 1.0).otherwise(0.7)))
    best = F.max_by(F.struct("work_id", "status", "overlap", "confidence"), F.struct("overlap", (-F.col("work_id")).alias("first")))
    return scored.groupBy("id").agg(best.alias("best")).select("id", "best.*")


def best_matches(citations: DataFrame, works: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """(id, work_id, status, overlap, confidence, via), a row for each citation; those without a candidate are not_found.

    citations: (id, claimed_source, claimed_author); works, fallback: (work_id, title, author_families). A verified
    match of the first source stands; else the stronger of both sources' best counts: verified before ambiguous, then
    greater confidence, then the first source. Null, empty or wordless titles and sources match nothing; a null author
    never verifies; repeated rows of a work count once; empty tables give not_found or no rows; other columns are
    ignored.
    """
    found = best_of_source(citations, works).withColumn("via", F.lit("primary"))
    if fallback is not None:
        other = best_of_source(citations.join(found.filter("status = 'verified'").select("id"), "id", "left_anti"), fallback)
        rank = F.struct((F.col("status") == "verified").alias("sure"), F.round("confidence", 9).alias("confidence"), (F.col("via") == "primary").alias("first"))
        both = found.unionByName(other.withColumn("via", F.lit("fallback")))
        found = both.groupBy("id").agg(F.max_by(F.struct("work_id", "status", "overlap", "confidence", "via"), rank).alias("best")).select("id", "best.*")
    return citations.select("id").join(found, "id", "left").withColumn("status", F.coalesce("status", F.lit("not_found")))


def tally(results: DataFrame) -> DataFrame:
    """(status, n, percent)."""
    counted = results.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    whole = counted.agg(F.sum("n").alias("whole"))
    return counted.join(F.broadcast(whole)).select("status", "n", F.round(F.col("n") * 100.0 / F.col("whole"), 4).alias("percent"))
