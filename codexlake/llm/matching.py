"""Matching records of two tables that share no key: sorted neighbourhood over several composite keys.

Each record of either side has several sort keys: its title words in alphabetical order, begun at each of them in turn,
and each author's surname before them. All keys of the catalogue are sorted together; a citation is compared with the
catalogue's neighbours of each of its keys, by weighted similarities of title, volume, author and year.
"""

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codexlake.runtime import bounded_sample, discarded, parallelism, staged

WINDOW = 6
#: Keys of the catalogue in one chunk, and of citations in one task; chunks at most; rows sampled to place their bounds.
CHUNK_KEYS, GROUP_KEYS, MAX_CHUNKS, SAMPLE_ROWS = 200_000, 200_000, 16_384, 20_000
#: Words of a key, so that keys of long titles stay short; titles are compared whole.
KEY_WORDS = 16
#: What a bid in the assignment adds; the total is at most this much a match below the greatest.
BID = 0.001
#: Shares of the confidence; what a citation leaves out goes to the title.
AUTHOR_WEIGHT, YEAR_WEIGHT = 0.25, 0.05
MIN_TITLE, MIN_TITLE_ALONE = 0.62, 0.8
MIN_CONFIDENCE = 0.68
#: What a word counts: one in more than COMMON_SHARE of the titles less than a rare one, a short word little; slips and a missing subtitle cost a little.
COMMON_SHARE, COMMON_WORTH, SHORT_WORD_WORTH, FUZZY_WORTH, MAIN_TITLE_WORTH = 0.003, 0.5, 0.15, 0.9, 0.95

# Words of titles that tell little, honorifics, volume words, and the tails of a reference.
SHORT_WORDS = frozenset("a an and at by for from in into its it of on or our the their this to towards under upon with".split())
TITLES = frozenset("dr prof mr mrs ms sir st et al and others ed eds".split())
VOLUME = re.compile(r"[\s,(]*\b(?:vol(?:ume)?s?\.?|bd\.?|tome)\s*([ivxlc]+|\d+)\b\)?", re.I)
EDITION = re.compile(r",?\s*\b(?:\d+(?:st|nd|rd|th)|rev(?:ised)?\.?|first|second|third)\s+ed(?:ition|n)?\b\.?", re.I)
JOURNAL = re.compile(r",\s*(?:journal|proceedings|annals|transactions|bulletin|review)\s+of\b.*$", re.I)
YEAR = re.compile(r"[\s,]*\((\d{3,4})\)\s*")
WORD = re.compile(r"[^\W_]+\.?")
SPAN_OF_YEARS = re.compile(r"\b(\d{3,4})[^\W\d_](\d{3,4})\b")
SPLIT = re.compile(r"\s*(?:;|&|\band\b|,)\s*", re.I)
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}


def folded(text: str) -> str:
    """Lower case without accents."""
    text = unicodedata.normalize("NFKD", text.casefold())
    return "".join(c for c in text if not unicodedata.combining(c)).replace("ø", "o").replace("ł", "l").replace("đ", "d")


def number_of(text: str) -> int:
    if text.isdigit():
        return int(text)
    values = [_ROMAN[c] for c in text.lower()]
    return sum(-v if values[i + 1 : i + 2] and v < values[i + 1] else v for i, v in enumerate(values))


class Title:
    """A title's words that tell, its short words, volume and year; main is the title before a colon, if there is one."""

    __slots__ = ("base", "key_words", "main", "short", "total", "volume", "words", "worths", "year")

    def __init__(self, text: str | None, main: bool = False):
        text = folded(text or "")
        years = YEAR.findall(text)
        text = JOURNAL.sub("", EDITION.sub("", YEAR.sub(" ", text)))
        volumes = VOLUME.findall(text)
        text = SPAN_OF_YEARS.sub(r"\1 \2", VOLUME.sub(" ", text)).replace("&", " and ")
        found = WORD.findall(text)
        self.year = int(years[-1]) if years else None
        self.volume = number_of(volumes[-1]) if volumes else None
        self.words = Counter(w if w.endswith(".") and 2 < len(w) < 7 else w.rstrip(".") for w in found if w.rstrip(".") not in SHORT_WORDS)
        self.short = Counter(w.rstrip(".") for w in found if w.rstrip(".") in SHORT_WORDS)
        self.base = {w: w.rstrip(".") for w in self.words}
        self.worths: dict[str, float] | None = None
        self.total = 0.0
        self.key_words = sorted(set(self.base.values()))
        self.main = Title(text.split(":")[0]) if main and ":" in text else None
        if self.main:
            self.main.volume = self.volume

    def keys(self, surnames: list[str]) -> list[str]:
        words = self.key_words
        turned = [" ".join((words[i : i + KEY_WORDS] + words[: max(0, i + KEY_WORDS - len(words))])[: len(words)]) for i in range(len(words))]
        return turned + [" ".join([s, *words[:KEY_WORDS]]) for s in surnames] + (self.main.keys(surnames) if self.main else [])

    def weighed(self, worth: dict[str, float]) -> dict[str, float]:
        """The worth of each word; a title is always weighed by the same worths."""
        if self.worths is None:
            self.worths = {w: worth.get(base, 1.0) for w, base in self.base.items()}
            self.total = sum(self.worths[w] * n for w, n in self.words.items()) + SHORT_WORD_WORTH * sum(self.short.values())
        return self.worths


def alike(a: str, b: str) -> bool:
    """At most one slip apart: a letter changed, missing or too many, or two neighbours swapped; short words must be equal."""
    if a == b:
        return True
    if (a[:1] != b[:1] and a[-1:] != b[-1:]) or min(len(a), len(b)) < 4 or abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def _rest(a: Counter, b: Counter) -> list[str]:
    """The words of a beyond those of b."""
    return [w for w, n in a.items() for _ in range(n - b.get(w, 0))]


def title_similarity(a: Title, b: Title, worth: dict[str, float]) -> float:
    """Weighted Dice similarity of the words, each used once, with slips and abbreviations; 0 between different volumes.

    One title is always compared under the same worth of words. Words one slip apart agree in their first or last letter.
    """
    if a.volume != b.volume:
        return 0.0
    left_worth, right_worth = a.weighed(worth), b.weighed(worth)
    whole = a.total + b.total
    met, common = 0.0, 0
    for w, n in a.words.items():
        m = b.words.get(w)
        if m:
            n = min(n, m)
            met += 2 * left_worth[w] * n
            common += n
    for w, n in a.short.items():
        m = b.short.get(w)
        if m:
            met += 2 * SHORT_WORD_WORTH * min(n, m)
    if common < a.words.total() and common < b.words.total():
        right = _rest(b.words, a.words)
        for x in _rest(a.words, b.words):
            base = a.base[x]
            first, last = base[0], base[-1]
            for y in right:
                other = b.base[y]
                if first != other[0] and last != other[-1]:
                    continue
                if (x[-1] == "." and y.startswith(base)) or (y[-1] == "." and x.startswith(other)):
                    share = 1.0
                elif alike(base, other):
                    share = FUZZY_WORTH
                else:
                    continue
                met += share * (left_worth[x] + right_worth[y])
                right.remove(y)
                break
    similar = min(1.0, met / whole) if whole else 0.0
    return max(similar, MAIN_TITLE_WORTH * title_similarity(a, b.main, worth)) if b.main else similar


def people(text: str | None) -> list[str]:
    """The names' words in a claimed author: no initials, honorifics or et al."""
    return [w for part in SPLIT.split(folded(text or "")) for w in (x.rstrip(".") for x in WORD.findall(part)) if len(w) > 2 and w not in TITLES]


def confidence(title: Title, names: list[str], named: bool, work: Title, families: list[str], year: int | None, worth: dict[str, float]) -> float:
    """0 if the title is too far off, or an author is named and none is the work's."""
    exact = any(f in names for f in families)
    if named and not exact and not any((n[0] == f[0] or n[-1] == f[-1]) and alike(n, f) for n in names for f in families):
        return 0.0
    similar = title_similarity(title, work, worth)
    if similar < (MIN_TITLE if named else MIN_TITLE_ALONE):
        return 0.0
    author = (AUTHOR_WEIGHT, 1.0 if exact else 0.9) if named else (0.0, 0.0)
    when = (YEAR_WEIGHT, max(0.0, 1 - abs(title.year - year) / 4)) if title.year and year else (0.0, 0.0)
    return (1 - author[0] - when[0]) * similar + author[0] * author[1] + when[0] * when[1]


def _families(names: list[str] | None) -> list[str]:
    return [f for f in (folded(n) for n in names or () if n) if f]


def match(citations: DataFrame, works: DataFrame, *, window: int = WINDOW, min_confidence: float = MIN_CONFIDENCE, chunk_keys: int = CHUNK_KEYS, one_to_one: bool = False) -> DataFrame:
    """(citation_id, work_id, confidence): at most one work for each citation, the one of highest confidence.

    citations: (citation_id BIGINT, source, author); works: (work_id BIGINT, title, families ARRAY<STRING>, year INT);
    other columns are ignored. A work may be cited any number of times, so the assignment of greatest total confidence
    gives each citation its best work; with one_to_one a work goes to one citation only, see assigned(). Of equals the
    smaller work_id counts, unless a citation without an author or year fits works of different authors equally, which
    then decide nothing and give no row. Null or empty sources match nothing; a null or blank author is not held
    against a work; null ids are left out; repeated rows of a citation give one row a work; an empty table gives an
    empty result. Citations that claim the same are matched once. A word's worth comes from the whole catalogue, so
    that confidences do not depend on chunks. The sorted catalogue is dealt to chunks of key ranges, placed by a sample
    of SAMPLE_ROWS works, of at least `window` different keys, each with `window` keys of its neighbours; all works of
    a key are neighbours, however many share it; citations go to the chunk of each of their keys, and chunks with many
    of them, by a sample of SAMPLE_ROWS claims, are salted over several tasks.
    """
    works = works.select(F.col("work_id").cast("bigint").alias("work_id"), F.col("title").cast("string").alias("title"), F.col("families").cast("array<string>").alias("families"), F.col("year").cast("int").alias("year")).filter("work_id IS NOT NULL AND title IS NOT NULL").distinct()
    rows = citations.select(F.col("citation_id").cast("bigint").alias("citation_id"), F.col("source").cast("string").alias("source"), F.col("author").cast("string").alias("author")).filter("citation_id IS NOT NULL AND source IS NOT NULL").distinct()
    claims = rows.select("source", "author").distinct()
    n_works, n_claims = works.count(), claims.count()

    def keyed(df: DataFrame, own_keys, bounds: list[str]) -> DataFrame:
        """df with a row for each key and the chunk that the key falls into."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = own_keys(batch.to_pydict())
                at = pa.array([i for i, ks in enumerate(own) for _ in ks], pa.int64())
                flat = [k for ks in own for k in ks]
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns), pa.array(flat, pa.string()), pa.array([bisect_right(bounds, k) for k in flat], pa.int32())], names=[*batch.schema.names, "key", "chunk"])

        return df.mapInArrow(run, df.withColumns({"key": F.lit(""), "chunk": F.lit(0)}).schema)

    def work_keys(batch: dict) -> list[list[str]]:
        return [Title(t, main=True).keys(_families(fs)) for t, fs in zip(batch["title"], batch["families"])]

    def claim_keys(batch: dict) -> list[list[str]]:
        return [Title(s).keys(people(a)) for s, a in zip(batch["source"], batch["author"])]

    sampled = bounded_sample(works, "work_id", SAMPLE_ROWS, n_works)
    sample = sorted(keyed(sampled, work_keys, []).select("key").toArrow().column("key").to_pylist())
    n_keys = len(sample) * max(1.0, n_works / SAMPLE_ROWS)
    chunks = int(min(MAX_CHUNKS, max(1, -(-n_keys // chunk_keys))))
    bounds: list[str] = []
    distinct, before = sorted(set(sample)), 0
    for i in range(1, chunks) if sample else ():
        at = bisect_left(distinct, sample[i * len(sample) // chunks])
        if at - before >= window and len(distinct) - at >= window:
            bounds.append(distinct[at])
            before = at

    placed = keyed(works, work_keys, bounds)
    if bounds:
        placed = staged(placed, "catalogue")
        first, last = Window.partitionBy("chunk").orderBy("key"), Window.partitionBy("chunk").orderBy(F.desc("key"))
        up = placed.withColumn("n", F.dense_rank().over(last)).filter(F.col("n") <= window).drop("n").withColumn("chunk", F.col("chunk") + 1)
        down = placed.withColumn("n", F.dense_rank().over(first)).filter(F.col("n") <= window).drop("n").withColumn("chunk", F.col("chunk") - 1)
        placed = placed.unionByName(up).unionByName(down)

    least = -(-parallelism(works.sparkSession) // (len(bounds) + 1))
    some = claims.withColumn("claim", F.xxhash64("source", "author"))
    asked_of = keyed(bounded_sample(some, "claim", SAMPLE_ROWS, n_claims).select("source", "author"), claim_keys, bounds).groupBy("chunk").count().collect()
    scale = max(1.0, n_claims / SAMPLE_ROWS) / GROUP_KEYS
    salts = [least] * (len(bounds) + 1)
    for r in asked_of:
        salts[r["chunk"]] = max(least, int(-(-r["count"] * scale // 1)))
    salts_of = F.element_at(F.array(*map(F.lit, salts)), F.col("chunk") + 1) if len(set(salts)) > 1 else F.lit(salts[0])
    dealt = keyed(claims, claim_keys, bounds).withColumn("salt", F.pmod(F.xxhash64("source", "author"), salts_of).cast("int"))
    copied = placed.filter(F.col("chunk").between(0, len(bounds))).withColumn("salt", F.explode(F.sequence(F.lit(0), salts_of - 1)))

    def telling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [Title(t, main=True).key_words for t in batch.column("title").to_pylist()]
            at = pa.array([i for i, ks in enumerate(own) for _ in ks], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("work_id").take(at), pa.array([k for ks in own for k in ks], pa.string())], names=["work_id", "word"])

    often = works.select("work_id", "title").mapInArrow(telling, "work_id bigint, word string").distinct().groupBy("word").count()
    worth = {r["word"]: COMMON_WORTH for r in often.filter(F.col("count") > max(2, COMMON_SHARE * n_works)).collect()}

    def compare(claims: pa.Table, catalogue: pa.Table) -> pa.Table:
        held = catalogue.to_pydict()
        order = sorted(range(catalogue.num_rows), key=lambda i: (held["key"][i], held["work_id"][i]))
        starts = [n for n, i in enumerate(order) if n == 0 or held["key"][i] != held["key"][order[n - 1]]]
        keys = [held["key"][order[n]] for n in starts]
        starts.append(len(order))
        known: dict[int, tuple[Title, list[str], int | None]] = {}
        place = []
        for i in order:
            w = held["work_id"][i]
            if w not in known:
                known[w] = (Title(held["title"][i], main=True), _families(held["families"][i]), held["year"][i])
            place.append(w)
        asked = claims.to_pydict()
        near: dict[tuple[str, str | None], set[int]] = {}
        for source, author, key in zip(asked["source"], asked["author"], asked["key"]):
            at = bisect_left(keys, key)
            near.setdefault((source, author), set()).update(place[starts[max(0, at - window)] : starts[min(len(keys), at + window)]])
        out = []
        titles: dict[str, Title] = {}
        for (source, author), candidates in near.items():
            title = titles.get(source) or titles.setdefault(source, Title(source))
            names, named = people(author), bool(author and author.strip())
            for w in candidates:
                work, families, year = known[w]
                if title.volume != work.volume or title.words.keys().isdisjoint(work.words.keys()):
                    continue
                sure = confidence(title, names, named, work, families, year, worth)
                if sure >= min_confidence:
                    out.append((source, author, w, sure, title.year is None and not named, "|".join(sorted(families))))
        columns = list(zip(*out)) or [()] * 6
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.float64(), pa.bool_(), pa.string()))], names=["source", "author", "work_id", "confidence", "bare", "families"])

    scored = dealt.groupBy("chunk", "salt").cogroup(copied.groupBy("chunk", "salt")).applyInArrow(compare, "source string, author string, work_id bigint, confidence double, bare boolean, families string").distinct()
    if one_to_one:
        fit = rows.join(scored, rows["source"].eqNullSafe(scored["source"]) & rows["author"].eqNullSafe(scored["author"])).select("citation_id", "work_id", "confidence")
        return assigned(fit.groupBy("citation_id", "work_id").agg(F.max("confidence").alias("confidence")))
    each = Window.partitionBy("source", "author")
    top = scored.withColumn("best", F.max("confidence").over(each)).filter(F.col("confidence") > F.col("best") - 1e-9)
    top = top.withColumn("others", F.min("families").over(each) != F.max("families").over(each)).filter(~(F.col("bare") & F.col("others")))
    best = top.groupBy("source", "author").agg(F.min("work_id").alias("work_id"), F.max("confidence").alias("confidence"))
    return rows.join(best, rows["source"].eqNullSafe(best["source"]) & rows["author"].eqNullSafe(best["author"])).select("citation_id", "work_id", "confidence").distinct()


def assigned(scored: DataFrame, *, bid: float = BID) -> DataFrame:
    """(citation_id, work_id, confidence): a one-to-one assignment of greatest total confidence, by auction.

    scored: (citation_id, work_id, confidence > 0), each pair once. In each round every citation without a work bids
    for the one of greatest confidence less price, up to what makes the next best, or none, as good, and `bid` more; a
    work goes to its highest bidder, whose bid becomes its price. The rounds end when nobody bids; the total is then at
    most `bid` a match below the greatest. Both sides are dealt by key, no component is gathered; each round's table
    goes to the shared folder. Null ids or confidences take no part; an empty table gives an empty result.
    """
    pairs = staged(scored.filter("citation_id IS NOT NULL AND work_id IS NOT NULL AND confidence > 0").select("citation_id", "work_id", "confidence"), "pairs")
    owners = staged(pairs.select("work_id", "citation_id", "confidence", F.lit(0.0).alias("price")).limit(0), "owners")
    while True:
        free = pairs.join(owners.select("citation_id"), "citation_id", "left_anti").join(owners.select("work_id", "price"), "work_id", "left")
        worth = free.select("citation_id", "work_id", "confidence", F.coalesce("price", F.lit(0.0)).alias("price")).withColumn("value", F.col("confidence") - F.col("price")).filter("value > 0")
        mine = Window.partitionBy("citation_id").orderBy(F.desc("value"), "work_id")
        ranked = worth.withColumn("place", F.row_number().over(mine)).filter("place <= 2").withColumn("next", F.lead("value").over(mine)).filter("place = 1")
        bids = ranked.select("work_id", "citation_id", "confidence", (F.col("price") + F.col("value") - F.coalesce("next", F.lit(0.0)) + bid).alias("price"))
        won = bids.groupBy("work_id").agg(F.max_by(F.struct("citation_id", "confidence", "price"), F.struct("price", (-F.col("citation_id")).alias("first"))).alias("w")).select("work_id", "w.*")
        fresh = staged(won, "bids")
        if fresh.isEmpty():
            discarded(fresh)
            discarded(pairs)
            return owners.select("citation_id", "work_id", "confidence")
        after = staged(owners.join(fresh.select("work_id"), "work_id", "left_anti").unionByName(fresh), "owners")
        discarded(owners)
        discarded(fresh)
        owners = after
