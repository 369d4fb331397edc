"""Long exact spans that texts share, by anchors, reference shards with suffix automata, and matching statistics.

Every window of the least length chooses an anchor by its own characters alone, so equal windows meet under one anchor.
Anchors of one text only are dropped. Runs of windows that agree in all their characters are shared as a whole; where
texts part, the contexts of an anchor form a reference shard: a suffix automaton over them, each state with the range
of documents that hold it, through which the contexts are streamed for their matching statistics.
"""

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codexlake.runtime import bounded_sample, parallelism, spread, staged

GRAM = 56
#: Contexts of one anchor that one automaton may hold; anchors with more count equal windows across tasks instead.
SHARD_CONTEXTS = 2_000
SHARD_ROWS = 4_000
#: Anchors in at least one in HOT_SHARE of SAMPLE_TEXTS texts, as those of a header that many carry, are hot: known to be
#: shared, they are dealt by text over SALTS tasks.
SAMPLE_TEXTS, HOT_SHARE, SALTS = 4_000, 100, 64
PIECE = 1 << 22
CHUNK = 1 << 20
POSITION_BITS = 26
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    one = np.ones(1, np.uint64)
    return tuple(np.cumprod(np.concatenate((one, np.full(n - 1, b, np.uint64))), dtype=np.uint64) for b in (BASE, INVERSE))


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours."""
    n = len(keys) - width + 1
    blocks = -(-len(keys) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def contexts(codes: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(first window, last window, anchor, context) of the runs of windows that choose the same anchor.

    codes: the characters of several texts after each other; doc: the text of each. A window of `length` characters
    chooses its gram of least hash, the leftmost of equals, so that equal windows choose alike wherever they stand.
    anchor is that gram's hash, context the hash of all characters of the run's windows and the anchor's place.
    """
    n, width = len(codes), length - GRAM + 1
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    power, inverse = _powers(max(CHUNK, 1 << int(n + 1).bit_length()))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(scramble(codes.astype(np.uint64) + BASE) * power[:n], dtype=np.uint64)))
    grams = scramble((sums[GRAM:] - sums[:-GRAM]) * inverse[: n - GRAM + 1])
    low = np.uint64((1 << POSITION_BITS) - 1)
    chosen = (sliding_least((grams & ~low) | np.arange(len(grams), dtype=np.uint64), width) & low).astype(np.int64)
    starts = np.flatnonzero(doc[: n - length + 1] == doc[length - 1 :])
    if not len(starts):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    own = chosen[starts]
    cut = np.flatnonzero((own[1:] != own[:-1]) | (doc[starts[1:]] != doc[starts[:-1]])) + 1
    first, last = starts[np.concatenate(([0], cut))], starts[np.concatenate((cut - 1, [len(starts) - 1]))]
    at = chosen[first]
    end = last + length
    place = ((at - first).astype(np.uint64) << np.uint64(32)) + (end - first).astype(np.uint64)
    context = scramble((sums[end] - sums[first]) * inverse[first] + scramble(place))
    return first, last, grams[at], context


class Automaton:
    """A suffix automaton over several strings; each state knows the least and greatest document that holds it."""

    def __init__(self):
        self.next, self.link, self.length, self.low, self.high = [{}], [-1], [0], [None], [None]

    def add(self, text: str, low: int, high: int) -> None:
        nexts, link, length = self.next, self.link, self.length
        last = 0
        for char in text:
            known = nexts[last].get(char)
            if known is not None and length[known] == length[last] + 1:
                last = known
            else:
                last = self._extend(last, char, known)
            self._mark(last, low, high)

    def _extend(self, last: int, char: str, known: int | None) -> int:
        nexts, link, length = self.next, self.link, self.length
        if known is not None:
            return self._clone(last, char, known)
        state = len(nexts)
        nexts.append({})
        link.append(0)
        length.append(length[last] + 1)
        self.low.append(None)
        self.high.append(None)
        p = last
        while p >= 0 and char not in nexts[p]:
            nexts[p][char] = state
            p = link[p]
        if p >= 0:
            q = nexts[p][char]
            link[state] = q if length[q] == length[p] + 1 else self._clone(p, char, q)
        return state

    def _clone(self, p: int, char: str, q: int) -> int:
        nexts, link, length = self.next, self.link, self.length
        copy = len(nexts)
        nexts.append(dict(nexts[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        self.low.append(None)
        self.high.append(None)
        while p >= 0 and nexts[p].get(char) == q:
            nexts[p][char] = copy
            p = link[p]
        link[q] = copy
        return copy

    def _mark(self, state: int, low: int, high: int) -> None:
        if self.low[state] is None:
            self.low[state], self.high[state] = low, high
        else:
            self.low[state], self.high[state] = min(self.low[state], low), max(self.high[state], high)

    def finish(self) -> None:
        """Give every state the documents of the longer ones that end in it."""
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.low[state] is not None and self.link[state] > 0:
                self._mark(self.link[state], self.low[state], self.high[state])

    def shared(self, text: str, span: int) -> list[tuple[int, int]]:
        """(first, last) start offsets of the runs of `span` characters of text that two documents hold.

        The state after each character is cut back to the shortest that still holds the last `span` characters.
        """
        nexts, link, length, low, high = self.next, self.link, self.length, self.low, self.high
        state = matched = 0
        found: list[tuple[int, int]] = []
        for end, char in enumerate(text):
            while state and char not in nexts[state]:
                state = link[state]
                matched = length[state]
            state, matched = (nexts[state][char], matched + 1) if char in nexts[state] else (0, 0)
            while state and length[link[state]] >= span:
                state = link[state]
                matched = length[state]
            if matched >= span and low[state] != high[state]:
                start = end - span + 1
                if found and found[-1][1] == start - 1:
                    found[-1] = (found[-1][0], start)
                else:
                    found.append((start, start))
        return found


def _pieces(texts: list[str], ids: list[int], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(characters, text of each, id of each text, offset of each text) of bounded parts; long texts fall into pieces that overlap."""
    parts: list[tuple[str, int, int]] = []
    held = 0
    for text, own in zip(texts, ids):
        for offset in range(0, max(1, len(text) - length + 1), PIECE):
            part = text[offset : offset + PIECE + length - 1]
            if parts and held + len(part) > CHUNK:
                yield _joined(parts)
                parts, held = [], 0
            parts.append((part, own, offset))
            held += len(part)
    if parts:
        yield _joined(parts)


def _joined(parts):
    codes = np.frombuffer("".join(p[0] for p in parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts]), np.array([p[1] for p in parts], np.int64), np.array([p[2] for p in parts], np.int64)


def _window_hashes(text: str, length: int) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    power, inverse = _powers(CHUNK * 2 if len(codes) < CHUNK else 1 << int(len(codes) + 1).bit_length())
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(scramble(codes.astype(np.uint64) + BASE) * power[: len(codes)], dtype=np.uint64)))
    return scramble((sums[length:] - sums[:-length]) * inverse[: len(codes) - length + 1]).view(np.int64)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows, sorted by anchor, of anchors that several texts have, with whether their contexts differ.

    Rows of hot anchors, which are shared anyhow, pass as they come; other anchors are held until their last row, which
    is few texts beside all: see HOT_SHARE.
    """
    def judged(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        a, c, doc = (rows.column(k).to_numpy() for k in ("a", "c", "doc"))
        starts = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.zeros(0, np.int64)
        if len(starts):
            size = np.diff(np.append(starts, len(a)))
            shared, parts = (np.repeat(np.minimum.reduceat(x, starts) != np.maximum.reduceat(x, starts), size) for x in (doc, c))
            yield from rows.append_column("parts", pa.array(parts)).filter(pa.array(shared)).combine_chunks().to_batches()

    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        hot = rows.column("salt").to_numpy() > 0
        if hot.any():
            yield from rows.filter(pa.array(hot)).append_column("parts", pa.array(np.ones(int(hot.sum()), bool))).combine_chunks().to_batches()
            rows = rows.filter(pa.array(~hot))
        held = rows if held is None else pa.concat_tables([held, rows])
        a = held.column("a").to_numpy()
        last = int(np.searchsorted(a, a[-1], "left")) if len(a) else 0
        if last:
            yield from judged(held.slice(0, last))
            held = held.slice(last)
    if held is not None:
        yield from judged(held)


def shared_spans(texts: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 120, shard_contexts: int = SHARD_CONTEXTS) -> DataFrame:
    """(doc_id, span_start, span_end): the longest stretches of each text whose every character lies in a run of
    `length` characters that stands verbatim in the text of another id; offsets count characters, the end is exclusive.

    Case, spaces and line ends count; touching or overlapping runs form one stretch; repetition inside one id's texts
    does not count, so repeated rows of an id share nothing with each other, but each gives its spans once. Null, empty
    and shorter texts share nothing; rows with a null id are left out; texts of any length are read whole; an empty
    table gives an empty result; other columns are ignored. length must be at least GRAM. Equality is that of 64-bit
    hashes of whole contexts, and of characters inside the automata. Equal texts cost one row per anchor, however many.
    Anchors that a sample of SAMPLE_TEXTS texts shows to be hot are spread over tasks; which are, changes no result.
    """
    if length < GRAM:
        raise ValueError(f"length must be at least {GRAM}")
    spark = texts.sparkSession
    docs = spread(texts.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("string").alias("text")).filter("doc IS NOT NULL").filter(F.length("text") >= length), "doc")

    def anchored(texts: DataFrame, hot: np.ndarray) -> DataFrame:
        """(a, c, doc, first, windows, salt) of the contexts of each text; the salt is 0 unless the anchor is hot."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for codes, part, ids, offsets in _pieces(batch.column("text").to_pylist(), batch.column("doc").to_pylist(), length):
                    first, last, anchor, context = contexts(codes, part, length)
                    own = part[first]
                    begins = np.searchsorted(part, own, "left")
                    a = anchor.view(np.int64)
                    salt = np.where(np.isin(a, hot), 1 + scramble(ids[own].view(np.uint64)) % np.uint64(SALTS), np.uint64(0)) if len(hot) else np.zeros(len(a))
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(context.view(np.int64)), pa.array(ids[own]), pa.array(first - begins + offsets[own]), pa.array((last - first + 1).astype(np.int32)), pa.array(salt.astype(np.int32))], names=["a", "c", "doc", "first", "windows", "salt"])

        return texts.mapInArrow(run, "a bigint, c bigint, doc bigint, first bigint, windows int, salt int")

    total = docs.count()
    least = max(20, min(total, SAMPLE_TEXTS) // HOT_SHARE)
    often = anchored(bounded_sample(docs, "doc", SAMPLE_TEXTS, total), np.zeros(0, np.int64)).select("a", "doc").distinct().groupBy("a").count().filter(F.col("count") >= least)
    hot = np.sort(often.select("a").toArrow().column("a").to_numpy())
    entries = anchored(docs, hot).repartition("a", "salt").sortWithinPartitions("a")
    hits = staged(entries.mapInArrow(_met, "a bigint, c bigint, doc bigint, first bigint, windows int, salt int, parts boolean"), "span-hits")

    classes = hits.filter("parts").groupBy("a", "c").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.min(F.struct("doc", "first", "windows")).alias("at"), F.max("salt").alias("hot"))
    salt = F.explode(F.when(F.col("hot") > 0, F.sequence(F.lit(1), F.lit(SALTS))).otherwise(F.array(F.lit(0)))).alias("salt")
    located = classes.select("a", "c", "lo", "hi", F.col("at.doc").alias("doc"), F.col("at.first").alias("first"), F.col("at.windows").alias("windows"))
    sized = located.join(located.groupBy("a").agg(F.count(F.lit(1)).alias("contexts")), "a")
    read = sized.join(docs, "doc").withColumn("context", F.substring("text", F.col("first").cast("int") + 1, F.col("windows") + F.lit(length - 1)))
    read = staged(read.select("a", "c", "lo", "hi", "contexts", "context").dropDuplicates(["a", "c"]), "span-contexts")
    shards = max(parallelism(spark), read.count() // SHARD_ROWS)

    def match(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(parts)).sort_by([("a", "ascending"), ("c", "ascending")]).to_pydict()
        a, out = rows["a"], []
        start = 0
        while start < len(a):
            stop = start
            automaton = Automaton()
            while stop < len(a) and a[stop] == a[start]:
                automaton.add(rows["context"][stop], rows["lo"][stop], rows["hi"][stop])
                stop += 1
            automaton.finish()
            for i in range(start, stop):
                if rows["lo"][i] == rows["hi"][i]:
                    out += [(a[i], rows["c"][i], x, y) for x, y in automaton.shared(rows["context"][i], length)]
            start = stop
        columns = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["a", "c", "x", "y"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [_window_hashes(t, length) for t in batch.column("context").to_pylist()]
            row = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]))
            flat = np.concatenate(own) if own else np.zeros(0, np.int64)
            place = np.concatenate([np.arange(len(x)) for x in own]) if own else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(place), *(batch.column(k).take(row) for k in ("a", "c", "lo", "hi"))], names=["w", "x", "a", "c", "lo", "hi"])

    small = read.filter(F.col("contexts") <= shard_contexts).withColumn("shard", F.pmod(F.xxhash64("a"), F.lit(shards)))
    matched = small.groupBy("shard").applyInArrow(match, "a bigint, c bigint, x bigint, y bigint")
    apart = read.filter(F.col("contexts") > shard_contexts).mapInArrow(windows, "w bigint, x bigint, a bigint, c bigint, lo bigint, hi bigint")
    twice = apart.groupBy("w").agg(F.min("lo").alias("l"), F.max("hi").alias("h")).filter("l <> h").select("w")
    counted = apart.filter("lo = hi").join(twice, "w").select("a", "c", "x", F.col("x").alias("y"))

    whole = hits.filter("parts").join(classes.filter("lo <> hi").select("a", "c", salt), ["a", "c", "salt"], "left_semi").unionByName(hits.filter("NOT parts"), allowMissingColumns=True)
    found = matched.unionByName(counted).join(classes.select("a", "c", "hot"), ["a", "c"]).select("a", "c", "x", "y", salt)
    partly = hits.filter("parts").join(found, ["a", "c", "salt"])
    runs = whole.select("doc", F.col("first").alias("s"), (F.col("first") + F.col("windows") - 1 + length).alias("e")).unionByName(partly.select("doc", (F.col("first") + F.col("x")).alias("s"), (F.col("first") + F.col("y") + length).alias("e")))
    in_doc = Window.partitionBy("doc").orderBy("s", "e")
    marked = runs.withColumn("reach", F.max("e").over(in_doc.rowsBetween(Window.unboundedPreceding, -1))).withColumn("stretch", F.sum(F.when(F.col("s") <= F.col("reach"), 0).otherwise(1)).over(in_doc))
    return marked.groupBy("doc", "stretch").agg(F.min("s").alias("span_start"), F.max("e").alias("span_end")).select(F.col("doc").alias("doc_id"), "span_start", "span_end")


def shared_portion(texts: DataFrame, spans: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, n_spans, shared_chars, shared_share), a row for each id; a null text has no characters, share 0."""
    total = spans.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_spans"), F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    sizes = texts.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("doc_id")).agg(F.max(F.coalesce(F.length(text_col), F.lit(0))).cast("bigint").alias("n_chars"))
    joined = sizes.join(total, "doc_id", "left").select("doc_id", "n_chars", F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"))
    return joined.withColumn("shared_share", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(F.lit(0.0)))
