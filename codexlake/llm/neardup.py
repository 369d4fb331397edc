"""Near-duplicate texts: circulant MinHash, banding, exact Jaccard verification, and the groups that links form."""

import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexlake.runtime import discarded, spread, staged

WORD = re.compile(r"[^\W_]+")
WORD_MEMO = 1_000_000

#: Slots that shingles are hashed to, and bands x rows coordinates of a signature.
SLOTS = 1 << 20
BANDS, ROWS = 112, 4
#: A band that more texts share is dealt to pairs of blocks of about so many texts, each pair of blocks a task's work.
BLOCK_TEXTS = 512
#: Rows of bands exchanged at once, as long as that takes no more rounds than these.
BAND_ROWS, BAND_ROUNDS = 16_000_000, 8
#: Pairs that carry bitmaps, and pairs that carry shingle sets, at once: so many, or so many a class if that is more, as
#: long as that takes no more rounds than these.
PAIRS_AT_ONCE, PAIRS_A_CLASS, PAIR_ROUNDS = (1_000_000, 50_000), (4, 0.25), 64
#: Places of a bitmap of values to fetch.
MARKS = 1 << 20

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xBF58476D1CE4E5B9))


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[3]
    x = (x ^ (x >> np.uint64(27))) * _MIX[0]
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= WORD_MEMO:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
        return value


_words = _Words()


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the sequences of `size` consecutive words; none if there are fewer words."""
    words = WORD.findall(text.lower()) if text else ()
    if len(words) < size:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = len(codes) - size + 1
    mixed = np.zeros(n, np.uint64)
    for k in range(size):
        mixed = scramble(mixed + codes[k : k + n])
    return np.unique(mixed)


@lru_cache(maxsize=4)
def _circle(coordinates: int) -> np.ndarray:
    """Row s holds the second permutation at slots s, s + 1, ...: the circular shifts that a slot meets."""
    second = np.random.default_rng(7).permutation(SLOTS).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate((second, second[:coordinates])), coordinates)


def slots_of(hashes: np.ndarray) -> np.ndarray:
    """The first permutation: where a shingle stands on the circle."""
    return (scramble(hashes ^ _MIX[1]) >> np.uint64(44)).astype(np.int64)


def signature(slots: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash: coordinate k is the least value of the second permutation, shifted by k, over the slots."""
    circle = _circle(coordinates)
    out = circle[slots[:512]].min(axis=0)
    for a in range(512, len(slots), 512):
        np.minimum(out, circle[slots[a : a + 512]].min(axis=0), out=out)
    return out


def band_keys(slots: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signature(slots, bands * rows).reshape(bands, rows).astype(np.uint64)
    mixed = scramble(np.arange(bands, dtype=np.uint64))
    for k in range(rows):
        mixed = scramble(mixed + parts[:, k] * _MIX[2])
    return mixed.view(np.int64)


def bitmap(hashes: np.ndarray) -> bytes:
    """The low bits of the hashes, marked in 4 to 8 bits a hash, a power of two in all."""
    size = 1 << max(6, (4 * len(hashes) - 1).bit_length())
    marks = np.zeros(size, bool)
    marks[(hashes & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(marks, bitorder="little").tobytes()


def most_shared(n_a: np.ndarray, n_b: np.ndarray, bits_a: np.ndarray, bits_b: np.ndarray) -> np.ndarray:
    """No pair of sets shares more hashes than this: each place at which their bitmaps, rows of bytes, differ takes a hash
    that only one has. A longer bitmap is folded to the length of the other."""
    while bits_a.shape[1] != bits_b.shape[1]:
        if bits_a.shape[1] < bits_b.shape[1]:
            bits_a, bits_b = bits_b, bits_a
        half = bits_a.shape[1] // 2
        bits_a = bits_a[:, :half] | bits_a[:, half:]
    return (n_a + n_b - np.bitwise_count(bits_a ^ bits_b).sum(axis=1, dtype=np.int64)) // 2


def _fields(texts: DataFrame, id_col: str, fields: tuple[str, ...]) -> DataFrame:
    """(field, id, text), a row for each field of each row that has an id and a text."""
    rows = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields)))
    return spread(texts.filter(F.col(id_col).isNotNull()).select(id_col, *(f for f in fields if f != id_col)), id_col).select(F.col(id_col).cast("string").alias("id"), rows.alias("r")).selectExpr("r.field", "id", "r.text").filter("text IS NOT NULL")


def _runs_to_pairs(batches: Iterator[pa.RecordBatch], threshold: float, block: int) -> Iterator[pa.RecordBatch]:
    """(a, b, n) from rows sorted by band: the pairs of nodes of each run of one band whose sizes allow the threshold, n
    null; the rows of a run longer than the block come out as (node, band, n) instead, as they come in, unpaired."""
    band, node, n = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    hot = None

    def made(a: np.ndarray, b: np.ndarray, n: np.ndarray | None = None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64()) if n is None else pa.array(n)], names=["a", "b", "n"])

    for batch in _and_end(batches):
        if batch is not None:
            band, node, n = (np.concatenate((own, batch.column(c).to_numpy().astype(np.int64))) for own, c in ((band, "band"), (node, "node"), (n, "n")))
        starts = np.flatnonzero(np.concatenate(([True], band[1:] != band[:-1]))) if len(band) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(band)))
        if batch is not None and len(sizes) and sizes[-1] <= block and band[-1] != hot:
            whole = int(starts[-1])
            starts, sizes = starts[:-1], sizes[:-1]
        else:
            whole = len(band)
        long = (sizes > block) | (band[starts] == hot) if len(starts) else np.zeros(0, bool)
        in_long = np.repeat(long, sizes)
        rows = np.arange(whole)
        if in_long.any():
            yield made(node[:whole][in_long], band[:whole][in_long], n[:whole][in_long])
        hot = int(band[whole - 1]) if whole and len(long) and long[-1] and batch is not None else hot
        rows, ends = rows[~in_long], np.repeat(np.append(starts[1:], whole)[: len(sizes)], sizes)[~in_long]
        step = 1
        while len(rows):
            keep = rows + step < ends
            rows, ends = rows[keep], ends[keep]
            other = rows + step
            fits = np.minimum(n[rows], n[other]) >= threshold * np.maximum(n[rows], n[other])
            if fits.any():
                yield made(node[rows[fits]], node[other[fits]])
            step += 1
        band, node, n = band[whole:], node[whole:], n[whole:]


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _candidates(buckets: DataFrame, threshold: float, block: int) -> DataFrame:
    """A staged table (node, other), node < other, once each: the nodes that share a band and whose sizes allow the threshold.

    buckets: (node, n, band). One exchange brings equal bands together; bands of more than `block` nodes leave their
    task unpaired and are dealt to pairs of blocks, so that no task holds more than two blocks of one band.
    """
    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _runs_to_pairs(batches, threshold, block)

    met = staged(buckets.repartition("band").sortWithinPartitions("band", "node").mapInArrow(pair, "a bigint, b bigint, n bigint"), "bands", free=True)
    near = met.filter("n IS NULL").select(F.least("a", "b").alias("node"), F.greatest("a", "b").alias("other"))
    hot = met.filter("n IS NOT NULL").select(F.col("b").alias("band"), F.col("a").alias("node"), "n")
    if hot.isEmpty():
        found = staged(near.distinct(), "candidates", free=True)
        discarded(met)
        return found
    blocks = hot.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"))
    dealt = hot.join(blocks, "band").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(F.xxhash64("band", F.least("own", "with"), F.greatest("own", "with")).alias("cell"), "node", "n", "own", (F.col("own") == F.col("with")).alias("same"))

    def across(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = pa.Table.from_batches(list(parts))
        node, n, own, same = (cell.column(c).to_numpy() for c in ("node", "n", "own", "same"))
        i, j = np.triu_indices(len(node), 1)
        use = ((own[i] != own[j]) | (same[i] & same[j])) & (np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]))
        i, j = i[use], j[use]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], names=["node", "other"])

    far = dealt.groupBy("cell").applyInArrow(across, "node bigint, other bigint")
    found = staged(near.unionByName(far).distinct(), "candidates", free=True)
    discarded(met)
    return found


def _in_rounds(pairs: DataFrame, rounds: int, label: str, step: Callable[[DataFrame, Callable[[DataFrame], DataFrame]], DataFrame]) -> DataFrame:
    """A staged table of what the step makes of the pairs of each round, dealt by node. The step gets the pairs of a round
    and what leaves of a table by node those of the round."""
    made = []
    for r in range(rounds):
        def own(df: DataFrame, r: int = r) -> DataFrame:
            return df if rounds == 1 else df.filter(F.pmod(F.xxhash64(F.lit("round"), "node"), F.lit(rounds)) == r)

        made.append(staged(step(own(pairs), own), label, free=True))
    return _joined(made, label)


def _joined(made: list[DataFrame], label: str, *, distinct: bool = False) -> DataFrame:
    """One staged table of staged tables, which are deleted."""
    if len(made) == 1:
        return made[0]
    whole = reduce(DataFrame.unionByName, made)
    whole = staged(whole.distinct() if distinct else whole, label, free=True)
    for part in made:
        discarded(part)
    return whole


def _rounds(pairs: int, at_once: float) -> int:
    return min(PAIR_ROUNDS, max(1, math.ceil(pairs / at_once)))


def _not_ruled_out(pairs: DataFrame, heads: DataFrame, threshold: float, rounds: int) -> DataFrame:
    """A staged table of the pairs (node, other) whose bitmaps allow the threshold. heads: (node, n, bits)."""
    def allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (n_a, n_b), (a, b) = (batch.column(c).to_numpy().astype(np.int64) for c in ("n", "m")), (batch.column(c) for c in ("bits", "of"))
            long = [pc.binary_length(x).to_numpy().astype(np.int64) for x in (a, b)]
            keep = np.zeros(len(batch), bool)
            for key in np.unique(long[0] << 32 | long[1]).tolist():
                at = np.flatnonzero((long[0] == key >> 32) & (long[1] == key & 0xFFFFFFFF))
                for at in np.array_split(at, math.ceil(len(at) * (key >> 32) / 2**24)):
                    rows = [np.frombuffer(b"".join(x.take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), -1) for x in (a, b)]
                    shared = most_shared(n_a[at], n_b[at], *rows)
                    keep[at] = shared >= threshold * (n_a[at] + n_b[at] - shared)
            yield batch.select(["node", "other"]).filter(pa.array(keep))

    other = heads.select(F.col("node").alias("other"), F.col("n").alias("m"), F.col("bits").alias("of"))
    return _in_rounds(pairs, rounds, "close", lambda of_round, own: of_round.join(own(heads), "node").join(other, "other").select("node", "other", "n", "m", "bits", "of").mapInArrow(allowed, "node bigint, other bigint"))


def _likely(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """The values of the source whose field and id are wanted, and some others: what a bitmap of the wanted tells apart
    before anything is shuffled."""
    place = F.pmod(F.xxhash64("field", "id"), F.lit(MARKS)).cast("int").alias("place")
    marks = np.zeros(MARKS, bool)
    marks[wanted.select(place).distinct().toArrow().column(0).to_numpy()] = True
    packed = np.packbits(marks).tobytes()

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
        for batch in batches:
            yield batch.filter(pa.array(marks[batch.column("place").to_numpy()])).select(["field", "id", "text"])

    return source.select("field", "id", "text", place).mapInArrow(marked, "field string, id string, text string")


def classes_and_links(texts: DataFrame, id_col: str, fields: tuple[str, ...], *, words: int = 5, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS, block_texts: int = BLOCK_TEXTS, band_rows: int = BAND_ROWS, pairs_at_once: tuple[int, int] = PAIRS_AT_ONCE) -> tuple[DataFrame, DataFrame]:
    """(members, links) of near-duplicate texts within each field.

    members: (field, id, class_id), a row for each value that has a shingle; values with the same shingles form a class,
    named by its smallest id. links: (field, class_a, class_b, jaccard), class_a < class_b: the pairs of classes whose
    shingles, sequences of `words` consecutive words of lower-cased letters and digits, have a Jaccard similarity of
    the threshold or more, verified exactly. Candidates share a band of the circulant MinHash signature of all their
    shingles, however common; with the default bands 99.93 % of the pairs at similarity 0.5 do, and practically
    all at 0.8. Values that are null, empty or shorter than `words` words are in no class; repeated rows of one id
    are in the class once; a null id is left out; an empty table gives empty results; other columns are ignored, whole
    texts are read. Only classes, never their copies, are compared.
    """
    source = _fields(texts, id_col, fields)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, key, many, keys, bits = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                hashes = shingles(text, words)
                if not len(hashes):
                    continue
                at.append(i)
                key.append(xxhash.xxh3_128_hexdigest(hashes.tobytes()))
                many.append(len(hashes))
                keys.append(band_keys(slots_of(hashes), bands, rows))
                bits.append(bitmap(hashes))
            sizes = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            rows_at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("field").take(rows_at), batch.column("id").take(rows_at), pa.array(key, pa.string()), pa.array(many, pa.int32()), pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat)), pa.array(bits, pa.binary())], names=["field", "id", "content", "n", "bands", "bits"])

    signed = staged(source.mapInArrow(sign, "field string, id string, content string, n int, bands array<bigint>, bits binary"), "signatures", free=True)
    heads = signed.groupBy("field", "content").agg(F.min("id").alias("class_id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    heads = staged(heads.withColumn("node", F.xxhash64("field", "class_id")), "classes", free=True)
    members = staged(signed.select("field", "id", "content").distinct().join(heads.select("field", "content", "class_id"), ["field", "content"]).select("field", "id", "class_id"), "members", free=True)
    discarded(signed)

    classes = heads.count()
    rounds = min(BAND_ROUNDS, bands, max(1, math.ceil(classes * bands / band_rows)))
    found = []
    for r in range(rounds):
        first, last = bands * r // rounds, bands * (r + 1) // rounds
        buckets = heads.select("node", "n", "field", F.explode(F.slice("bands", first + 1, last - first)).alias("band"))
        found.append(_candidates(buckets.select("node", "n", F.xxhash64("field", "band").alias("band")), threshold, block_texts))
    near = _joined(found, "candidates", distinct=True)
    of_bits, of_sets = (max(1, least, each * classes) for least, each in zip(pairs_at_once, PAIRS_A_CLASS))
    close = _not_ruled_out(near, heads.select("node", "n", "bits"), threshold, _rounds(near.count(), of_bits))
    discarded(near)

    wanted = close.select("node").union(close.select("other")).distinct()
    wanted = staged(heads.select("field", F.col("class_id").alias("id"), "node").join(wanted, "node", "left_semi"), "wanted", free=True)
    discarded(heads)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingles(t, words).view(np.int64) for t in batch.column("text").to_pylist()]
            sizes = np.cumsum([0, *map(len, own)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(own) if own else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("field"), batch.column("id"), lists], names=["node", "field", "id", "set"])

    contents = _likely(source, wanted).join(wanted, ["field", "id"]).dropDuplicates(["field", "id"]).select("node", "field", "id", "text")
    contents = staged(contents.mapInArrow(sets, "node bigint, field string, id string, set array<bigint>"), "sets", free=True)
    discarded(wanted)
    b = contents.select(F.col("node").alias("other"), F.col("field").alias("of"), F.col("id").alias("b"), F.col("set").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))

    def verified(pairs: DataFrame, own: Callable[[DataFrame], DataFrame]) -> DataFrame:
        a = own(contents).select("node", "field", F.col("id").alias("a"), F.col("set").alias("sa"))
        links = pairs.join(a, "node").join(b, "other").filter("field = of").select("field", F.least("a", "b").alias("class_a"), F.greatest("a", "b").alias("class_b"), both.alias("both"), (F.size("sa") + F.size("sb")).alias("sum"))
        links = links.withColumn("jaccard", F.col("both") / (F.col("sum") - F.col("both"))).filter(F.col("both") >= F.lit(threshold) * (F.col("sum") - F.col("both")))
        return links.select("field", "class_a", "class_b", "jaccard")

    links = _in_rounds(close, _rounds(close.count(), of_sets), "links", verified)
    discarded(contents)
    discarded(close)
    return members, links


def pairs_of(members: DataFrame, links: DataFrame) -> DataFrame:
    """(field, id_a, id_b), id_a < id_b: every pair of values of one class or of two linked classes."""
    one, two = members.select("field", F.col("class_id").alias("class_a"), F.col("id").alias("x")), members.select("field", F.col("class_id").alias("class_b"), F.col("id").alias("y"))
    across = links.select("field", "class_a", "class_b").join(one, ["field", "class_a"]).join(two, ["field", "class_b"]).select("field", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    inside = one.join(two.withColumnRenamed("class_b", "class_a"), ["field", "class_a"]).filter("x < y").select("field", F.col("x").alias("id_a"), F.col("y").alias("id_b"))
    return across.unionByName(inside)


def groups_of(members: DataFrame, links: DataFrame) -> DataFrame:
    """(field, id, class_id, group_id, n_links): the connected group of each value and the number of links of its class.

    Groups come from alternating large-star and small-star rounds over a table of edges, which end when no edge
    changes; each round's edges are written to the shared folder. group_id is the group's smallest class.
    """
    edges = staged(links.select("field", F.col("class_a").alias("u"), F.col("class_b").alias("v")), "edges")
    degree = edges.select("field", "u").union(edges.select("field", "v")).groupBy("field", "u").count()

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.union(edges.select("field", F.col("v").alias("u"), F.col("u").alias("v")))
        if not large:
            both = both.filter("v < u")
        least = both.groupBy("field", "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        hooked = both.join(least, ["field", "u"])
        made = hooked.filter("v > u").select("field", F.col("v").alias("u"), F.col("m").alias("v")) if large else hooked.select("field", F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("field", "u", F.col("m").alias("v")))
        return made.filter("u <> v").distinct()

    before, now = None, edges.select("field", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = staged(now.distinct(), "edges")
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("field", "u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before, older = state, now
        now = staged(star(star(now, True), False), "edges")
        discarded(older)
    roots = now.groupBy("field", "u").agg(F.min("v").alias("group_id"))
    named = members.join(roots.withColumnRenamed("u", "class_id"), ["field", "class_id"], "left").join(degree.withColumnsRenamed({"u": "class_id", "count": "n_links"}), ["field", "class_id"], "left")
    return named.select("field", "id", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
