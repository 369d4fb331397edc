"""The most similar vectors of every vector by collision counting.

Pivots fitted on a bounded sample deal the vectors to cells; each vector is asked about in its nearest cell and held in
its nearest few, or in more of either where a measurement shows that neighbours would part. Where cells come out too large, each gets pivots of its own, fitted in parallel, and is dealt again.
Inside a cell every random projection keeps one sorted array. A query opens a window around its own value in each array;
vectors that fall into enough windows, and only these, are verified by their true similarity; unless the k best found
lie within the current radius, the windows widen (virtual rehashing) and the vectors that then collide are verified too.
"""

from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codexlake.runtime import bounded_sample, spread, staged

SAMPLE_VECTORS = 8_192
#: Pivots of one level, one for each four sampled vectors at most.
MAX_PIVOTS = 2_048
CELL_VECTORS = 1_000
HELD_IN = 2
#: Sampled vectors whose true neighbours, found by a scan, say in how many cells, MOST_CELLS at most, vectors must be held
#: and asked about for this share of the neighbours to meet.
MEASURED, MOST_CELLS, COVERAGE = 128, 16, 0.98
#: A cell of more than FINER times CELL_VECTORS gets pivots of its own; its vectors are dealt in tasks of DEALT_AT_ONCE.
FINER, DEALT_AT_ONCE = 4, 20_000
PROJECTIONS = 250
#: Half a window's width, in radii: a vector at just the radius falls into it with probability 0.85.
HALF_WINDOW = 1.44
#: Windows of PROJECTIONS that a vector must share; one at just the radius does with probability 0.99, one at right
#: angles to the query, at the radius of similarity 0.6, with less than one in a million.
COLLISIONS = 199
GROWTH = 2**0.25
FIRST_RADIUS = 0.6325
QUERIES_AT_ONCE = 256
VERIFIED_AT_ONCE = 8_192
MAX_CELL = 65_535
#: Different vectors whose least ids a task remembers to leave further copies out early.
EQUAL_MEMO = 1_000_000


def fit_pivots(sample: np.ndarray, pivots: int, rounds: int = 3) -> np.ndarray:
    """Unit vectors that stand for the sample: a few rounds of spherical k-means from evenly spaced rows."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]), np.float32)
    centres = sample[np.linspace(0, len(sample) - 1, min(pivots, len(sample))).astype(int)].copy()
    for _ in range(rounds):
        own = np.concatenate([np.argmax(sample[a : a + 2048] @ centres.T, axis=1) for a in range(0, len(sample), 2048)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-6, sums / np.maximum(norms, 1e-6), centres)
    return centres.astype(np.float32)


def vectors_of(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, matrix) of the usable vectors of a list column: dim elements, all finite, not all zero."""
    lengths = np.diff(column.offsets.to_numpy())
    rows = np.flatnonzero((lengths == dim) & column.is_valid().to_numpy(zero_copy_only=False))
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    starts = column.offsets.to_numpy()[rows]
    matrix = flat[(starts[:, None] + np.arange(dim)).ravel()].reshape(len(rows), dim) if len(rows) else np.zeros((0, dim), np.float32)
    usable = np.isfinite(matrix).all(axis=1) & (matrix != 0).any(axis=1)
    return rows[usable], matrix[usable]


def unit(matrix: np.ndarray) -> np.ndarray:
    wide = matrix.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)
    return (wide / np.linalg.norm(wide, axis=1, keepdims=True)).astype(np.float32)


class SortedProjections:
    """One sorted array for each projection of a cell's vectors, and the rank of each vector in it."""

    def __init__(self, vectors: np.ndarray, lines: np.ndarray):
        self.values = np.ascontiguousarray((vectors @ lines).T)
        order = np.argsort(self.values, axis=1, kind="stable")
        self.sorted = np.take_along_axis(self.values, order, axis=1)
        self.rank = np.empty(order.shape, np.uint16 if len(vectors) <= MAX_CELL else np.uint32)
        np.put_along_axis(self.rank, order, np.arange(len(vectors), dtype=self.rank.dtype)[None, :], axis=1)

    def collisions(self, asked: np.ndarray, half: float) -> np.ndarray:
        """(query, vector) -> how many of the projections have the vector in the query's window of that half width.

        A window is a range of ranks. Ranks of all vectors are compared with it at once, wrapping below its start; that
        costs less than telling the ranks that a wider window adds from those it had.
        """
        count = np.zeros((len(asked), self.rank.shape[1]), np.uint8)
        gap, inside = np.empty(count.shape, self.rank.dtype), np.empty(count.shape, bool)
        for values, ordered, rank in zip(self.values, self.sorted, self.rank):
            centre = values[asked]
            low = np.searchsorted(ordered, centre - half, "left")
            width = np.searchsorted(ordered, centre + half, "right") - low
            np.subtract(rank[None, :], low[:, None].astype(rank.dtype), out=gap)
            np.less(gap, width[:, None].astype(rank.dtype), out=inside)
            count += inside.view(np.uint8)
        return count


def search_cell(vectors: np.ndarray, asked: np.ndarray, k: int, lines: np.ndarray, max_radius: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(query, vector, similarity, verified): verified vectors, at least the k most similar within max_radius that were
    found for each query, and how many pairs were verified for it all."""
    arrays = SortedProjections(vectors, lines)
    for start in range(0, len(asked), QUERIES_AT_ONCE):
        own = asked[start : start + QUERIES_AT_ONCE]
        open_, radius = np.arange(len(own)), min(FIRST_RADIUS, max_radius)
        known = np.zeros((len(own), len(vectors)), bool)
        q, c, similar = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        while len(open_):
            likely = (arrays.collisions(own[open_], HALF_WINDOW * radius) >= COLLISIONS) & ~known[open_]
            new_q, new_c = np.nonzero(likely)
            new_q = open_[new_q]
            known[new_q, new_c] = True
            products = [np.einsum("ij,ij->i", vectors[own[new_q[a : a + VERIFIED_AT_ONCE]]], vectors[new_c[a : a + VERIFIED_AT_ONCE]]) for a in range(0, len(new_q), VERIFIED_AT_ONCE)]
            q, c, similar = np.concatenate((q, new_q)), np.concatenate((c, new_c)), np.concatenate((similar, *products))
            if radius >= max_radius:
                break
            enough = np.bincount(q[similar >= 1 - radius * radius / 2], minlength=len(own)) >= k
            open_, radius = open_[~enough[open_]], min(radius * GROWTH, max_radius)
        order = np.lexsort((-similar, q))
        q, c, similar = q[order], c[order], similar[order]
        first = np.searchsorted(q, np.arange(len(own)), "left")
        last = np.searchsorted(q, np.arange(len(own)), "right") - 1
        floor = np.where(last - first >= k - 1, similar[np.clip(first + k - 1, 0, max(0, len(q) - 1))] if len(q) else 0, -2.0)
        kept = similar >= floor[q] - 1e-5
        yield own[q[kept]], c[kept], similar[kept], len(q)


def top_pivots(points: np.ndarray, pivots: np.ndarray, n: int) -> np.ndarray:
    """The nearest n pivots of each point, the nearest first."""
    n = min(n, len(pivots))
    far = -(points @ pivots.T)
    some = np.argpartition(far, n - 1, axis=1)[:, :n]
    return np.take_along_axis(some, np.argsort(np.take_along_axis(far, some, axis=1), axis=1, kind="stable"), axis=1)


def _chunk(column: pa.ChunkedArray) -> pa.Array:
    column = column.combine_chunks()
    return column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)


def copies_needed(asked: np.ndarray, held: np.ndarray, coverage: float = COVERAGE) -> tuple[int, int]:
    """(held in, asked in): the fewest cells, by their product and then by those held in, so that this share of the pairs
    meets; asked, held: for each pair, the nearest cells of the one and of the other. The greatest if none suffice."""
    most = asked.shape[1]
    if not len(asked):
        return min(HELD_IN, most), 1
    meet = asked[:, :, None] == held[:, None, :]
    choices = sorted((h * a, h, a) for h in range(min(HELD_IN, most), most + 1) for a in range(1, h + 1))
    return next(((h, a) for _, h, a in choices if meet[:, :a, :h].any(axis=(1, 2)).mean() >= coverage), (most, most))


def nearest(vectors: DataFrame, k: int, *, id_col: str = "id", vector_col: str = "embedding", dim: int = 1024, min_similarity: float = -1.0, held_in: int | None = None, asked_in: int = 1, cell_vectors: int = CELL_VECTORS, sample_vectors: int = SAMPLE_VECTORS, max_pivots: int = MAX_PIVOTS, most_cells: int = MOST_CELLS) -> DataFrame:
    """(id, neighbour, similarity): the k most similar other vectors of each, by cosine, at least min_similarity.

    A vector is usable if it has dim elements, all finite and not all zero; other rows, and rows without an id, neither
    ask nor answer. Ties at rank k go to the smaller id. Equal vectors are asked about once and answer with their k + 1
    smallest ids, so that any number of copies costs the same; their rows each get a result. A row that repeats an id
    counts as one more copy, but an id is never its own neighbour. An empty table gives an empty result; other columns
    are ignored. Every usable vector is indexed and asked about; the pivots come from a sample of sample_vectors, and,
    where cells would hold more than FINER times the vectors meant for them, from such a sample of each cell. Without
    held_in, MEASURED sampled vectors are compared with all, and their true neighbours tell in how many cells vectors
    are held and asked about, most_cells at most; clustered vectors need HELD_IN and one, vectors without structure more,
    and some then part all the same.
    Neighbours are found with high probability, not certainty: see the measured recall in the README.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).cast("array<float>").alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    rows = spread(rows.filter(F.size("v") == dim), "id")
    hashed = rows.withColumn("h", F.xxhash64("v"))
    total = rows.count()
    drawn = bounded_sample(rows, "id", sample_vectors, total).select("v", F.xxhash64("v").alias("h")).toArrow().combine_chunks()
    usable, sample = vectors_of(_chunk(drawn.column("v")), dim)
    sample, sample_h = unit(sample), drawn.column("h").to_numpy()[usable]
    cells = int(np.clip(-(-total * HELD_IN // cell_vectors), 1, max(1, min(max_pivots, len(sample) // 4))))
    first_pivots = fit_pivots(sample, cells)
    cells = len(first_pivots)
    shared = spark.sparkContext.broadcast(first_pivots)
    if held_in is None:
        held_in, asked_in = _measured(hashed, sample[:MEASURED], sample_h[:MEASURED], shared, k, dim, min_similarity, most_cells) if cells > HELD_IN else (HELD_IN, 1)
    held_at = top_pivots(sample, first_pivots, held_in) if len(sample) else np.zeros((0, 1), int)
    expected = np.bincount(held_at.ravel(), minlength=cells) * (total / max(1, len(sample)))
    meant = cell_vectors * max(1, held_in / HELD_IN)
    finer = bool((expected > FINER * meant).any())
    tasks = np.maximum(1, np.ceil(expected / DEALT_AT_ONCE)).astype(np.int64)
    max_radius = float(np.sqrt(2 - 2 * min_similarity)) * (1 + 1e-6)
    held = k + 1

    def packed(raw: np.ndarray) -> pa.Array:
        return pa.FixedSizeBinaryArray.from_buffers(pa.binary(dim * 4), len(raw), [None, pa.py_buffer(np.ascontiguousarray(raw))]).cast(pa.binary())

    def unpacked(column: pa.ChunkedArray) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), dim)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, least = shared.value, {}
        for batch in batches:
            at, raw = vectors_of(batch.column("v"), dim)
            key = batch.column("h").to_numpy()[at]
            first = []
            for i, (h, own) in enumerate(zip(key.tolist(), batch.column("id").take(pa.array(at)).to_pylist())):
                kept = least.setdefault(h, [])
                if own not in kept and (len(kept) < held or own < kept[-1]):
                    insort(kept, own)
                    del kept[held:]
                    first.append(i)
            if len(least) > EQUAL_MEMO:
                least.clear()
            at, raw, key = at[first], raw[first], key[first]
            if not len(at):
                continue
            cell = top_pivots(unit(raw), pivots, held_in)
            n = cell.shape[1]
            row = np.repeat(np.arange(len(at)), n)
            salt = key[row] % tasks[cell.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(cell.ravel().astype(np.int64)), pa.array(salt.astype(np.int64)), pa.array(np.tile(np.arange(n) < asked_in, len(at))), batch.column("id").take(pa.array(at[row])), pa.array(key[row]), packed(raw).take(pa.array(row))], names=["cell", "salt", "home", "id", "h", "v"])

    def fit_own(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.Table.from_batches(list(parts))
        cell = key[0].as_py()
        pivots = fit_pivots(unit(unpacked(part.column("v"))), int(np.clip(-(-expected[cell] * HELD_IN // meant), 1, max(1, min(max_pivots, part.num_rows // 4)))))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pivots), cell)), pa.array(np.full(len(pivots), tasks[cell])), packed(pivots)], names=["cell", "tasks", "p"])

    def deal_again(own: pa.Table, fitted: pa.Table) -> pa.Table:
        pivots = unpacked(fitted.column("p")) if fitted.num_rows else np.zeros((1, dim), np.float32)
        near = top_pivots(unit(unpacked(own.column("v"))), pivots, held_in) if own.num_rows else np.zeros((0, 1), np.int64)
        row = pa.array(np.repeat(np.arange(own.num_rows), near.shape[1]))
        first = pa.array(np.tile(np.arange(near.shape[1]) < asked_in, own.num_rows))
        cell = own.column("cell").to_numpy()[row.to_numpy()] * (2 * max_pivots) + near.ravel()
        home = pc.and_(own.column("home").take(row), first)
        return pa.table([pa.array(cell.astype(np.int64)), home, *(own.column(c).take(row) for c in ("id", "h", "v"))], names=["cell", "home", "id", "h", "v"])

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = pa.Table.from_batches(list(parts))
        ids, h, home = np.array(cell.column("id").to_pylist(), object), cell.column("h").to_numpy(), cell.column("home").to_numpy()
        raw = unpacked(cell.column("v"))
        order = np.lexsort((~home, ids, h))
        same = np.concatenate(([False], (h[order][1:] == h[order][:-1]) & (ids[order][1:] == ids[order][:-1])))
        order = order[~same]
        place = np.arange(len(order)) - np.searchsorted(h[order], h[order], "left")
        kept = np.sort(order[place < held])
        first = np.sort(order[place == 0])
        first = first[home[first]]
        ids, h, raw = ids[kept], h[kept], raw[kept]
        asked = np.searchsorted(kept, first)
        lines = np.random.default_rng(20_240_229).standard_normal((dim, PROJECTIONS), np.float32)
        unit_rows = unit(raw)
        for q, c, _, _ in search_cell(unit_rows, asked, k + 1, lines, max_radius):
            exact = np.empty(len(q))
            for a in range(0, len(q), 4096):
                x, y = raw[q[a : a + 4096]].astype(np.float64), raw[c[a : a + 4096]].astype(np.float64)
                exact[a : a + 4096] = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
            use = exact >= min_similarity
            yield pa.RecordBatch.from_arrays([pa.array(h[q[use]]), pa.array(ids[c[use]], pa.string()), pa.array(exact[use])], names=["h", "neighbour", "similarity"])

    dealt = hashed.mapInArrow(deal, "cell bigint, salt bigint, home boolean, id string, h bigint, v binary")
    if finer:
        keep = (sample_vectors / np.maximum(expected, sample_vectors) * 2**63).astype(object)
        chosen = F.shiftrightunsigned(F.xxhash64(F.lit("finer"), "h"), 1) < F.element_at(F.array(*(F.lit(min(int(x), 2**63 - 1)) for x in keep)), F.col("cell").cast("int") + 1)
        fitted = staged(dealt.filter(chosen).groupBy("cell").applyInArrow(fit_own, "cell bigint, tasks bigint, p binary"), "pivots")
        fitted = fitted.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tasks") - 1))).drop("tasks")
        dealt = dealt.groupBy("cell", "salt").cogroup(fitted.groupBy("cell", "salt")).applyInArrow(deal_again, "cell bigint, home boolean, id string, h bigint, v binary")
    dealt = dealt.select("cell", "home", "id", "h", "v")
    found = dealt.groupBy("cell").applyInArrow(search, "h bigint, neighbour string, similarity double")
    order = (F.desc("similarity"), F.asc("neighbour"))
    lists = found.distinct().withColumn("place", F.row_number().over(Window.partitionBy("h").orderBy(*order))).filter(F.col("place") <= held)
    mine = hashed.select("id", "h").distinct().join(lists, "h").filter("id <> neighbour")
    ranked = mine.withColumn("place", F.row_number().over(Window.partitionBy("id", "h").orderBy(*order))).filter(F.col("place") <= k)
    return ranked.select("id", "neighbour", "similarity")


def _measured(hashed: DataFrame, asked: np.ndarray, asked_h: np.ndarray, shared, k: int, dim: int, min_similarity: float, most_cells: int) -> tuple[int, int]:
    """copies_needed() by the k true neighbours of the asked vectors; each task keeps its k most similar of each."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, np.int64), np.zeros((0, min(most_cells, len(shared.value))), np.int32))]
        for batch in batches:
            at, raw = vectors_of(batch.column("v"), dim)
            if not len(at):
                continue
            points, h = unit(raw), batch.column("h").to_numpy()[at]
            similar = asked @ points.T
            similar[asked_h[:, None] == h[None, :]] = -2
            some = np.argpartition(-similar, k - 1, axis=1)[:, :k] if len(at) > k else np.tile(np.arange(len(at)), (len(asked), 1))
            value = np.take_along_axis(similar, some, axis=1)
            q, n = np.nonzero(value >= max(min_similarity, -1.0))
            c = some[q, n]
            best.append((q, value[q, n], h[c], top_pivots(points[c], shared.value, most_cells).astype(np.int32)))
            if sum(len(x[0]) for x in best) > 64 * k * max(1, len(asked)):
                best = [_most_similar(best, k)]
        q, value, h, cells = _most_similar(best, k)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1) * cells.shape[1], pa.int32()), pa.array(cells.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(value.astype(np.float64)), pa.array(h), lists], names=["q", "similarity", "h", "cells"])

    found = hashed.select("v", "h").mapInArrow(scan, "q bigint, similarity double, h bigint, cells array<int>").dropDuplicates(["q", "h"])
    near = found.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("similarity"), "h"))).filter(F.col("place") <= k).select("q", "cells").toPandas()
    own = top_pivots(asked, shared.value, most_cells)
    return copies_needed(own[near["q"].to_numpy()], np.array(near["cells"].to_list(), np.int64).reshape(len(near), own.shape[1]))


def _most_similar(parts: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    q, value, h, cells = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((-value, q))
    place = np.arange(len(q)) - np.searchsorted(q[order], q[order], "left")
    kept = order[place < k]
    return q[kept], value[kept], h[kept], cells[kept]


def pairs_of(neighbours: DataFrame) -> DataFrame:
    """(id_a, id_b), smaller id first: each pair in which one is among the other's neighbours, once."""
    return neighbours.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
