"""Points near other points, and points inside regions.

Points become unit vectors. A k-d tree fitted on a bounded sample splits space into cells; every point goes to its home
cell and, as a halo copy, to every cell within the search radius. Each cell builds its own k-d tree and answers radius
queries by chord length. Regions are answered by sweeping a line over the polygon edges.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexlake.runtime import bounded_sample, parallelism

EARTH_RADIUS_KM = 6371.0088
SAMPLE_POINTS = 50_000
CELL_POINTS = 20_000
MAX_CELLS = 65_536
BROADCAST_VERTICES = 200_000
STRIPE_DEGREES = 0.5
LEAF = 32
PAIRS_AT_ONCE = 1_000_000
SECTION_EDGES = 4_000_000
HALF_WORLDS = (-360.0, 0.0, 360.0)


def usable_coordinates(df: DataFrame, id_col: str, lat: Column, lng: Column) -> DataFrame:
    """(id, lat, lng) of the rows with an id, both coordinates finite, a latitude in -90..90, and not at (0, 0).

    A longitude above 180 counts as that much less 360.
    """
    points = df.select(F.col(id_col).cast("string").alias("id"), lat.cast("double").alias("lat"), lng.cast("double").alias("lng"))
    finite = F.abs("lng") < F.lit(float("inf"))
    placeholder = (F.col("lat") == 0) & (F.col("lng") == 0)
    kept = points.filter(F.col("id").isNotNull() & F.col("lat").between(-90, 90) & finite & ~placeholder)
    return kept.withColumn("lng", F.when(F.col("lng") > 180, F.col("lng") - 360).otherwise(F.col("lng")))


def unit_vectors(lat: np.ndarray, lng: np.ndarray) -> np.ndarray:
    la, lo = np.radians(lat), np.radians(lng)
    return np.column_stack((np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)))


class Splits:
    """A k-d tree of split planes with numbered cells; `blocks` says into how many parts a cell's points are dealt."""

    def __init__(self, sample: np.ndarray, total: int, cells: int, cell_points: int):
        self.dim, self.at, self.low, self.high, self.cell = [], [], [], [], []
        self.weights: list[float] = []
        scale = total / max(1, len(sample))
        least = max(1, len(sample) // max(1, cells))
        todo = [(sample, -1, 0)]
        while todo:
            points, parent, side = todo.pop()
            node = len(self.dim)
            if parent >= 0:
                (self.low, self.high)[side][parent] = node
            spread = np.ptp(points, axis=0) if len(points) else np.zeros(3)
            axis = int(np.argmax(spread))
            plane = float(np.median(points[:, axis])) if len(points) else 0.0
            left = points[:, axis] <= plane if len(points) else np.zeros(0, bool)
            if len(points) > least and spread[axis] > 0 and left.all():
                plane = float(points[points[:, axis] < plane, axis].max())
                left = points[:, axis] <= plane
            splits = len(points) > least and spread[axis] > 0
            for values, value in ((self.dim, axis), (self.at, plane), (self.low, -1), (self.high, -1), (self.cell, -1 if splits else len(self.weights))):
                values.append(value)
            if splits:
                todo += [(points[~left], node, 1), (points[left], node, 0)]
            else:
                self.weights.append(len(points) * scale)
        self.dim, self.low, self.high, self.cell = (np.array(x) for x in (self.dim, self.low, self.high, self.cell))
        self.at = np.array(self.at)
        self.blocks = np.clip(np.ceil(np.array(self.weights) / (2 * cell_points)), 1, 1000).astype(np.int64)

    def assign(self, points: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(point, cell, is home) of every cell within the radius of a point."""
        at, node, home = np.arange(len(points)), np.zeros(len(points), np.int64), np.ones(len(points), bool)
        found = []
        while len(at):
            done = self.cell[node] >= 0
            found.append((at[done], self.cell[node[done]], home[done]))
            at, node, home = at[~done], node[~done], home[~done]
            x, plane = points[at, self.dim[node]], self.at[node]
            left, right = x <= plane + radius, x >= plane - radius
            inside = x <= plane
            at, node, home = np.concatenate((at[left], at[right])), np.concatenate((self.low[node][left], self.high[node][right])), np.concatenate(((home & inside)[left], (home & ~inside)[right]))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (at, node, home)


class LocalTree:
    """A k-d tree over the points of one cell, held in arrays."""

    def __init__(self, points: np.ndarray):
        self.points, self.order = points, np.arange(len(points))
        self.first, self.last, self.child, self.lo, self.hi = [], [], [], [], []
        todo = [(0, len(points), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            node = len(self.first)
            if parent >= 0:
                self.child[parent][side] = node
            own = points[self.order[a:b]]
            lo, hi = own.min(axis=0), own.max(axis=0)
            for values, value in ((self.first, a), (self.last, b), (self.child, [-1, -1]), (self.lo, lo), (self.hi, hi)):
                values.append(value)
            axis = int(np.argmax(hi - lo))
            if b - a > LEAF and hi[axis] > lo[axis]:
                middle = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(own[:, axis], middle)]
                todo += [(a, a + middle, node, 0), (a + middle, b, node, 1)]
        self.first, self.last, self.child, self.lo, self.hi = (np.array(x) for x in (self.first, self.last, self.child, self.lo, self.hi))

    def within(self, queries: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, point) pairs at most the radius apart, in parts of bounded size."""
        for start in range(0, len(queries), 4096):
            q, node = np.arange(start, min(start + 4096, len(queries))), np.zeros(min(4096, len(queries) - start), np.int64)
            leaves = []
            while len(q):
                x = queries[q]
                gap = np.maximum(np.maximum(self.lo[node] - x, x - self.hi[node]), 0)
                near = np.einsum("ij,ij->i", gap, gap) <= radius * radius
                q, node = q[near], node[near]
                leaf = self.child[node, 0] < 0
                leaves.append((q[leaf], node[leaf]))
                q, node = q[~leaf], node[~leaf]
                q, node = np.concatenate((q, q)), np.concatenate((self.child[node, 0], self.child[node, 1]))
            q, node = (np.concatenate(x) for x in zip(*leaves))
            sizes = self.last[node] - self.first[node]
            ends = np.cumsum(sizes)
            a = 0
            while a < len(q):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS_AT_ONCE, "right")))
                yield from self._compare(queries, q[a:b], node[a:b], sizes[a:b], radius)
                a = b

    def _compare(self, queries, q, node, sizes, radius):
        offsets = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        points = self.order[np.repeat(self.first[node], sizes) + offsets]
        q = np.repeat(q, sizes)
        for a in range(0, len(q), PAIRS_AT_ONCE):
            gap = queries[q[a : a + PAIRS_AT_ONCE]] - self.points[points[a : a + PAIRS_AT_ONCE]]
            near = np.einsum("ij,ij->i", gap, gap) <= radius * radius
            yield q[a : a + PAIRS_AT_ONCE][near], points[a : a + PAIRS_AT_ONCE][near]


QUERY, INDEX = 1, 2


def places(points: DataFrame) -> DataFrame:
    """(id, place_id, lat, lng), once each: the usable points, those at equal coordinates under one place_id, a hash of
    these. Rows without an id or with unusable coordinates drop out; an id at several places has a row for each."""
    usable = usable_coordinates(points, "id", F.col("lat"), F.col("lng"))
    return usable.select("id", F.xxhash64("lat", "lng").alias("place_id"), "lat", "lng").distinct()


def near_places(members: DataFrame, radius_km: float, *, sample_points: int = SAMPLE_POINTS, cell_points: int = CELL_POINTS) -> DataFrame:
    """(place_a, place_b), place_a < place_b, once each: the places at most radius_km apart along the great circle.

    members: rows of places(); any number of ids at one place cost the same. Split planes come from a sample of
    sample_points places; every place is indexed. A cell that holds far more points than the others, as points closer
    than the sample can tell apart, is dealt into blocks of query rows against blocks of index rows.
    """
    spark = members.sparkSession
    spots = members.select("place_id", "lat", "lng").dropDuplicates(["place_id"])
    total = spots.count()
    sample = bounded_sample(spots, "place_id", sample_points, total).select("lat", "lng").toPandas()
    cells = min(MAX_CELLS, max(-(-total // cell_points), min(2 * parallelism(spark), total // 500)))
    splits = Splits(unit_vectors(sample["lat"].to_numpy(), sample["lng"].to_numpy()), total, max(1, cells), cell_points)
    chord = 2 * np.sin(min(np.pi / 2, radius_km / EARTH_RADIUS_KM / 2))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xyz = unit_vectors(batch.column("lat").to_numpy(), batch.column("lng").to_numpy())
            at, cell, home = splits.assign(xyz, chord * (1 + 1e-9))
            place = batch.column("place_id").to_numpy()
            blocks, mine = splits.blocks[cell], place[at] % 1_000_000_007
            key, role, row = [cell[blocks == 1] * 1_000_000], [np.where(home, QUERY | INDEX, INDEX)[blocks == 1]], [at[blocks == 1]]
            for i in np.flatnonzero(blocks > 1):
                n, block = int(blocks[i]), int(mine[i] % blocks[i])
                pairs = [(block, j, QUERY) for j in range(n)] * bool(home[i]) + [(j, block, INDEX) for j in range(n)]
                key.append(np.array([cell[i] * 1_000_000 + a * 1000 + b for a, b, _ in pairs]))
                role.append(np.array([r for _, _, r in pairs]))
                row.append(np.full(len(pairs), at[i]))
            key, role, row = (np.concatenate(x) for x in (key, role, row))
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(role.astype(np.int32)), pa.array(place[row]), pa.array(xyz[row, 0]), pa.array(xyz[row, 1]), pa.array(xyz[row, 2])], names=["key", "role", "place_id", "x", "y", "z"])

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(parts))
        place, role = rows.column("place_id").to_numpy(), rows.column("role").to_numpy()
        xyz = np.column_stack([rows.column(c).to_numpy() for c in "xyz"])
        asked, held = np.flatnonzero(role & QUERY), np.flatnonzero(role & INDEX)
        if len(asked) and len(held):
            for q, p in LocalTree(xyz[held]).within(xyz[asked], chord):
                a, b = place[asked[q]], place[held[p]]
                yield pa.RecordBatch.from_arrays([pa.array(a[a < b]), pa.array(b[a < b])], names=["place_a", "place_b"])

    dealt = spots.mapInArrow(deal, "key bigint, role int, place_id bigint, x double, y double, z double")
    return dealt.groupBy("key").applyInArrow(search, "place_a bigint, place_b bigint")


def near_pairs(points: DataFrame, radius_km: float, *, sample_points: int = SAMPLE_POINTS, cell_points: int = CELL_POINTS) -> DataFrame:
    """(id_a, id_b), id_a < id_b, once each: the pairs of ids at most radius_km apart along the great circle.

    points: (id STRING, lat, lng); other columns are ignored. Rows without an id or with coordinates that are null, not
    finite or out of range are left out. Rows that repeat an id count once, as do ids that are near at several places;
    an id is never paired with itself; points at the same place are pairs. An empty table gives an empty result. Places
    are compared, not points: places() and near_places() are the same result without the pairs of ids spelled out.
    """
    members = places(points)
    links = near_places(members, radius_km, sample_points=sample_points, cell_points=cell_points)
    one, two = members.select(F.col("place_id").alias("place_a"), F.col("id").alias("x")), members.select(F.col("place_id").alias("place_b"), F.col("id").alias("y"))
    across = links.join(one, "place_a").join(two, "place_b").filter("x <> y")
    inside = one.join(two.withColumnRenamed("place_b", "place_a"), "place_a").filter("x < y")
    return across.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).unionByName(inside.select(F.col("x").alias("id_a"), F.col("y").alias("id_b"))).distinct()


def edges_of(zones: list[tuple[str, list[tuple[float, float]]]]) -> tuple[list[str], np.ndarray]:
    """Zone ids and the edges (zone, x1, y1, x2, y2), x1 < x2, of their closed outlines; upright edges meet no sweep line."""
    names, rows = [], []
    for name, outline in zones:
        if len(outline) < 3 or not np.isfinite(np.array(outline, float)).all():
            continue
        for (y1, x1), (y2, x2) in zip(outline, [*outline[1:], outline[0]]):
            if x1 != x2:
                rows.append((len(names), *((x1, y1, x2, y2) if x1 < x2 else (x2, y2, x1, y1))))
        names.append(name)
    return names, np.array(rows, float).reshape(-1, 5)


class Slabs:
    """A line swept over the edges, prepared once: between two ends of edges, in a slab, the edges that it meets stay
    the same; a point is inside a zone if an odd number of the zone's edges lie below it.

    Slabs come in sections of at most SECTION_EDGES (slab, edge) entries, or of one slab; only sections with points are
    visited, and one section is kept between calls.
    """

    def __init__(self, edges: np.ndarray):
        edges = edges[np.argsort(edges[:, 0], kind="stable")]
        self.zone, self.x, self.y = edges[:, 0].astype(np.int64), edges[:, 1], edges[:, 2]
        self.slope = (edges[:, 4] - edges[:, 2]) / (edges[:, 3] - edges[:, 1])
        self.stops = np.unique(edges[:, [1, 3]])
        self.first, self.last = np.searchsorted(self.stops, edges[:, 1]), np.searchsorted(self.stops, edges[:, 3])
        met = np.cumsum(np.bincount(self.first, minlength=len(self.stops) + 1) - np.bincount(self.last, minlength=len(self.stops) + 1))
        self.section = np.cumsum(met) // SECTION_EDGES
        self.kept: tuple[int, np.ndarray, np.ndarray, int] | None = None

    def _entries(self, section: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(edges by slab and zone, where each slab's begin, first slab) of a section."""
        if self.kept is None or self.kept[0] != section:
            lo, hi = np.searchsorted(self.section, section, "left"), np.searchsorted(self.section, section, "right")
            first, last = np.maximum(self.first, lo), np.minimum(self.last, hi)
            size = np.maximum(last - first, 0)
            edge = np.repeat(np.arange(len(size)), size)
            slab = np.repeat(first, size) + np.arange(len(edge)) - np.repeat(np.cumsum(size) - size, size)
            order = np.argsort(slab, kind="stable")
            self.kept = (section, edge[order], np.searchsorted(slab[order], np.arange(lo, hi + 1)), int(lo))
        return self.kept[1:]

    def holding(self, lng: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, zone) pairs of the zones that hold a point, at its longitude or a whole turn beside it."""
        nothing = np.zeros(0, np.int64)
        if not len(self.stops) or not len(lng):
            return nothing, nothing
        x = np.concatenate([lng + turn for turn in HALF_WORLDS])
        which, y = np.tile(np.arange(len(lng)), len(HALF_WORLDS)), np.tile(lat, len(HALF_WORLDS))
        slab = np.searchsorted(self.stops, x, "right") - 1
        rows = np.flatnonzero((slab >= 0) & (slab < len(self.stops) - 1))
        rows = rows[np.argsort(slab[rows], kind="stable")]
        found = [(nothing, nothing)]
        for section in np.unique(self.section[slab[rows]]):
            edges, starts, lo = self._entries(int(section))
            own = rows[self.section[slab[rows]] == section]
            begin = starts[slab[own] - lo]
            size = starts[slab[own] - lo + 1] - begin
            ends = np.cumsum(size)
            a = 0
            while a < len(own):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS_AT_ONCE, "right")))
                n = size[a:b]
                point = np.repeat(own[a:b], n)
                edge = edges[np.repeat(begin[a:b], n) + np.arange(len(point)) - np.repeat(np.cumsum(n) - n, n)]
                if len(point):
                    below = self.y[edge] + (x[point] - self.x[edge]) * self.slope[edge] < y[point]
                    run = np.flatnonzero(np.concatenate(([True], (point[1:] != point[:-1]) | (self.zone[edge[1:]] != self.zone[edge[:-1]]))))
                    odd = run[np.add.reduceat(below, run, dtype=np.int64) % 2 == 1]
                    found.append((which[point[odd]], self.zone[edge[odd]]))
                a = b
        return tuple(np.concatenate(x) for x in zip(*found))


def points_in_regions(points: DataFrame, zones: DataFrame, *, broadcast_vertices: int = BROADCAST_VERTICES) -> DataFrame:
    """(id_a, id_b): a point's id and the zone_id of a zone that contains it, in the plane of degrees.

    points: (id, lat, lng); zones: (zone_id, outline ARRAY<STRUCT<lat, lng>>); other columns are ignored. Unusable
    points, zones without an id, and zones with fewer than three or unusable corners are left out. A point counts as inside at lng,
    lng + 360 or lng - 360; overlapping zones each give a row; repeated rows give one row each pair. An empty table
    gives an empty result. Up to broadcast_vertices corners the edges travel to the points, which then need no shuffle;
    above it, points and edges meet by stripes of longitude, each stripe's points salted over several tasks.
    """
    spark = points.sparkSession
    points = usable_coordinates(points, "id", F.col("lat"), F.col("lng"))
    zones = zones.select(F.col("zone_id").cast("string").alias("zone_id"), "outline").filter("zone_id IS NOT NULL AND outline IS NOT NULL")
    corners = zones.agg(F.coalesce(F.sum(F.size("outline")), F.lit(0))).first()[0]
    schema = "id_a string, id_b string"

    def inside(ids: pa.Array, lng: np.ndarray, lat: np.ndarray, names: pa.Array, slabs: Slabs) -> pa.RecordBatch:
        point, zone = slabs.holding(lng, lat)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(point)), names.take(pa.array(zone))], names=["id_a", "id_b"])

    if corners <= broadcast_vertices:
        outlines = [(r.zone_id, [(np.nan if c is None or c.lat is None else c.lat, np.nan if c is None or c.lng is None else c.lng) for c in r.outline]) for r in zones.collect()]
        names, edges = edges_of(outlines)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            slabs, zone_ids = Slabs(edges), pa.array(names, pa.string())
            for batch in batches:
                yield inside(batch.column("id"), batch.column("lng").to_numpy(), batch.column("lat").to_numpy(), zone_ids, slabs)

        return points.mapInArrow(run, schema).distinct()

    ring = zones.filter("size(outline) >= 3 AND forall(outline, c -> c.lat IS NOT NULL AND c.lng IS NOT NULL AND abs(c.lat) < double('inf') AND abs(c.lng) < double('inf'))")
    edge = ring.select("zone_id", F.explode(F.expr("transform(sequence(0, size(outline) - 1), i -> struct(outline[i] AS a, outline[(i + 1) % size(outline)] AS b))")).alias("e"))
    edge = edge.select("zone_id", F.explode(F.array(*(F.lit(turn) for turn in HALF_WORLDS))).alias("turn"), "e").selectExpr("zone_id", "e.a.lng + turn AS xa", "e.a.lat AS ya", "e.b.lng + turn AS xb", "e.b.lat AS yb").filter("xa <> xb")
    edge = edge.selectExpr("zone_id", "least(xa, xb) AS x1", "if(xa < xb, ya, yb) AS y1", "greatest(xa, xb) AS x2", "if(xa < xb, yb, ya) AS y2")
    salts = parallelism(spark)
    stripe = f"CAST(floor({{}} / {STRIPE_DEGREES}) AS BIGINT)"
    west, east = int(-360 / STRIPE_DEGREES), int(360 / STRIPE_DEGREES)
    edge = edge.filter("x2 >= -360 AND x1 <= 360").withColumn("stripe", F.expr(f"explode(sequence(greatest({west}L, {stripe.format('x1')}), least({east}L, {stripe.format('x2')})))")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = points.withColumn("stripe", F.expr(stripe.format("lng"))).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))

    def meet(own: pa.Table, lines: pa.Table) -> pa.Table:
        names, zone = np.unique(np.array(lines.column("zone_id").to_pylist(), object), return_inverse=True) if lines.num_rows else (np.zeros(0, object), np.zeros(0, int))
        edges = np.column_stack([zone, *(lines.column(c).to_numpy() for c in ("x1", "y1", "x2", "y2"))]).astype(float).reshape(-1, 5)
        return pa.Table.from_batches([inside(own.column("id").combine_chunks(), own.column("lng").to_numpy(), own.column("lat").to_numpy(), pa.array(list(names), pa.string()), Slabs(edges))])

    return dealt.groupBy("stripe", "salt").cogroup(edge.groupBy("stripe", "salt")).applyInArrow(meet, schema).distinct()


def near_or_inside(points: DataFrame, zones: DataFrame, radius_km: float) -> DataFrame:
    """The rows of near_pairs and points_in_regions together."""
    return near_pairs(points, radius_km).unionByName(points_in_regions(points, zones))
