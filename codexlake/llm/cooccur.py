"""How often items stand together in one basket, and how much more often than chance: a blocked Gram matrix."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexlake.runtime import parallelism, staged

ITEM_BLOCK = 4096
RECORD_BLOCK = 100_000
PRODUCTS_AT_ONCE = 2_000_000
#: Where there are several item blocks, baskets of at most so many items stay in one task, all their items together.
SMALL_BASKET = 2_000


def gram(record: np.ndarray, left: np.ndarray, right: np.ndarray, n_left: int, n_right: int, right_record: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Non-zero entries (i, j, count) of L'R for two binary sparse matrices given by their (record, item) entries.

    record/left are sorted by item, right_record/right by record. Columns of L are multiplied in blocks: the rows of R
    that a column meets are gathered and counted; a block holds at most PRODUCTS_AT_ONCE gathered entries or cells.
    """
    first = np.searchsorted(right_record, record, "left")
    size = np.searchsorted(right_record, record, "right") - first
    starts = np.searchsorted(left, np.arange(n_left + 1))
    cost = np.add.reduceat(np.append(size, 0), np.minimum(starts[:-1], len(size))) * (starts[1:] > starts[:-1])
    a = 0
    while a < n_left:
        grown = np.cumsum(cost[a : a + max(1, PRODUCTS_AT_ONCE // max(1, n_right))])
        b = a + max(1, int(np.searchsorted(grown, PRODUCTS_AT_ONCE, "right")))
        total = np.zeros((b - a) * n_right, np.int64)
        lo, hi = starts[a], starts[min(b, n_left)]
        ends = np.cumsum(size[lo:hi])
        k = lo
        while k < hi:
            m = lo + max(k - lo + 1, int(np.searchsorted(ends, (ends[k - lo - 1] if k > lo else 0) + PRODUCTS_AT_ONCE, "right")))
            n = size[k:m]
            at = np.repeat(first[k:m], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            total += np.bincount(np.repeat(left[k:m] - a, n) * n_right + right[at], minlength=len(total))
            k = m
        cell = np.flatnonzero(total)
        yield cell // n_right + a, cell % n_right, total[cell]
        a = b


def gram_of_baskets(record: np.ndarray, item: np.ndarray, n_items: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Non-zero entries (i, j, count), i < j, of the Gram matrix of a binary sparse matrix, in parts that may repeat an
    entry; record, item: its entries, sorted by both. Products are formed diagonal by diagonal of the baskets' items."""
    ends = np.searchsorted(record, record, "right")
    rows, step = np.arange(len(record)), 1
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held: list[np.ndarray] = []
    waiting = 0
    while True:
        left = rows[rows + step < ends[rows]]
        rows = left
        held.append(item[left].astype(np.int64) * n_items + item[left + step])
        waiting += len(left)
        step += 1
        if waiting > PRODUCTS_AT_ONCE or not len(left):
            fresh, many = np.unique(np.concatenate(held), return_counts=True)
            both, at = np.unique(np.concatenate((keys, fresh)), return_inverse=True)
            keys, counts = both, np.bincount(at, weights=np.concatenate((counts, many)), minlength=len(both)).astype(np.int64)
            held, waiting = [], 0
            if len(keys) > PRODUCTS_AT_ONCE or not len(left):
                yield keys // n_items, keys % n_items, counts
                keys, counts = keys[:0], counts[:0]
        if not len(left):
            return


def together(baskets: DataFrame, basket: str, item: str | Column, *, min_together: int = 1, min_share_of: int | None = None, min_lift: float | None = None) -> DataFrame:
    """(item_a, item_b, n_a, n_b, n_ab, n_baskets, lift), item_a < item_b in binary order, a row for each pair that meets the limits.

    n_ab baskets hold both; lift is n_ab * n_baskets / (n_a * n_b). Limits: n_ab >= min_together, min_share_of * n_ab
    >= n_baskets, lift >= min_lift (compared without division). Rows with a null basket or item are left out, a
    repeated item counts once in a basket, an empty string is an item, an empty table gives an empty result; other
    columns are ignored. Items rarer than the limits allow for any pair are dropped before the product, which loses no
    pair. Entries are dealt to (record block, item block, item block); each task sums its transpose-products and sends
    one count a pair, so that no basket and no item is ever expanded across the network. Where items fill several
    blocks, only baskets of more than SMALL_BASKET items are dealt to pairs of blocks, a copy for each; the entries of
    other baskets go to one task of their record block, once.
    """
    spark = baskets.sparkSession
    entries = baskets.select(F.col(basket).alias("basket"), (F.col(item) if isinstance(item, str) else item).cast("string").alias("item"))
    entries = staged(entries.filter("basket IS NOT NULL AND item IS NOT NULL").distinct(), "baskets")
    n_baskets = entries.agg(F.countDistinct("basket")).first()[0]
    least = max(min_together, -(-n_baskets // min_share_of) if min_share_of else 1)
    counts = staged(entries.groupBy("item").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least), "items")
    kept, rows = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    item_blocks, record_blocks = max(1, -(-kept // ITEM_BLOCK)), max(parallelism(spark), -(-rows // RECORD_BLOCK))

    block = F.pmod(F.xxhash64("item"), F.lit(item_blocks)).cast("int")
    chosen = entries.join(counts.select("item"), "item", "left_semi")
    record = (F.pmod(F.xxhash64("basket"), F.lit(record_blocks)).alias("record_block"), F.xxhash64("basket").alias("record"))
    large = chosen
    if item_blocks > 1:
        chosen = staged(chosen, "baskets-kept")
        large_baskets = chosen.groupBy("basket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SMALL_BASKET).select("basket")
        large, small = chosen.join(large_baskets, "basket", "left_semi"), chosen.join(large_baskets, "basket", "left_anti")
    dealt = large.select(*record, "item", block.alias("own"))
    other = F.explode(F.sequence(F.lit(0), F.lit(item_blocks - 1)))
    dealt = dealt.withColumn("other", other).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))

    def multiply_small(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(parts))
        names, code = np.unique(np.array(rows.column("item").to_pylist(), object), return_inverse=True)
        record = rows.column("record").to_numpy()
        order = np.lexsort((code, record))
        for a, b, n in gram_of_baskets(record[order], code[order], len(names)):
            yield pa.RecordBatch.from_arrays([pa.array(names[a], pa.string()), pa.array(names[b], pa.string()), pa.array(n)], names=["item_a", "item_b", "n_ab"])

    def multiply(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(parts))
        record, own = rows.column("record").to_numpy(), rows.column("own").to_numpy()
        names, code = np.unique(np.array(rows.column("item").to_pylist(), object), return_inverse=True)
        i, j = key[1].as_py(), key[2].as_py()
        sides = []
        for side in (i, j):
            mine = own == side
            local, ids = np.unique(code[mine], return_inverse=True)
            sides.append((record[mine], local, ids))
        (rec_l, local_l, left), (rec_r, local_r, right) = sides
        by_item, by_record = np.lexsort((rec_l, left)), np.lexsort((right, rec_r))
        for a, b, n in gram(rec_l[by_item], left[by_item], right[by_record], len(local_l), len(local_r), rec_r[by_record]):
            a, b = local_l[a], local_r[b]
            use = a < b if i == j else a != b
            a, b, n = a[use], b[use], n[use]
            yield pa.RecordBatch.from_arrays([pa.array(names[np.minimum(a, b)], pa.string()), pa.array(names[np.maximum(a, b)], pa.string()), pa.array(n)], names=["item_a", "item_b", "n_ab"])

    products = dealt.groupBy("record_block", "i", "j").applyInArrow(multiply, "item_a string, item_b string, n_ab bigint")
    if item_blocks > 1:
        products = products.unionByName(small.select(*record, "item").groupBy("record_block").applyInArrow(multiply_small, "item_a string, item_b string, n_ab bigint"))
    sums = products.groupBy("item_a", "item_b").agg(F.sum("n_ab").alias("n_ab")).filter(F.col("n_ab") >= least)
    result = sums.join(counts.select(F.col("item").alias("item_a"), F.col("n").alias("n_a")), "item_a").join(counts.select(F.col("item").alias("item_b"), F.col("n").alias("n_b")), "item_b")
    if min_lift is not None:
        result = result.filter(F.col("n_ab") * F.lit(n_baskets) >= F.lit(min_lift) * F.col("n_a") * F.col("n_b"))
    lift = F.col("n_ab") * F.lit(float(n_baskets)) / (F.col("n_a") * F.col("n_b"))
    return result.select("item_a", "item_b", "n_a", "n_b", "n_ab", F.lit(n_baskets).cast("bigint").alias("n_baskets"), lift.alias("lift"))
