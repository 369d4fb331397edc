"""Encoding of texts with a public byte-level BPE vocabulary.

Texts are cut by the vocabulary's split pattern; every piece is merged on a contiguous array of part boundaries and
the ranks of adjacent parts: scan for the lowest rank, delete that boundary, refresh the two neighbouring ranks.
Pieces longer than LONG bytes take the same merges from a heap, as the scan is quadratic in the piece.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexlake.runtime import spread

TOKENIZER_DIR = os.environ.get("CODEXLAKE_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"

NO_RANK = 1 << 30
LONG = 160
MEMO_UNITS = 400_000

# The code points with Unicode's White_Space property.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
SPACED = re.compile(f" [{WHITE_SPACE}]")
# The contractions that the vocabulary's pattern splits off.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def _ranges(points: list[int]) -> str:
    out, start = [], None
    for a, b in zip(points, [*points[1:], -2]):
        start = a if start is None else start
        if b != a + 1:
            out.append(f"{re.escape(chr(start))}-{re.escape(chr(a))}")
            start = None
    return "".join(out)


@lru_cache(maxsize=1)
def split_pattern() -> re.Pattern:
    """The vocabulary's pattern in terms of the standard library: letters, numbers, other marks and white space."""
    odd = [i for i in range(sys.maxunicode + 1) if unicodedata.category(chr(i)) in ("Nl", "No")]
    space, number = re.escape(WHITE_SPACE), r"\d" + _ranges(odd)
    letter = rf"[^\W_{number}]"
    return re.compile("|".join((*CONTRACTIONS, rf" ?{letter}+", rf" ?[{number}]+", rf" ?(?:[^\w{space}]|_)+", rf"[{space}]+(?![^{space}])", rf"[{space}]+")))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_scan(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a short piece by the contiguous rank array."""
    n = len(piece)
    bounds = list(range(n + 1))
    near = [ranks.get(piece[i : i + 2], NO_RANK) for i in range(n - 1)]
    while near:
        low = min(near)
        if low == NO_RANK:
            break
        i = near.index(low)
        del bounds[i + 1], near[i]
        if i < len(near):
            near[i] = ranks.get(piece[bounds[i] : bounds[i + 2]], NO_RANK)
        if i:
            near[i - 1] = ranks.get(piece[bounds[i - 1] : bounds[i + 1]], NO_RANK)
    return [ranks[piece[a:b]] for a, b in zip(bounds, bounds[1:])]


def merge_heap(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids for a long piece in n log n: a heap of (rank, start) over a linked list of parts."""
    n = len(piece)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n

    def rank(i: int) -> int:
        j = after[i]
        return ranks.get(piece[i : end[j]], NO_RANK) if j < n else NO_RANK

    heap = [(r, i, end[i + 1]) for i in range(n - 1) if (r := rank(i)) != NO_RANK]
    heapq.heapify(heap)
    while heap:
        r, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop or end[i] != j:
            continue
        alive[j], end[i], after[i] = False, end[j], after[j]
        if after[i] < n:
            before[after[i]] = i
        for k in (i, before[i]):
            if k >= 0 and (r := rank(k)) != NO_RANK:
                heapq.heappush(heap, (r, k, end[after[k]]))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class Encoder(dict):
    """text -> ids. The dictionary itself is the memo of space-led units.

    A piece of the pattern can hold a space only as its first character or in a run of white space, so a text in which
    no space stands first, last or before other white space falls apart at its spaces into units whose pieces do not
    depend on each other. Other texts go through the pattern as a whole.
    """

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.pieces, self.find = ranks, {}, split_pattern().findall

    def piece(self, piece: str) -> list[int]:
        found = self.pieces.get(piece)
        if found is None:
            raw = piece.encode("utf-8", "replace")
            whole = self.ranks.get(raw)
            found = [whole] if whole is not None else (merge_scan if len(raw) <= LONG else merge_heap)(raw, self.ranks)
            if len(self.pieces) >= MEMO_UNITS:
                self.pieces.clear()
            if len(raw) <= LONG:
                self.pieces[piece] = found
        return found

    def plain(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.piece, self.find(text))))

    def __missing__(self, unit: str) -> list[int]:
        found = self.plain(" " + unit)
        if len(unit) <= LONG:
            if len(self) >= MEMO_UNITS:
                self.clear()
            self[unit] = found
        return found

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; null and empty texts give none."""
        if not text:
            return []
        if text[0] == " " or text[-1] == " " or SPACED.search(text):
            return self.plain(text)
        first, *rest = text.split(" ")
        return [*self.plain(first), *chain.from_iterable(map(self.__getitem__, rest))]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and vocabulary."""
    return Encoder(load_ranks(path))


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer_dir: str = TOKENIZER_DIR, vocabulary: str = BYTE_BPE_50K, counts_only: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, ids ARRAY<INT>), or (id, *keep, n_tokens BIGINT) with counts_only; a row for each row of df.

    No shuffle, unless the table has fewer files than the cluster cores. Null and empty texts give an empty list (0 tokens); a null id stays
    null; repeated rows are encoded each; an empty table gives an empty table; special tokens are never produced,
    their strings are ordinary text. Other columns of df are not read.
    """
    path = f"{tokenizer_dir}/{vocabulary}"
    source = spread(df.select(F.col(id_col), *(F.col(c) for c in keep), F.col(text_col).cast("string").alias("__text")), id_col)
    out_schema = source.drop("__text").withColumn(*(("n_tokens", F.lit(0).cast("bigint")) if counts_only else ("ids", F.lit(None).cast("array<int>")))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            ids = [encode(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            if counts_only:
                made = pa.array(sizes)
            else:
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))
                made = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(flat))
            names = [*batch.schema.names[:-1], out_schema.names[-1]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names=names)

    return source.mapInArrow(run, out_schema)
