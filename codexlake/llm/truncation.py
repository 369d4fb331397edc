"""Texts that were cut off: a backward character n-gram model of how texts end against how they go on.

The model reads a value backwards from its end. For the contexts that stand at the ends of values it counts, for each
language and column, how often each stands at an end and how often it stands inside a text, where the text goes on. A
value is cut if the log-odds of end against continuation, in the longest context with enough evidence, lie below the
threshold of its language and column. A longer context with evidence only from all groups together, measured against
the average of all, counts before a shorter one of the value's own group; without any evidence a value is never cut.
"""

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codexlake.runtime import spread

from .spans import BASE, CHUNK, _powers, scramble

ORDERS = (1, 2, 3, 5, 8, 11, 15, 20, 26)
#: A context is used if it ends at least MIN_ENDS values of its group and one in ENDS_SHARE, more than copies of one text
#: make up, or if the group's texts go on after it MIN_INSIDE times and it is LONG_CONTEXT symbols long or one or two.
MIN_ENDS, ENDS_SHARE, LONG_CONTEXT, MIN_INSIDE = 5, 600, 8, 100
#: The judged value itself is taken out of its context's ends, and this left in.
UNSEEN_END = 0.1
#: A context stays in the model if it ends as many values as N // MODEL_SHARE of all N or is used by its ends in a group:
#: less than 2 * MODEL_SHARE contexts an order, and 2 * ENDS_SHARE a group and order.
MODEL_SHARE = 500_000
#: Languages of fewer values than one in GROUP_SHARE are judged by all groups together: at most so many groups are told apart.
GROUP_SHARE = 10_000
#: Counters that one task holds before it passes them on.
COUNTERS = 8_000_000
#: A complete value ends in a context that ends values e**MARGIN times as often as an average context of its group.
MARGIN = 2.7
#: What an ellipsis or broken character after the text takes from its log-odds.
MARK_WEIGHT = 5.0
SHORT_TAIL, TAIL = 384, 2_048
NAME_LETTERS = 4

# Marks that a transfer leaves behind where it cuts a text.
CUT_MARKS = ("…", "...", "[...]", "[…]", "(...)", "(…)", "�")
#: In Java's syntax: a character that no trailing mark or white space has.
_TELLING = r"(?U)[^\s\x1c-\x1f….\[\]()\ufffd]"

_NAME, _INITIAL, _DIGIT = 0xE000, 0xE001, 0x30
_LIMIT = 0x3000
_LETTER, _UPPER, _NUMBER = 1, 2, 4


_LONGEST_FIRST = sorted(CUT_MARKS, key=len, reverse=True)


def bare(text: str) -> str:
    """The text without the white space and cut marks at its end."""
    end = len(text)
    while end:
        if text[end - 1].isspace():
            end -= 1
            continue
        mark = next((m for m in _LONGEST_FIRST if text.endswith(m, 0, end)), None)
        if mark is None:
            break
        end -= len(mark)
    return text[:end]


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    out = np.full(_LIMIT + 1, _LETTER, np.uint8)
    for i in range(_LIMIT):
        kind = unicodedata.category(chr(i))
        out[i] = (_LETTER if kind[0] in "LM" else 0) | (_UPPER if kind in ("Lu", "Lt") else 0) | (_NUMBER if kind == "Nd" else 0)
    return out


@lru_cache(maxsize=1)
def _lowered() -> np.ndarray:
    return np.array([ord(low) if len(low := chr(i).lower()) == 1 else i for i in range(_LIMIT + 1)], np.uint32)


def symbols(codes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters with what is particular taken out: digits become one digit, capitalised words of NAME_LETTERS letters
    or more one symbol, single capitals another; the rest is in lower case, as are words all in capitals."""
    if not len(codes):
        return codes, doc
    kind = _classes()[np.minimum(codes, _LIMIT)]
    letter = (kind & _LETTER) > 0
    fresh = np.concatenate(([True], doc[1:] != doc[:-1]))
    start = letter & (fresh | ~np.concatenate(([False], letter[:-1])))
    word = np.cumsum(start) - 1
    size = np.bincount(word[letter], minlength=int(start.sum()))
    capital = (kind[start] & _UPPER) > 0
    shouted = (np.bincount(word[letter], weights=(kind[letter] & _UPPER) > 0, minlength=len(size)) == size) & (size > 1)
    capital &= ~shouted
    out = _lowered()[np.minimum(codes, _LIMIT)]
    out = np.where(codes < _LIMIT, out, codes)
    out[(kind & _NUMBER) > 0] = _DIGIT
    first = np.flatnonzero(start)
    out[first[capital & (size >= NAME_LETTERS)]] = _NAME
    out[first[capital & (size == 1)]] = _INITIAL
    inner = letter & ~start
    inner[inner] = (capital & (size >= NAME_LETTERS))[word[inner]]
    return out[~inner], doc[~inner]


def _sums(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = _powers(max(CHUNK * 2, 1 << int(len(codes) + 1).bit_length()))
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(scramble(codes.astype(np.uint64) + BASE) * power[: len(codes)], dtype=np.uint64))), inverse


def _hashes(sums: np.ndarray, inverse: np.ndarray, ends: np.ndarray, order: int) -> np.ndarray:
    return scramble((sums[ends] - sums[ends - order]) * inverse[ends - order])


def _parts(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(symbols, text of each, number of texts) in parts of bounded size; a longer text is a part of its own."""
    held: list[int] = []
    size = 0
    for i in range(len(texts) + 1):
        if held and (i == len(texts) or size + len(texts[i]) > CHUNK):
            codes = np.frombuffer("".join(texts[j] for j in held).encode("utf-32-le", "surrogatepass"), np.uint32)
            doc = np.repeat(np.arange(len(held)), [len(texts[j]) for j in held])
            yield (*symbols(codes, doc), len(held))
            held, size = [], 0
        if i < len(texts):
            held.append(i)
            size += len(texts[i])


def _last(text: str, size: int) -> str:
    """The last `size` characters from a white space on, so that all their words are whole; without one all of them."""
    if len(text) <= size:
        return text
    part = text[-size:]
    return next((part[i:] for i, c in enumerate(part) if c.isspace()), part)


def _end_hashes(texts: list[str]) -> np.ndarray:
    """(value, order) hashes of the final contexts; 0 where the value is shorter than the context.

    Contexts are read off the last SHORT_TAIL characters; where these fold to too few symbols, off the last TAIL.
    """
    out = np.zeros((len(texts), len(ORDERS)), np.uint64)
    for size in (SHORT_TAIL, TAIL):
        left = np.arange(len(texts)) if size == SHORT_TAIL else left[short]
        short, done = np.zeros(len(left), bool), 0
        for codes, doc, n in _parts([_last(texts[i], size) for i in left]):
            sums, inverse = _sums(codes)
            first, last = np.searchsorted(doc, np.arange(n), "left"), np.searchsorted(doc, np.arange(n), "right")
            short[done : done + n] = [last[j] - first[j] < ORDERS[-1] and len(texts[left[done + j]]) > size for j in range(n)]
            for k, order in enumerate(ORDERS):
                some = np.flatnonzero(last - first >= order)
                out[left[done + some], k] = _hashes(sums, inverse, last[some], order)
            done += n
    return out


class _Model:
    """Log-odds of the contexts of each order, in each group and in all; `contexts` are their sorted hashes."""

    def __init__(self, contexts: list[np.ndarray], sizes: np.ndarray, ends: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.contexts, self.sizes, self.ends = contexts, sizes, ends
        self.own: list[tuple[np.ndarray, np.ndarray]] = []
        self.all: list[np.ndarray] = []

    def score(self, inside: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """ends, inside: for each order, context, group and count; group -1 is of those that are not told apart."""
        for k, ((at, group, n), (at_in, group_in, c_in)) in enumerate(zip(self.ends, inside)):
            wide = len(self.contexts[k])
            n_all, c_all = (np.bincount(x, weights=w, minlength=wide) for x, w in ((at, n), (at_in, c_in)))
            self.all.append(self._odds(k, n_all, c_all, np.full(wide, int(self.sizes.sum()))))
            told = np.flatnonzero(group >= 0)
            key = group[told] * wide + at[told]
            order = np.argsort(key)
            told, key = told[order], key[order]
            held = np.zeros(len(key))
            key_in = group_in * wide + at_in
            place = np.minimum(np.searchsorted(key, key_in), max(0, len(key) - 1))
            match = (group_in >= 0) & (key[place] == key_in) if len(key) else np.zeros(len(key_in), bool)
            held[place[match]] = c_in[match]
            self.own.append((key, self._odds(k, n[told], held, self.sizes[group[told]])))

    @staticmethod
    def _odds(k: int, n: np.ndarray, c: np.ndarray, size: np.ndarray) -> np.ndarray:
        known = (n >= np.maximum(MIN_ENDS, size // ENDS_SHARE)) | ((c >= MIN_INSIDE) & (ORDERS[k] <= 2 or ORDERS[k] >= LONG_CONTEXT))
        return np.where(known, np.log((n - 1 + UNSEEN_END).clip(UNSEEN_END) / (c + 0.5)), np.nan)

    def judge(self, found: np.ndarray, group: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """Log-odds of the longest final contexts with evidence, of its own group or else of all groups with its group's
        shift added; nan without evidence."""
        value = np.full(len(found), np.nan)
        for k, h in enumerate(self.contexts):
            if len(h):
                at = np.minimum(np.searchsorted(h, found[:, k]), len(h) - 1)
                known = (h[at] == found[:, k]) & (found[:, k] != 0)
                pooled = np.where(known, self.all[k][at], np.nan)
                value = np.where(np.isnan(pooled), value, pooled + shift[group])
                key, odds = self.own[k]
                if len(key):
                    asked = group * len(h) + at
                    place = np.minimum(np.searchsorted(key, asked), len(key) - 1)
                    mine = np.where(known & (group >= 0) & (key[place] == asked), odds[place], np.nan)
                    value = np.where(np.isnan(mine), value, mine)
        return value


def cut_values(texts: DataFrame, id_col: str, fields: tuple[str, ...], *, lang_col: str | None = None, keep: tuple[str, ...] = (), margin: float = MARGIN) -> DataFrame:
    """(id, field, *keep, log_odds, threshold, is_cut), a row for each field of each row whose text is not null, empty or blank.

    log_odds are those of end against continuation in the value's final context, less MARK_WEIGHT if a cut mark follows
    the text; is_cut says that they lie below the threshold, the average log-odds of the value's language and column
    plus margin. Trailing white space and cut marks, however many, are no context. Language is lang_col in lower case,
    or one for all without it; a null one is a language of its own. Every value of the table trains the model, in full,
    and is judged by it: by the longest context with evidence in its group, or a still longer one with evidence in all
    groups together, measured against the average of all; a value without evidence is not cut, unless a mark follows it. A null id stays null; repeated rows
    count and come out each; an empty table gives an empty result; other columns are ignored. Only the model, bounded
    by MODEL_SHARE and GROUP_SHARE, is gathered.
    """
    spark = texts.sparkSession
    lang = F.coalesce(F.lower(F.trim(F.col(lang_col))), F.lit("")) if lang_col else F.lit("")
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"text_{f}").cast("string").alias("text")) for f in fields)))
    rows = spread(texts.select(F.col(id_col).alias("id"), *(F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)), lang.alias("lang"), *(F.col(f).alias(f"text_{f}") for f in fields)), "id")
    rows = rows.select("id", *(f"keep_{i}" for i in range(len(keep))), "lang", each.alias("r"))
    rows = rows.select("id", *(f"keep_{i}" for i in range(len(keep))), F.col("r.field").alias("field"), F.concat_ws("\t", "lang", "r.field").alias("group"), F.col("r.text").alias("text")).filter(F.col("text").rlike(r"\S"))
    tails = rows.withColumn("text", F.when(F.substring("text", -TAIL, TAIL).rlike(_TELLING), F.substring("text", -2 * TAIL, 2 * TAIL)).otherwise(F.col("text")))

    counts = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    n_values = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    told = counts.filter(F.col("n") * GROUP_SHARE >= n_values).orderBy("group").collect()
    codes = {r["group"]: i for i, r in enumerate(told)}
    sizes = np.array([r["n"] for r in told] + [n_values - sum(r["n"] for r in told)], np.int64)

    def group_codes(batch: pa.RecordBatch) -> np.ndarray:
        return np.array([codes.get(g, -1) for g in batch.column("group").to_pylist()], np.int64)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = group_codes(batch)
            found = _end_hashes([bare(t) for t in batch.column("text").to_pylist()])
            for g in np.unique(group):
                for k in range(len(ORDERS)):
                    h, n = np.unique(found[(found[:, k] != 0) & (group == g), k], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), k, np.int32)), pa.array(np.full(len(h), g, np.int32)), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["k", "g", "h", "n"])

    at_ends = tails.select("group", "text").mapInArrow(ends, "k int, g int, h bigint, n bigint").groupBy("k", "g", "h").agg(F.sum("n").alias("n"))
    used = F.greatest(F.lit(MIN_ENDS), F.floor(F.element_at(F.array(*map(F.lit, sizes.tolist())), F.when(F.col("g") >= 0, F.col("g") + 1).otherwise(F.lit(len(sizes)))) / ENDS_SHARE))
    weighed = at_ends.withColumn("used", F.col("n") >= used).withColumns({"all": F.sum("n").over(Window.partitionBy("k", "h")), "any": F.max("used").over(Window.partitionBy("k", "h"))})
    kept = weighed.filter(F.col("any") | (F.col("all") >= n_values // MODEL_SHARE)).select("k", "g", "h", "n").toArrow()
    k_all, g_all, n_all = (kept.column(c).to_numpy() for c in ("k", "g", "n"))
    h_all = kept.column("h").to_numpy().view(np.uint64)
    contexts, at_end = [], []
    for k in range(len(ORDERS)):
        mine = k_all == k
        h, at = np.unique(h_all[mine], return_inverse=True)
        contexts.append(h)
        at_end.append((at, g_all[mine].astype(np.int64), n_all[mine]))
    table = spark.sparkContext.broadcast(contexts)

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts = table.value
        totals: dict[int, list[np.ndarray]] = {}
        symbols_of: dict[int, int] = {}
        most = max(1, COUNTERS // max(1, sum(map(len, contexts))))

        def passed_on() -> Iterator[pa.RecordBatch]:
            for g, counted in totals.items():
                for k, total in enumerate(counted):
                    some = np.flatnonzero(total)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(np.full(len(some), g, np.int32)), pa.array(some), pa.array(total[some])], names=["k", "g", "at", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([-1] * len(symbols_of), pa.int32()), pa.array(list(symbols_of), pa.int32()), pa.array([0] * len(symbols_of), pa.int64()), pa.array(list(symbols_of.values()), pa.int64())], names=["k", "g", "at", "n"])
            totals.clear()
            symbols_of.clear()

        for batch in batches:
            group, whole = group_codes(batch), [bare(t) for t in batch.column("text").to_pylist()]
            for g in np.unique(group).tolist():
                if g not in totals and len(totals) >= most:
                    yield from passed_on()
                own = totals.setdefault(g, [np.zeros(len(h), np.int64) for h in contexts])
                for codes_in, doc, n in _parts([whole[i] for i in np.flatnonzero(group == g)]):
                    sums, inverse = _sums(codes_in)
                    first = np.searchsorted(doc, np.arange(n), "left")
                    symbols_of[g] = symbols_of.get(g, 0) + len(doc)
                    depth = np.arange(1, len(doc) + 1) - first[doc]
                    end = np.flatnonzero(np.concatenate((doc[1:] == doc[:-1], [False]))) + 1
                    often = np.bincount(codes_in[end - 1])
                    symbol = np.flatnonzero(often)
                    often, (one, inverse_one) = often[symbol], _sums(symbol)
                    h = _hashes(one, inverse_one, np.arange(1, len(symbol) + 1), 1)
                    at = np.minimum(np.searchsorted(contexts[0], h), len(contexts[0]) - 1)
                    hit = contexts[0][at] == h
                    own[0][at[hit]] += often[hit]
                    for k, order in enumerate(ORDERS[1:], 1):
                        if not len(contexts[k]):
                            break
                        end = end[depth[end - 1] >= order]
                        h = _hashes(sums, inverse, end, order)
                        at = np.minimum(np.searchsorted(contexts[k], h), len(contexts[k]) - 1)
                        hit = contexts[k][at] == h
                        own[k] += np.bincount(at[hit], minlength=len(contexts[k]))
                        end = end[hit]
        yield from passed_on()

    counted = rows.select("group", "text").mapInArrow(inside, "k int, g int, at bigint, n bigint").groupBy("k", "g", "at").agg(F.sum("n").alias("n")).toArrow()
    k_in, g_in, at_in, n_in = (counted.column(c).to_numpy() for c in ("k", "g", "at", "n"))
    model = _Model(contexts, sizes, at_end)
    model.score([(at_in[k_in == k], g_in[k_in == k].astype(np.int64), n_in[k_in == k]) for k in range(len(ORDERS))])
    symbols_in = dict(zip(g_in[k_in == -1].tolist(), n_in[k_in == -1].tolist()))
    every = float(np.log((n_values + 0.5) / (sum(symbols_in.values()) + 0.5))) + margin
    limits = np.array([float(np.log((n + 0.5) / (symbols_in.get(g, 0) + 0.5))) + margin for g, n in enumerate(sizes[:-1])] + [every])
    shared = spark.sparkContext.broadcast((model, limits))
    out_schema = tails.drop("text", "group").withColumns({"log_odds": F.lit(0.0), "threshold": F.lit(0.0)}).schema

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, limits = shared.value
        for batch in batches:
            group, raw = group_codes(batch), batch.column("text").to_pylist()
            whole = [bare(t) for t in raw]
            limit = limits[group]
            value = model.judge(_end_hashes(whole), group, limits - limits[-1])
            value = np.where(np.isnan(value), limit, value)
            marked = np.array([bool(t[len(b) :].strip()) for t, b in zip(raw, whole)], bool)
            value = np.where([not b for b in whole], limit, value - MARK_WEIGHT * marked)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c not in ("group", "text")), pa.array(value), pa.array(limit)], names=out_schema.names)

    judged = tails.mapInArrow(judge, out_schema).withColumn("is_cut", F.col("log_odds") < F.col("threshold"))
    return judged.select("id", "field", *(F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)), "log_odds", "threshold", "is_cut")


def cut_shares(values: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(*by, n_values, n_cut, cut_share): how often each source truncates, of judged values."""
    counts = values.groupBy(*by).agg(F.count(F.lit(1)).alias("n_values"), F.count(F.when(F.col("is_cut"), 1)).alias("n_cut"))
    return counts.withColumn("cut_share", F.col("n_cut") / F.col("n_values"))
