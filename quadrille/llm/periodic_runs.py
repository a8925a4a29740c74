"""Maximal periodic runs of words, by internal pattern matching.

A run is a stretch of words with smallest period ``q`` and length of at least
``max(LEAST, EXPONENT * q)`` that no neighbouring word extends with that period.

Documents are independent rows, so Spark deals them out as they lie in the table:
nothing is exchanged.  Inside a task the words of about ``TEXT_BYTES`` of text
become one sequence of word numbers (equal exactly if the words are) with a
number of its own behind every document, so that no run crosses documents.

1. Prefix doubling names all blocks of ``2^k`` words, for every ``k``, and ends
   with the suffix array; blocks of one name are a range of it.
2. Every dyadic block (at a multiple of its length ``B``, from 2 words) asks for
   its occurrences in the windows of ``B`` places before and behind it: range
   successor queries in a wavelet tree over the suffix array, all blocks at once.
3. Occurrences in so short a window form an arithmetic progression; its difference,
   the distance of the nearest one, is a candidate period ``p``, kept where
   ``B / 2 < p <= B`` (or ``p = 1``, ``B = 2``).  A run of exponent 4 or more holds a
   dyadic block of at least ``q`` and less than ``2 q`` words with room for another
   occurrence ``q`` before or behind it; a nearer one would give a smaller period.
4. Names of blocks, tried from the longest down, extend each candidate to both
   sides as far as the period holds; equal runs fall together.

Every run is found, whatever its length: a text is never cut.  A null or empty
text has no words and no run.  Repeated rows, null ids and ties are rows like
others.  Extra columns are ignored.  An empty table gives an empty result.  A task
holds one slice at a time, or one longer text, about ``4 log2(n)`` bytes a word twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import text_or_empty, texts_of
from quadrille.llm.textkit import releasing, slices, spaces_table, text_buffer

EXPONENT = 4
LEAST = 6
TEXT_BYTES = 1 << 20
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
SPACES = spaces_table()


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the rows, and the index of each row's first (one entry more)."""
    data, offsets = text_buffer(texts)
    n = len(data)
    inside = np.append(~SPACES[data], False)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside[:n] & (cut[:n] | ~np.append(False, inside[:n - 1])[:n]))
    ends = np.flatnonzero(inside[:n] & (cut[1:] | ~inside[1:])) + 1
    lengths = ends - starts
    upto = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    letters = data[inside[:n]]
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(upto), pa.py_buffer(np.ascontiguousarray(letters)))
    return words, np.searchsorted(starts, offsets)


def block_names(codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """``(suffix array, names)``; ``names[k][i]`` names the ``2^k`` symbols from ``i``.

    A name is the place where the block's suffixes begin in the suffix array, so
    names of longer blocks refine those of shorter ones.  The last symbol is met
    once.  Only suffixes that still share their name are sorted again.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    sorted_ = codes[order]
    fresh = np.append(True, sorted_[1:] != sorted_[:-1])
    name = np.empty(n, np.int64)
    name[order] = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    names, width = [name.astype(np.int32)], 1
    while True:
        # places of the suffix array whose name is shared
        open_ = ~(fresh & np.append(fresh[1:], True))
        at = np.flatnonzero(open_)
        if not len(at):
            return order, names
        who = order[at]
        follow = np.where(who + width < n, name[np.minimum(who + width, n - 1)] + 1, 0)
        group = name[who]
        moved = np.lexsort((follow, group))
        who, group, follow = who[moved], group[moved], follow[moved]
        order[at] = who
        new = np.append(True, (group[1:] != group[:-1]) | (follow[1:] != follow[:-1]))
        fresh[at] = new
        name[who] = at[np.flatnonzero(new)[np.cumsum(new) - 1]]
        names.append(name.astype(np.int32))
        width *= 2


class WaveletTree:
    """Over a permutation: counts of smaller values and order statistics of ranges."""

    def __init__(self, values: np.ndarray):
        self.depth = max(1, int(len(values) - 1).bit_length())
        self.zeros, self.left = [], []
        for bit in range(self.depth - 1, -1, -1):
            low = ((values >> bit) & 1) == 0
            upto = np.zeros(len(values) + 1, np.int32)
            np.cumsum(low, out=upto[1:])
            self.zeros.append(upto)
            self.left.append(int(upto[-1]))
            values = np.concatenate([values[low], values[~low]])

    def smaller(self, l: np.ndarray, r: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values in places ``l <= place < r`` are less than ``x``."""
        count = np.zeros(len(l), np.int64)
        for level, (upto, left) in enumerate(zip(self.zeros, self.left)):
            high = (x >> (self.depth - 1 - level)) & 1 == 1
            zl, zr = upto[l], upto[r]
            count += np.where(high, zr - zl, 0)
            l, r = np.where(high, l - zl + left, zl), np.where(high, r - zr + left, zr)
        return count

    def nth(self, l: np.ndarray, r: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value with ``k`` smaller ones in places ``l <= place < r``."""
        value, k = np.zeros(len(l), np.int64), k.copy()
        for upto, left in zip(self.zeros, self.left):
            zl, zr = upto[l], upto[r]
            zeros = zr - zl
            high = k >= zeros
            k -= np.where(high, zeros, 0)
            value = value * 2 + high
            l, r = np.where(high, l - zl + left, zl), np.where(high, r - zr + left, zr)
        return value


def candidates(order: np.ndarray, names: list[np.ndarray], longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods from dyadic blocks with occurrences in progression."""
    n = len(order)
    place, size, first, last = [], [], [], []
    for k in range(1, len(names)):
        width = 1 << k
        if width > 2 and (width // 2 + 1) * EXPONENT > longest:
            break
        many = np.bincount(names[k], minlength=n)
        at = np.arange(0, n, width)
        at = at[many[names[k][at]] > 1]
        place.append(at)
        size.append(np.full(len(at), width))
        first.append(names[k][at].astype(np.int64))
        last.append(first[-1] + many[names[k][at]])
    if not place or not sum(map(len, place)):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, size, first, last = (np.concatenate(x).astype(np.int64) for x in (place, size, first, last))
    tree = WaveletTree(order.astype(np.int64))
    own = tree.smaller(first, last, place)

    out_place, out_period = [], []
    # a progression within the block's length on either side, by its first difference
    for k in (-1, 1):
        there = np.flatnonzero((own + k >= 0) & (own + k < last - first))
        period = np.abs(tree.nth(first[there], last[there], own[there] + k) - place[there])
        fit = (period <= size[there]) & ((period > size[there] // 2) | (size[there] == 2))
        out_place.append(place[there][fit])
        out_period.append(period[fit])
    return np.concatenate(out_place), np.concatenate(out_period)


def find_runs(codes: np.ndarray, longest: int) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start, then period.

    ``codes`` ends with a symbol met once; ``longest`` bounds a run's length.
    """
    none = np.zeros((0, 3), np.int64)
    if longest < LEAST:
        return none
    order, names = block_names(codes)
    place, period = candidates(order, names, longest)
    if not len(place):
        return none
    n = len(codes)
    pairs = np.unique(place * n + period)
    place, period = pairs // n, pairs % n
    x, y = place.copy(), place + period
    back = place.copy()
    for k in range(len(names) - 1, -1, -1):
        width = 1 << k
        fit = np.flatnonzero(y + width <= n)
        ok = fit[names[k][x[fit]] == names[k][y[fit]]]
        x[ok] += width
        y[ok] += width
    for k in range(len(names) - 1, -1, -1):
        width = 1 << k
        fit = np.flatnonzero(back >= width)
        ok = fit[names[k][back[fit] - width] == names[k][back[fit] + period[fit] - width]]
        back[ok] -= width
    runs = np.stack([back, y - back, period], 1)
    runs = runs[runs[:, 1] >= np.maximum(LEAST, EXPONENT * period)]
    return np.unique(runs, axis=0)


def runs_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """``(runs, row of each, words, first word of each row)``; starts are word numbers of the row."""
    words, first = split_words(texts)
    counts = np.diff(first)
    rows = len(counts)
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(rows), counts)
    joined = np.empty(len(codes) + rows, np.int64)
    joined[np.arange(len(codes)) + row] = codes + rows
    joined[first[1:] + np.arange(rows)] = np.arange(rows)  # a symbol of its own behind every row
    runs = find_runs(joined, int(counts.max(initial=0)))
    begin = first[:-1] + np.arange(rows)
    own = np.searchsorted(begin, runs[:, 0], side="right") - 1
    runs[:, 0] -= begin[own]
    order = np.lexsort((runs[:, 2], runs[:, 0], own))
    return runs[order], own[order], words, first


def lists_of(values: pa.Array, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)


def collapse(runs: np.ndarray, own: np.ndarray, words: pa.Array, first: np.ndarray) -> pa.Array:
    """The texts with one period of every run: words kept, joined by one space."""
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, first[own] + runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, first[own] + runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(change)[:-1] == 0
    bounds = np.concatenate([[0], np.cumsum(kept)])[first]
    return pc.binary_join(lists_of(words.filter(pa.array(kept)), bounds), pa.scalar(" ", pa.large_string()))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, runs, collapsed) of every row.

    ``runs`` lists (start, length, period) by start, then period, in words from 0;
    ``collapsed`` is the text without any word that a run holds after its first period.
    """
    kind = dict(docs.dtypes)[id_col]

    @releasing
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=TEXT_BYTES):
                runs, own, words, first = runs_of(part.column("text"))
                items = pa.StructArray.from_arrays([pa.array(runs[:, j]) for j in range(3)], names=["start", "length", "period"])
                bounds = np.searchsorted(own, np.arange(len(part) + 1))
                text = collapse(runs, own, words, first).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column("id"), lists_of(items, bounds), text], names=["id", "runs", "collapsed"])

    rows = texts_of(docs).select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(find, f"id {kind}, runs {RUNS}, collapsed string").withColumnRenamed("id", id_col)
