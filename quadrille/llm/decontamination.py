"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Words are lower-cased and also end at punctuation.  Test items are taken in
blocks of bounded size; a block's n-grams go to all tasks, and one pass over
every whole training text keeps only the regions around shared n-grams (their
word hashes, and all that an alignment through the n-gram could reach).  All of an item's
n-grams met in a region are its seeds there, however often they stand elsewhere,
so that a widely copied item loses none.  What keeps common n-grams cheap is an
exact bound: an item is left out of a region or passage that holds too few of
its words for any alignment to reach the least score.  Seeds join passages to items, and a
local alignment of each item with the passage around its seeds gives the score:
matched words count 2, other and skipped words cost 1, divided by twice the
item's length.  Inserted words cost 1 each, so an alignment that reaches the
least score holds at most ``slack`` of them; a seed's passage is the item's
length and that slack to either side, and seeds whose passages meet share one.

Limit: a copy without ``NGRAM`` (3) words of the item in a row is not met, even
if it would score enough, such as one with every third word replaced.

Items with fewer words than an n-gram take part as one n-gram of all their
words.  Null or empty texts and items have no words and never match.  Rows that
repeat an id give one result per item with the best score; a null id keeps its
rows apart by their text only while matching.  Extra columns are ignored.  Empty
tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import text_or_empty, texts_of, write_result, write_table
from quadrille.llm.textkit import Words, gram_hashes, releasing, slices, spaces_table, words_of

NGRAM = 3
MIN_SCORE = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_WORDS = 2_000_000  # words of test items held by each task at a time

SEPARATORS = spaces_table(b"""!"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~""")


class Items:
    """A block of test items and an index of their n-grams."""

    def __init__(self, ids: list, texts: list[str | None], width: int = NGRAM, min_score: float = MIN_SCORE):
        words = words_of(pa.array(texts, pa.large_string()), spaces=SEPARATORS)
        self.ids, self.width = ids, width
        self.words = [words.hashes[a:b] for a, b in zip(words.row_first, words.row_first[1:])]
        self.first = words.row_first
        self.vocabulary, self.word = np.unique(words.hashes, return_inverse=True)
        grams, at, first = gram_hashes(words, width, whole_if_short=False)
        item = np.repeat(np.arange(len(ids)), np.diff(first))
        order = np.argsort(grams, kind="stable")
        self.grams, self.start = np.unique(grams[order], return_index=True)
        self.start = np.append(self.start, len(grams))
        self.item, self.place = item[order], (at - words.row_first[item])[order]
        # items too short for an n-gram, by their number of words: hash of the whole sequence
        self.short = {}
        for n in range(1, width):
            whole = np.flatnonzero(np.diff(self.first) == n)
            if len(whole):
                grams_n, at_n, _ = gram_hashes(words, n, whole_if_short=False)
                own = grams_n[np.searchsorted(at_n, self.first[whole])]
                by_hash = np.argsort(own, kind="stable")
                self.short[n] = own[by_hash], whole[by_hash], self.bits(own)
        # matches bring at most MATCH * length, of which words that the item lacks may use up what is over the least score
        lengths = np.diff(self.first)
        self.slack = np.ceil(MATCH * lengths * (1 - max(0.0, min_score)) / -GAP).astype(np.int64)
        # words that an alignment through the n-gram can reach before its place and from there on
        before = self.place + self.slack[self.item]
        after = lengths[self.item] - self.place + self.slack[self.item]
        some = len(self.grams) > 0
        self.before = np.maximum.reduceat(before, self.start[:-1]) if some else before
        self.after = np.maximum.reduceat(after, self.start[:-1]) if some else after
        self.filter = self.bits(self.grams)

    @staticmethod
    def bits(hashes: np.ndarray) -> np.ndarray:
        """Which low bits occur: a first sieve for look-ups."""
        out = np.zeros(1 << 20, bool)
        out[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        return out

    def find_short(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """First words where short items occur whole, and -1 - the item, a row each."""
        places, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n, (hashes, whole, sieve) in self.short.items():
            grams, at, _ = gram_hashes(words, n, whole_if_short=False)
            maybe = np.flatnonzero(sieve[(grams & np.uint64((1 << 20) - 1)).astype(np.int64)])
            low = np.searchsorted(hashes, grams[maybe], side="left")
            times = np.searchsorted(hashes, grams[maybe], side="right") - low
            each = np.arange(times.sum()) + np.repeat(low - (np.cumsum(times) - times), times)
            places.append(np.repeat(at[maybe], times))
            items.append(-1 - whole[each])
        return np.concatenate(places), np.concatenate(items)

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``grams`` of the block's n-grams, and their numbers."""
        maybe = np.flatnonzero(self.filter[(grams & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if not len(self.grams) or not len(maybe):
            return maybe[:0], maybe[:0]
        number = np.minimum(np.searchsorted(self.grams, grams[maybe]), len(self.grams) - 1)
        hit = self.grams[number] == grams[maybe]
        return maybe[hit], number[hit]

    def reach(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words before and from the place of each n-gram (or short item) that an alignment through it can hold."""
        before, after = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        long = number >= 0
        before[long], after[long] = self.before[number[long]], self.after[number[long]]
        whole = -1 - number[~long]
        before[~long], after[~long] = self.slack[whole], np.diff(self.first)[whole] + self.slack[whole]
        return before, after

    def most(self, items: np.ndarray, passage: np.ndarray) -> np.ndarray:
        """The score that each of ``items`` cannot exceed in ``passage``: its share of words that occur there."""
        here = np.zeros(len(self.vocabulary), bool)
        at = np.minimum(np.searchsorted(self.vocabulary, passage), len(self.vocabulary) - 1)
        here[at[self.vocabulary[at] == passage]] = True
        counts = self.first[items + 1] - self.first[items]
        starts = np.cumsum(counts) - counts
        own = np.arange(counts.sum()) + np.repeat(self.first[items] - starts, counts)
        return np.add.reduceat(here[self.word[own]], starts, dtype=np.int64) * MATCH / (MATCH * counts)

    def seeds(self, places: np.ndarray, grams: np.ndarray, passage: np.ndarray, min_score: float) -> Iterator[tuple[int, np.ndarray]]:
        """Items that could reach ``min_score`` in ``passage``, each with its seeds' diagonals in order."""
        for i in np.unique(grams[grams < 0]):  # a short item's whole word sequence
            yield int(-1 - i), places[grams == i]
        places, grams = places[grams >= 0], grams[grams >= 0]
        if not len(grams):
            return
        own, which = np.unique(grams, return_inverse=True)
        counts = self.start[own + 1] - self.start[own]
        entries = np.arange(counts.sum()) + np.repeat(self.start[own] - (np.cumsum(counts) - counts), counts)
        items, item = np.unique(self.item[entries], return_inverse=True)
        able = (self.most(items, passage) >= min_score)[item]
        entries, counts = entries[able], np.bincount(np.repeat(np.arange(len(own)), counts)[able], minlength=len(own))
        first, times = np.cumsum(counts) - counts, counts[which]
        each = entries[np.arange(times.sum()) + np.repeat(first[which] - (np.cumsum(times) - times), times)]
        item, line = self.item[each], np.repeat(places, times) - self.place[each]
        order = np.lexsort((line, item))
        item, line = item[order], line[order]
        for part in np.split(np.arange(len(item)), np.flatnonzero(np.diff(item)) + 1):
            if len(part):
                yield int(item[part[0]]), line[part]


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: (score, first word, end word) within the passage.

    Row by row; gaps along a row are a running maximum of the score less its
    gap cost, so each row is a few vector operations.
    """
    n = len(passage)
    above, from_above = np.zeros(n + 1, np.int64), np.arange(n + 1)
    fall = np.arange(n + 1) * -GAP
    best = (0, 0, 0)
    for word in item:
        same = np.where(passage == word, MATCH, MISMATCH)
        score, origin = np.zeros(n + 1, np.int64), np.arange(n + 1)
        diagonal, down = above[:-1] + same, above[1:] + GAP
        use = diagonal >= down
        step = np.where(use, diagonal, down)
        begin = np.where(use, from_above[:-1], from_above[1:])
        live = step > 0
        score[1:], origin[1:] = np.where(live, step, 0), np.where(live, begin, origin[1:])
        reach = np.maximum.accumulate(score + fall)
        along = reach - fall
        better = along > score
        if better.any():  # the cell that the gap started from is the last one with that reach
            source = np.maximum.accumulate(np.where(score + fall == reach, np.arange(n + 1), 0))
            score, origin = np.where(better, along, score), np.where(better, origin[source], origin)
        top = int(score.argmax())
        if score[top] > best[0]:
            best = (int(score[top]), int(origin[top]), top)
        above, from_above = score, origin
    return best


REGION = "mark long, lo long, words binary, places array<long>, grams array<long>"


def shared_regions(docs: DataFrame, items, id_col: str, text_col: str) -> DataFrame:
    """Regions of texts around n-grams of the block: doc_id, mark, lo (first word),
    words (hashes), and place and number of each shared n-gram."""
    rows = texts_of(docs).select(F.col(id_col).alias("doc_id"), F.lower(text_or_empty(text_col)).alias("text")).withColumn("mark", F.xxhash64("text"))
    kind = dict(rows.dtypes)["doc_id"]

    @releasing
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = items.value
        for batch in batches:
            for part in slices(batch):
                words = words_of(part.column("text"), spaces=SEPARATORS)
                grams, at, first = gram_hashes(words, block.width, whole_if_short=False)
                hit, number = block.find(grams)
                places = at[hit]
                found, item = block.find_short(words)
                places, number = np.concatenate([places, found]), np.concatenate([number, item])
                if not len(places):
                    continue
                row = np.searchsorted(words.row_first, places, side="right") - 1
                before, after = block.reach(number)
                low = np.maximum(words.row_first[row], places - before)
                high = np.minimum(words.row_first[row + 1], places + after)
                order = np.lexsort((places, low))
                places, number, row, low = places[order], number[order], row[order], low[order]
                high = np.maximum.accumulate(high[order])  # rows follow each other, so none reaches into the next
                new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (low[1:] > high[:-1])))
                out = {n: [] for n in ("which", "lo", "words", "places", "grams")}
                for a, b in zip(new, np.append(new[1:], len(places))):
                    out["which"].append(row[a])
                    out["lo"].append(low[a] - words.row_first[row[a]])
                    out["words"].append(words.hashes[low[a]:high[b - 1]].tobytes())
                    out["places"].append(places[a:b] - low[a])
                    out["grams"].append(number[a:b])
                take = pa.array(out["which"], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(take), part.column("mark").take(take), pa.array(out["lo"], pa.int64()), pa.array(out["words"], pa.binary()),
                     pa.array(out["places"], pa.list_(pa.int64())), pa.array(out["grams"], pa.list_(pa.int64()))],
                    names=["doc_id", "mark", "lo", "words", "places", "grams"])

    return rows.mapInArrow(look, f"doc_id {kind}, {REGION}")


def aligned(regions: DataFrame, shared, min_score: float) -> DataFrame:
    """doc_id, mark, item (its number), score, start, end of passages that reach ``min_score``."""
    kind = dict(regions.dtypes)["doc_id"]
    names = ["doc_id", "mark", "item", "score", "start", "end"]

    @releasing
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            which, found = [], []
            for r in range(len(batch)):
                words = np.frombuffer(batch.column("words")[r].as_py(), np.uint64)
                lo = batch.column("lo")[r].as_py()
                places, grams = (np.asarray(batch.column(n)[r].values) for n in ("places", "grams"))
                for i, lines in block.seeds(places, grams, words, min_score):
                    item, best, slack = block.words[i], (0, 0, 0), int(block.slack[i])
                    cuts = np.flatnonzero(np.diff(lines) > len(item) + 2 * slack) + 1  # passages further apart cannot share an alignment
                    for near in np.split(lines, cuts):
                        left = max(0, int(near[0]) - slack)
                        passage = words[left:int(near[-1]) + len(item) + slack]
                        if block.most(np.array([i]), passage)[0] < min_score:
                            continue
                        got = align(item, passage)
                        if got[0] > best[0]:
                            best = (got[0], got[1] + left, got[2] + left)
                    value = best[0] / (MATCH * len(item))
                    if value >= min_score:
                        which.append(r)
                        found.append((i, value, lo + best[1], lo + best[2]))
            if which:
                take = pa.array(which, pa.int64())
                columns = [pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.float64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("mark").take(take), *columns], names=names)

    return regions.mapInArrow(score, f"doc_id {kind}, mark long, item long, score double, start long, end long")


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, most: int) -> Iterator[tuple[list, list]]:
    """The items in blocks of about ``most`` words, one block on the driver at a time."""
    rows = benchmark.select(F.col(item_col).alias("item_id"), F.lower(text_col).alias("text"))
    ids, texts, held = [], [], 0
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        ids.append(row["item_id"])
        texts.append(row["text"])
        held += len(row["text"] or "") // 2 + 1
        if held >= most:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text: str = "text", min_score: float = MIN_SCORE, width: int = NGRAM, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per leak: doc_id, item_id, score, start_word, end_word."""
    spark = docs.sparkSession
    parts = []
    for ids, texts in item_blocks(benchmark, item_col, item_text, block_words):
        shared = spark.sparkContext.broadcast(Items(ids, texts, width, min_score))
        names = spark.createDataFrame([(i, v) for i, v in enumerate(ids)], f"item long, item_id {dict(benchmark.dtypes)[item_col]}")

        def leaks() -> DataFrame:
            regions = write_table(shared_regions(docs, shared, id_col, text_col), "regions")
            return aligned(regions, shared, min_score).join(F.broadcast(names), "item")  # one row per item of a block

        parts.append(write_result(leaks, "leaks"))
        shared.destroy()  # so the executors hold one block at a time
    if not parts:
        kinds = f"{dict(docs.dtypes)[id_col]}, item_id {dict(benchmark.dtypes)[item_col]}"
        return spark.createDataFrame([], f"doc_id {kinds}, score double, start_word long, end_word long")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    best = F.max(F.struct("score", (-F.col("start")).alias("first"), "end")).alias("best")
    return every.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "best.score", (-F.col("best.first")).alias("start_word"), F.col("best.end").alias("end_word"))
