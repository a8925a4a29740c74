"""Toxicity: a convolutional text classifier trained by Spark on all labelled rows.

Words are hashed to rows of an embedding table.  Each row carries the tag of the
training word that owns it (of words that share a row, the one in most training
texts), so other words read the zero row and cannot be mistaken for it.  Filters
of several widths run over a text's embedded words; each filter's largest
response in the whole text goes to a logistic layer.  Embeddings start from the
words' log odds and all weights are trained by Adagrad; the score is calibrated
on training rows kept apart, and a threshold is fitted for each language.

Scores see the text alone.  Labels are learned from every row of documents that
has one and whose remainder crc32(id) mod 3 is not 1, with its whole text: a
quarter, by a hash of the id, is kept apart for calibration and thresholds, all
others give the words' counts and, in each of STEPS steps, the gradient.  Tasks
hand on a gradient's sums as integers (multiples of 1 / ONE), so that the model
does not depend on how rows are dealt out or in which order they are added.  The
driver holds what has a fixed size: the weights, their gradient, and a histogram
of logits in steps of 1 / GRID, from which the calibration and the thresholds
come.  Scoring and training read texts in blocks that overlap by a filter's width.

Null texts count as empty; an empty text pools to zeros and has the score of a
text without a known word.  A null label is no label; of several labels of an id
the largest counts.  Repeated rows get equal results.  Without labels of both
kinds all scores are 0.  Extra columns are ignored.  Empty tables give an empty
result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.common import dropping, text_or_empty, texts_of, write_table
from quadrille.llm.textkit import releasing, slices, words_of

ROWS = 1 << 18  # embedding rows
DIM, WIDTHS, FILTERS = 8, (1, 2, 3), 8
STEPS, BATCH, RATE = 16, 64, 0.1  # gradients are scaled to sums over BATCH texts
ONE = 1 << 24  # a gradient's fixed point
APART = 4  # one training row in APART is kept apart
GRID, FAR = 1000, 40  # logits of a histogram: steps a unit, largest
LEAST_TEXTS = 3  # training texts a word must be in
BLOCK = 200_000  # words scored at a time
PIECE = 1 << 12  # words trained on at a time: their responses fit a cache
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7


class Compact:
    """Pooling and gradient of texts given as the numbers of their words' rows.

    A word's product with a filter is looked up, and sums run in a fixed order, so
    that what a text gives does not depend on the texts it comes with.
    """

    def __init__(self, emb: np.ndarray, filters: list[np.ndarray], bias: list[np.ndarray], out: np.ndarray, base: np.float32):
        self.emb, self.filters, self.bias, self.out, self.base = emb, filters, bias, out, base

    def prepare(self) -> Compact:
        """Products of all words with the filters of each place (those at least as wide)."""
        self.products = [self.emb @ np.concatenate([f[j] for f in self.filters if len(f) > j], 1) for j in range(max(WIDTHS))]
        self.products[0] += np.concatenate(self.bias)
        return self

    def tops(self, rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each text's largest rectified response of each filter, and the rows under it (zeros if none is above 0)."""
        pad, width = max(WIDTHS) - 1, FILTERS * len(WIDTHS)
        texts, counts = len(first) - 1, np.diff(first)
        pieces = -(-counts // PIECE)
        of = np.repeat(np.arange(texts), pieces)
        lo = first[of] + PIECE * (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        size = np.minimum(PIECE, first[of + 1] - lo) + pad
        ends = np.cumsum(size)
        top, under = np.zeros((len(of), width), np.float32), np.zeros((len(of), width, pad + 1), np.int64)
        at = 0
        while at < len(of):
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] - size[at] + PIECE, side="right")))
            own = size[at:stop]
            starts = np.cumsum(own) - own
            piece = np.repeat(np.arange(stop - at), own)
            place = np.arange(own.sum()) + (lo[at:stop] - starts)[piece]
            r = np.where(place < first[of[at:stop] + 1][piece], rows[np.minimum(place, len(rows) - 1)], 0)
            y = self.products[0].take(r, 0)
            for j in range(1, pad + 1):
                y[:-j, sum(w <= j for w in WIDTHS) * FILTERS:] += self.products[j].take(r[j:], 0)
            for j in range(1, pad + 1):  # no window starts behind a piece
                y[starts + own - j] = -np.inf
            best = np.maximum.reduceat(y, starts, axis=0)
            hits = np.flatnonzero(y == np.where(best > 0, best, np.inf)[piece])[::-1]
            where = np.full((stop - at) * width, -1)
            where[piece[hits // width] * width + hits % width] = hits // width  # the first is written last
            where = where.reshape(-1, width)
            top[at:stop] = np.maximum(best, 0)
            for k, w in enumerate(WIDTHS):
                part = where[:, k * FILTERS:(k + 1) * FILTERS]
                for j in range(w):
                    under[at:stop, k * FILTERS:(k + 1) * FILTERS, j] = np.where(part < 0, 0, r[part + j])
            at = stop
        if len(of) == texts and (pieces == 1).all():
            return top, under
        pool, words = np.zeros((texts, width), np.float32), np.zeros((texts, width, pad + 1), np.int64)
        one = pieces[of] == 1
        pool[of[one]], words[of[one]] = top[one], under[one]
        before = np.cumsum(pieces) - pieces
        for t in np.flatnonzero(pieces > 1).tolist():
            own = np.arange(before[t], before[t] + pieces[t])
            best = own[top[own].argmax(0)]
            pool[t], words[t] = top[best, np.arange(width)], under[best, np.arange(width)]
        return pool, words

    def logits(self, pool: np.ndarray) -> np.ndarray:
        return (pool.astype(np.float64) * self.out).sum(1) + self.base

    def gradient(self, rows: np.ndarray, first: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums over the texts, as multiples of 1 / ONE: (rows, their sums), and those of the other weights in a line."""
        pool, words = self.tops(rows, first)
        slope = (1 / (1 + np.exp(-np.clip(self.logits(pool), -30, 30))) - labels) * weights
        down = slope[:, None] * self.out * (pool > 0)
        dense = [fixed(slope[:, None] * pool).sum(0), fixed(slope).sum(keepdims=True)]
        at, sums = [np.zeros(0, np.int64)], [np.zeros((0, DIM), np.int64)]
        for k, w in enumerate(WIDTHS):
            own = slice(k * FILTERS, (k + 1) * FILTERS)
            part = down[:, own]
            places = []
            for j in range(w):
                under = words[:, own, j]
                places.append(fixed(part[:, :, None] * self.emb[under]).sum(0).T)
                text, f = np.nonzero((part != 0) & (under > 0))
                at.append(under[text, f])
                sums.append(fixed(part[text, f][:, None] * self.filters[k][j].T[f]))
            dense += [np.stack(places).ravel(), fixed(part).sum(0)]
        at, sums = added(np.concatenate(at), np.concatenate(sums))
        return at, sums, np.concatenate(dense)


def fixed(x: np.ndarray) -> np.ndarray:
    return np.rint(np.asarray(x, np.float64) * ONE).astype(np.int64)


def added(at: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places, and the sums of their rows."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    starts = np.flatnonzero(np.concatenate([np.ones(min(len(at), 1), bool), at[1:] != at[:-1]]))
    return at[starts], np.add.reduceat(sums[order], starts, axis=0) if len(at) else sums


class Network:
    """Weights, forward pass and training steps."""

    def __init__(self, tags: np.ndarray, odds: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.tags = tags
        self.emb = np.zeros((len(tags) + 1, DIM), np.float32)
        owned = np.flatnonzero(tags) + 1
        self.emb[owned] = rng.normal(0, 0.05, (len(owned), DIM))
        self.emb[1:, 0] += odds
        self.filters = [rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        for f in self.filters:
            f[:, 0, :] += 0.5 / len(f)
        self.bias = [np.full(FILTERS, -0.1, np.float32) for _ in WIDTHS]
        self.out = np.full(FILTERS * len(WIDTHS), 0.3, np.float32)
        self.base = np.float32(-1.0)
        self.scale, self.shift = 1.0, 0.0  # calibration
        self.thresholds: dict[str | None, float] = {}

    def rows_of(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes & np.uint64(len(self.tags) - 1)).astype(np.int64)
        return np.where(self.tags[at] == tag_of(hashes), at + 1, 0)

    def convolve(self, x: np.ndarray, k: int) -> np.ndarray:
        """Responses of the filters of width WIDTHS[k]; ``x`` ends in padding."""
        w = WIDTHS[k]
        n = len(x) - max(WIDTHS) + 1
        out = x[:n] @ self.filters[k][0]
        for j in range(1, w):
            out += x[j:n + j] @ self.filters[k][j]
        return out + self.bias[k]

    def pooled(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Largest rectified responses of each text, block by block."""
        pad = max(WIDTHS) - 1
        result = np.zeros((len(first) - 1, FILTERS * len(WIDTHS)), np.float32)
        at = 0
        texts = len(first) - 1
        while at < texts:
            stop = max(at + 1, int(np.searchsorted(first, first[at] + BLOCK, side="right")) - 1)
            for lo in range(first[at], max(first[stop], first[at] + 1), BLOCK):  # several rounds only for one long text
                hi = min(first[stop], lo + BLOCK)
                bounds = np.clip(first[at:stop + 1], lo, hi)
                counts = np.diff(bounds)
                some = np.flatnonzero(counts)
                if not len(some):
                    continue
                starts = bounds[:-1] - lo + np.arange(len(counts)) * pad
                rows = np.zeros(hi - lo + len(counts) * pad + pad, np.int64)
                rows[np.arange(hi - lo) + np.repeat(np.arange(len(counts)) * pad, counts)] = self.rows_of(hashes[lo:hi])
                if stop == at + 1 and hi < first[stop]:  # the text goes on: its next words, not padding
                    ahead = hashes[hi:min(hi + pad, first[stop])]
                    rows[hi - lo:hi - lo + len(ahead)] = self.rows_of(ahead)
                x = self.emb[rows]
                edges = np.stack([starts[some], starts[some] + counts[some]], 1).ravel()
                for k in range(len(WIDTHS)):
                    y = self.convolve(x, k)
                    # a closing row lets the last edge be an index
                    top = np.maximum.reduceat(np.concatenate([y, y[-1:]]), edges, axis=0)[::2]
                    part = result[at + some, k * FILTERS:(k + 1) * FILTERS]
                    result[at + some, k * FILTERS:(k + 1) * FILTERS] = np.maximum(part, top)
            at = stop
        return result

    def logits(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.pooled(hashes, first) @ self.out + self.base

    def scores(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.calibrated(self.logits(hashes, first).astype(np.float64))

    def compact(self) -> Compact:
        """What tasks need for training: the rows that words own, the other weights."""
        owned = np.concatenate([[0], np.flatnonzero(self.tags) + 1])
        return Compact(self.emb[owned], self.filters, self.bias, self.out, self.base)

    def train(self, totals: Callable[[Compact], tuple[np.ndarray, np.ndarray]], texts: int) -> None:
        """Adagrad on the weighted logistic loss of ``texts`` texts.

        ``totals`` gives the sums of ``Compact.gradient`` over all of them.
        """
        owned = np.flatnonzero(self.tags) + 1
        seen_emb = np.full(len(owned), 1e-2)
        seen = {n: np.full(v.shape, 1e-2) for n, v in self._dense().items()}
        factor = BATCH / texts / ONE
        for _ in range(STEPS):
            emb, dense = totals(self.compact())
            at = 0
            for n, v in self._dense().items():
                g = dense[at:at + v.size].reshape(v.shape) * factor
                at += v.size
                seen[n] += g ** 2
                v -= (RATE * g / np.sqrt(seen[n])).astype(np.float32)
            self.base = np.float32(self._base[0])
            g = emb[1:] * factor
            seen_emb += (g ** 2).mean(1)
            self.emb[owned] -= (RATE * g / np.sqrt(seen_emb)[:, None]).astype(np.float32)

    def _dense(self) -> dict[str, np.ndarray]:
        if not hasattr(self, "_base"):
            self._base = np.array([self.base], np.float32)
        named = {"out": self.out, "base": self._base}
        for k in range(len(WIDTHS)):
            named[f"filter{k}"], named[f"bias{k}"] = self.filters[k], self.bias[k]
        return named

    def calibrate(self, logits: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> None:
        """Platt scaling by Newton steps, with smoothed targets; each logit counts ``counts`` times."""
        pos, neg = (counts * labels).sum(), (counts * (1 - labels)).sum()
        goal = np.where(labels > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
        x = np.stack([logits, np.ones_like(logits)], 1).astype(np.float64)
        beta = np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            g = x.T @ (counts * (p - goal)) + 1e-3 * (beta - [1.0, 0.0])
            h = (x * (counts * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
            step = np.linalg.solve(h, g)
            beta -= np.clip(step, -1, 1)
            if np.abs(step).max() < 1e-8:
                break
        self.scale, self.shift = max(float(beta[0]), 1e-3), float(beta[1])

    def calibrated(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logits + self.shift, -40, 40)))


def tag_of(hashes: np.ndarray) -> np.ndarray:
    return ((hashes >> np.uint64(32)) | np.uint64(1)).astype(np.uint32)


def bucket(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo FOLDS."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All rows with a label outside the held-out fold (doc_id, text, lang, toxic, apart); both sides are exchanged by the id."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(bucket() != HELD_OUT).select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    texts = docs.where(bucket() != HELD_OUT).select("doc_id", text_or_empty().alias("text"), "lang")
    apart = F.pmod(F.xxhash64("doc_id"), F.lit(APART)) == 0
    return texts.join(known.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "lang", "toxic", apart.alias("apart"))


def word_counts(rows: DataFrame) -> DataFrame:
    """Texts that hold each word and, of them, those with label 1 (hash, n, ones)."""

    @releasing
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = words_of(part.column("text"))
                toxic = part.column("toxic").to_numpy(zero_copy_only=False)
                of = np.repeat(np.arange(len(part)), np.diff(words.row_first))
                own, inverse = np.unique(words.hashes, return_inverse=True)
                pairs = np.unique(inverse * len(part) + of)  # a word counts once a text
                word, text = pairs // len(part), pairs % len(part)
                n, ones = np.bincount(word, minlength=len(own)), np.bincount(word, toxic[text], len(own)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n), pa.array(ones)], names=["hash", "n", "ones"])

    return texts_of(rows).select("text", "toxic").mapInArrow(count, "hash long, n long, ones long").groupBy("hash").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"))


def untrained(rows: DataFrame, n1: int, n0: int, seed: int = 7) -> Network:
    """A network whose rows belong to the words of ``rows``, with their log odds."""
    counts = word_counts(rows).where(F.col("n") >= LEAST_TEXTS)
    # at most ROWS rows: of words that share a row, the one in most texts
    owners = counts.groupBy(F.col("hash").bitwiseAND(ROWS - 1).alias("at")).agg(F.max(F.struct("n", "hash", "ones")).alias("w"))
    owners = owners.select("at", "w.*").toPandas()
    n, ones, at = (owners[c].to_numpy(np.int64) for c in ("n", "ones", "at"))
    odds = np.log((ones + 0.5) / (n1 + 1)) - np.log((n - ones + 0.5) / (n0 + 1))
    tags, start = np.zeros(ROWS, np.uint32), np.zeros(ROWS, np.float32)
    tags[at] = tag_of(owners["hash"].to_numpy(np.int64).view(np.uint64))
    start[at] = np.clip(odds, -4, 4) / 2
    return Network(tags, start, seed)


def numbered(rows: DataFrame, net: Network) -> DataFrame:
    """Each text as the numbers of its words' rows in ``Compact`` (words: 32-bit integers), with lang, toxic and apart."""
    shared = rows.sparkSession.sparkContext.broadcast(net)  # fixed size: ROWS * DIM weights

    @releasing
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        new = np.concatenate([[0], np.where(model.tags > 0, np.cumsum(model.tags > 0), 0)]).astype(np.int32)
        for batch in batches:
            for part in slices(batch):
                words = words_of(part.column("text"))
                data = new[model.rows_of(words.hashes)]
                buffers = [None, pa.py_buffer((words.row_first * data.itemsize).astype(np.int64)), pa.py_buffer(data)]
                packed = pa.Array.from_buffers(pa.large_binary(), len(part), buffers).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([packed, *(part.column(c) for c in ("lang", "toxic", "apart"))], names=["words", "lang", "toxic", "apart"])

    out = write_table(texts_of(rows).select("text", "lang", "toxic", "apart").mapInArrow(number, "words binary, lang string, toxic int, apart boolean"), "toxicity_rows")
    shared.destroy()
    return out


def unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, each text's first, and labels."""
    column = batch.column("words").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    rows = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    rows = rows[offsets[0]:offsets[-1]].view(np.int32)
    return rows, (offsets - offsets[0]) // rows.itemsize, batch.column("toxic").to_numpy(zero_copy_only=False)


def gradient_of(rows: DataFrame, half: tuple[float, float], weights: Compact) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the gradient over all ``rows``, whose labels weigh ``half``: embeddings, other weights."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)
    names = [f"g{d}" for d in range(DIM)]

    @releasing
    def gradient(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, at, emb, dense = None, None, None, 0
        for batch in batches:
            if len(batch):
                if model is None:
                    model = shared.value.prepare()
                    emb = np.zeros((len(model.emb), DIM), np.int64)
                words, first, labels = unpacked(batch)
                at, sums, other = model.gradient(words, first, labels, np.array(half)[labels])
                emb[at] += sums
                dense = dense + other
        if model is not None:
            # the other weights follow in rows with numbers below 0
            rest = np.concatenate([dense, np.zeros(-len(dense) % DIM, np.int64)]).reshape(-1, DIM)
            at = np.flatnonzero(emb.any(1))
            table = np.concatenate([emb[at], rest])
            at = np.concatenate([at, -1 - np.arange(len(rest))])
            yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(np.ascontiguousarray(table[:, d])) for d in range(DIM))], names=["at", *names])

    sums = rows.select("words", "toxic").mapInArrow(gradient, "at long, " + ", ".join(f"{n} long" for n in names))
    # a row of the embedding table each, ROWS at most
    got = sums.groupBy("at").agg(*(F.sum(n).alias(n) for n in names)).toPandas()
    shared.destroy()
    at, values = got["at"].to_numpy(np.int64), got[names].to_numpy(np.int64)
    emb = np.zeros((len(weights.emb), DIM), np.int64)
    emb[at[at >= 0]] = values[at >= 0]
    dense = np.zeros((-at.min(initial=0), DIM), np.int64)
    dense[-1 - at[at < 0]] = values[at < 0]
    return emb, dense.ravel()


def logits_of(rows: DataFrame, net: Network) -> DataFrame:
    """How often each logit, in steps of 1 / GRID, occurs in a language (lang, bin, n, ones)."""
    shared = rows.sparkSession.sparkContext.broadcast(net.compact())

    @releasing
    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            if len(batch):
                model = model or shared.value.prepare()
                words, first, labels = unpacked(batch)
                z = np.clip(model.logits(model.tops(words, first)[0]), -FAR, FAR)
                yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(np.rint(z * GRID).astype(np.int64)), batch.column("toxic")], names=["lang", "bin", "toxic"])

    bins = rows.select("words", "lang", "toxic").mapInArrow(logits, "lang string, bin long, toxic int")
    bins = bins.groupBy(F.coalesce("lang", F.lit("")).alias("lang"), "bin").agg(F.count("*").alias("n"), F.sum("toxic").alias("ones"))
    out = write_table(bins, "toxicity_logits")
    shared.destroy()
    return out


def best_cuts(bins: DataFrame) -> DataFrame:
    """Of each language with both labels the bin whose cut has the best F1, and the next lower bin (lang, bin, below)."""
    whole = Window.partitionBy("lang")  # 2 * FAR * GRID + 1 rows at most
    down = whole.orderBy(F.desc("bin"))
    bins = bins.select(
        "lang", "bin", F.lead("bin").over(down).alias("below"), F.sum("n").over(down).alias("flagged"), F.sum("ones").over(down).alias("hit"),
        F.sum("n").over(whole).alias("all"), F.sum("ones").over(whole).alias("positive"))
    bins = bins.where("positive > 0 and positive < all").withColumn("f1", 2 * F.col("hit") / (F.col("flagged") + F.col("positive")))
    return bins.groupBy("lang").agg(F.max(F.struct("f1", "bin", "below")).alias("best")).select("lang", "best.bin", "best.below")


@dropping()
def train_on(docs: DataFrame, labels: DataFrame) -> Network | None:
    """Trains and calibrates on all labelled rows; None without both labels."""
    rows = write_table(training_rows(docs, labels), "toxicity_texts")
    number = {(r["apart"], r["toxic"]): r["count"] for r in rows.groupBy("apart", "toxic").count().collect()}
    if not all(any((a, y) in number for a in (False, True)) for y in (0, 1)):
        return None
    if not all((a, y) in number for a in (False, True) for y in (0, 1)):  # too few to keep some apart
        learn = test = F.lit(True)
        n0, n1 = (sum(c for (_, label), c in number.items() if label == y) for y in (0, 1))
    else:
        learn, test = ~F.col("apart"), F.col("apart")
        n0, n1 = number[False, 0], number[False, 1]
    net = untrained(rows.where(learn), n1, n0)
    rows = numbered(rows, net)
    half = (0.5 * (n0 + n1) / n0, 0.5 * (n0 + n1) / n1)
    net.train(lambda weights: gradient_of(rows.where(learn), half, weights), n0 + n1)
    bins = logits_of(rows.where(test), net)
    whole = bins.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).orderBy("bin").toPandas()
    z, n, ones = (whole[c].to_numpy(np.float64) for c in ("bin", "n", "ones"))
    net.calibrate(np.tile(z / GRID, 2), np.repeat([0.0, 1.0], len(z)), np.concatenate([n - ones, ones]))
    for r in best_cuts(bins).collect():  # one row a language
        cut, below = net.calibrated(np.array([r["bin"], 0 if r["below"] is None else r["below"]]) / GRID)
        net.thresholds[r["lang"]] = float((cut + (0.0 if r["below"] is None else below)) / 2)
    return net


def score_documents(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, threshold, toxic.

    ``predicted`` compares with THRESHOLD, ``toxic`` with the threshold of the
    document's language (THRESHOLD where none was fitted).
    """
    rows = texts_of(docs).select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), text_or_empty(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(net)  # fixed size: ROWS * DIM weights

    @releasing
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch):
                if model is None:
                    scores = np.zeros(len(part))
                else:
                    words = words_of(part.column("text"))
                    scores = model.scores(words.hashes, words.row_first)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.array(scores, pa.float64())], names=["doc_id", "lang", "score"])

    scored = rows.mapInArrow(score, f"doc_id {kind}, lang string, score double")
    fitted = sorted((net.thresholds if net else {}).items())
    cut = F.lit(THRESHOLD)
    for lang, value in fitted:
        cut = F.when(F.coalesce("lang", F.lit("")) == lang, F.lit(value)).otherwise(cut)
    return scored.select(
        "doc_id", (F.coalesce(bucket("doc_id"), F.lit(0)) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), cut.alias("threshold"), (F.col("score") >= cut).cast("int").alias("toxic"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_documents(docs, train_on(docs, labels))
