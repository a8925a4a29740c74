"""N-gram Jaccard self-join by multiple global orders.

A document's set is its distinct 5-word shingles (all words if fewer).  Two sets
link at a Jaccard similarity of ``percent`` / 100 or more.  Linked sets must
share tokens among their first ones under every global order of tokens, so:

1. Order 1 (by hash).  Each set puts forward its first n - ceil(0.75 n) + k
   tokens; a linked partner shares at least k of them.  Tokens met by two
   different sets within a task's batch are known there and leave it once; the
   others meet in one exchange by token.  Sets with too few shared tokens are out.
2. Of the sets left, all tokens are counted.  A token of a single set can match
   nothing; a set with less than 75 % of other tokens is out.  Order A puts rare
   tokens first, orders B and C are two more permutations.
3. Under order A every token of a prefix names a pivot, the member with the
   fewest private tokens.  Each set is compared with its best pivot, if the two
   share prefix tokens under B and C as well, which joins most of a large group
   in a linear number of comparisons.
4. What is left are pairs in different components.  Sets are dealt into tiles of
   about ``TILE`` by the component they lean to, and tiles that share a prefix
   token between different components (and pass the length and position bounds)
   are compared in one group of two tiles: only pairs that share prefix tokens
   under A, B and C are verified.  A task holds two tiles, never a group of
   copies, and emits only links that join components.

Equal sets are one class from the start (64-bit sum of hashed tokens and the
size).  Documents need integer ids.  Null and empty texts, and texts of white
space, have no shingles and link with nothing.  Rows that repeat an id are
documents of equal id; a null id keeps its links but is never a component's id
unless all are null.  Extra columns are ignored.  An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import text_or_empty, texts_of, write_result, write_table
from quadrille.llm.components import connected_components
from quadrille.llm.textkit import gram_hashes, mix, releasing, slices, words_of

WIDTH, PERCENT = 5, 75
FLUSH = 500_000  # tokens a task gathers before it lets go of them
TILE = 128  # sets of a tile
SENT = 1_000_000  # rows of two numbers that may be broadcast (75 MB as a hash table); more are exchanged


def least_overlap(n, percent: int):
    """Tokens that a set of ``n`` shares with any linked partner, at least."""
    return -(-percent * n // 100)


def sets_of(column: pa.Array, width: int = WIDTH) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct shingles of each row, and the rows' set hashes."""
    words = words_of(column)
    grams, _, first = gram_hashes(words, width, whole_if_short=True)
    sets = [np.unique(grams[a:b]) for a, b in zip(first, first[1:])]
    sums = np.array([mix(s + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64) for s in sets], np.uint64)
    return sets, mix(sums + np.array([len(s) for s in sets], np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


# kinds of rows of the first exchange
MET_ONCE, KNOWN, SHARED, DOCUMENT = 0, 1, 2, 3


def put_forward(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """kind, token, sig, num, doc_id: prefixes under order 1, gathered per batch."""

    def flush(held: dict[int, np.ndarray]) -> Iterator[tuple]:
        if not held:
            return
        sigs = np.fromiter(held, np.int64, len(held))
        tokens = np.concatenate(list(held.values()))
        owner = np.repeat(np.arange(len(sigs)), [len(v) for v in held.values()])
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        first = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
        times = np.diff(np.append(first, len(tokens)))
        once = first[times == 1]
        yield MET_ONCE, tokens[once].view(np.int64), sigs[owner[once]], np.zeros(len(once), np.int64)
        known = first[times > 1]
        yield KNOWN, tokens[known].view(np.int64), np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
        shared = np.bincount(owner[np.repeat(times > 1, times)], minlength=len(sigs))
        some = np.flatnonzero(shared)
        yield SHARED, mix(sigs[some].view(np.uint64)).view(np.int64), sigs[some], shared[some]

    def packed(kind, token, sig, num, ids=None) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(token), 1 << 16):
            hi = min(len(token), lo + (1 << 16))
            own = pa.nulls(hi - lo, pa.int64()) if ids is None else ids.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(hi - lo, kind, np.int8)), pa.array(token[lo:hi]), pa.array(sig[lo:hi]), pa.array(num[lo:hi]), own],
                                             names=["kind", "token", "sig", "num", "doc_id"])

    @releasing
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for batch in batches:
            for part in slices(batch):
                sets, sigs = sets_of(part.column("text"), width)
                sizes = np.array([len(s) for s in sets], np.int64)
                yield from packed(DOCUMENT, mix(sigs.view(np.uint64) + np.arange(len(sigs), dtype=np.uint64)).view(np.int64), sigs, sizes, part.column("doc_id"))
                for s, sig in zip(sets, sigs.tolist()):
                    n = len(s)
                    if n and sig not in held:
                        held[sig] = s[:n - least_overlap(n, percent) + 1 + n // 10]
                        size += len(held[sig])
                if size >= FLUSH:
                    for out in flush(held):
                        yield from packed(*out)
                    held, size = {}, 0
        for out in flush(held):
            yield from packed(*out)

    return rows.mapInArrow(look, "kind byte, token long, sig long, num long, doc_id long")


@releasing
def count_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per partition of tokens: how many tokens each set shares; documents pass."""

    def packed(kind, ids, sig, num):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(sig), kind, np.int8)), ids, pa.array(sig), pa.array(num)], names=["kind", "doc_id", "sig", "num"])

    tokens, sigs, known = [], [], []
    for batch in batches:
        kind, token, sig, num = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("kind", "token", "sig", "num"))
        for k in (SHARED, DOCUMENT):
            some = np.flatnonzero(kind == k)
            if len(some):
                yield packed(k, batch.column("doc_id").take(pa.array(some)), sig[some], num[some])
        some = np.flatnonzero(kind <= KNOWN)
        tokens.append(token[some])
        sigs.append(sig[some])
        known.append(kind[some] == KNOWN)
    if not tokens:
        return
    token, sig, known = np.concatenate(tokens), np.concatenate(sigs), np.concatenate(known)
    if not len(token):
        return
    order = np.argsort(token, kind="stable")
    token, sig, known = token[order], sig[order], known[order]
    first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    times = np.diff(np.append(first, len(token)))
    shared = np.logical_or.reduceat(known, first) | (np.minimum.reduceat(sig, first) != np.maximum.reduceat(sig, first))
    own, counts = np.unique(sig[np.repeat(shared, times) & ~known], return_counts=True)
    yield packed(SHARED, pa.nulls(len(own), pa.int64()), own, counts)


def tokens_of_survivors(docs: DataFrame, left: DataFrame, width: int) -> DataFrame:
    """(token, sig, n) of one document of each set in ``left`` (sig, rep)."""
    wanted = left.select("rep", F.col("sig").alias("want"))
    if left.count() <= SENT:
        wanted = F.broadcast(wanted)
    texts = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["rep"])).select("text", "want")

    @releasing
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets, sigs = sets_of(part.column("text"), width)
                some = np.flatnonzero(part.column("want").to_numpy(zero_copy_only=False) == sigs)
                if not len(some):
                    continue
                sizes = np.array([len(sets[r]) for r in some])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([sets[r] for r in some]).view(np.int64)), pa.array(np.repeat(sigs[some], sizes)), pa.array(np.repeat(sizes, sizes))],
                    names=["token", "sig", "n"])

    return texts.mapInArrow(look, "token long, sig long, n long")


ORDERS = "ABC"


def in_order(tokens: np.ndarray, often: np.ndarray, order: str) -> np.ndarray:
    """Indices of a set's shared tokens under a global order."""
    if order == "A":
        return np.lexsort((tokens, often))
    if order == "B":
        return np.argsort(mix(tokens), kind="stable")
    return np.lexsort((mix(~tokens), np.frexp(often.astype(float))[1]))  # rare ones first, in doublings


def ordered_sets(sets: DataFrame, percent: int) -> DataFrame:
    """sig, n, s, and as packed uint64: tokens (sorted) and the prefixes under A, B, C."""

    @releasing
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {n: [] for n in ("tokens", *ORDERS)}
            lists = batch.column("tokens")
            flat, offsets = lists.flatten(), np.asarray(lists.offsets) - lists.offsets[0].as_py()
            token = flat.field("token").to_numpy(zero_copy_only=False).view(np.uint64)
            often = flat.field("often").to_numpy(zero_copy_only=False)
            for r, n in enumerate(batch.column("n").to_pylist()):
                t, o = token[offsets[r]:offsets[r + 1]], often[offsets[r]:offsets[r + 1]]
                t, place = np.unique(t, return_index=True)
                o = o[place]
                out["tokens"].append(t.tobytes())
                for order in ORDERS:
                    out[order].append(t[in_order(t, o, order)[:max(0, len(t) - least_overlap(n, percent) + 1)]].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("sig"), batch.column("n"), batch.column("s"), *[pa.array(v, pa.binary()) for v in out.values()]],
                                             names=["sig", "n", "s", *out])

    return sets.mapInArrow(look, "sig long, n long, s long, tokens binary, A binary, B binary, C binary")


def prefix_rows(sets: DataFrame) -> DataFrame:
    """(token, sig, n, rest, rank): the prefixes under order A; ``rest`` are the
    set's shared tokens from this one on, ``rank`` is smaller for better pivots."""

    @releasing
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            prefix = [np.frombuffer(v.as_py(), np.int64) for v in batch.column("A")]
            sizes = np.array([len(p) for p in prefix])
            n, s = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "s"))
            place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(prefix)), pa.array(np.repeat(batch.column("sig").to_numpy(zero_copy_only=False), sizes)), pa.array(np.repeat(n, sizes)),
                 pa.array(np.repeat(s, sizes) - place), pa.array(np.repeat((n - s) / n, sizes))], names=["token", "sig", "n", "rest", "rank"])

    return sets.select("sig", "n", "s", "A").mapInArrow(look, "token long, sig long, n long, rest long, rank double")


def similar(na: int, nb: int, overlap: int, percent: int) -> bool:
    return 100 * overlap >= percent * (na + nb - overlap)


def verified_stars(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of ``stars`` that share prefix tokens under B and C as well
    (their pivot's token is one under A), and link."""
    names = ["n", "tokens", "B", "C"]
    one = sets.select(F.col("sig").alias("a"), *[F.col(n).alias(f"{n}_a") for n in names])
    two = sets.select(F.col("sig").alias("b"), *[F.col(n).alias(f"{n}_b") for n in names])
    pairs = write_table(stars.join(one, "a"), "star_sets").join(two, "b")

    def common(x: bytes, y: bytes) -> int:
        return len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))

    @releasing
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for na, ta, ba, ca, nb, tb, bb, cb in zip(*[batch.column(f"{n}_{side}").to_pylist() for side in "ab" for n in names]):
                maybe = 100 * min(na, nb) >= percent * max(na, nb) and common(ba, bb) and common(ca, cb)
                ok.append(bool(maybe) and similar(na, nb, common(ta, tb), percent))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.select("a", "b", *[f"{n}_{side}" for side in "ab" for n in names]).mapInArrow(look, "a long, b long")


def incidence(sets: list[np.ndarray]) -> np.ndarray:
    """0/1 matrix of sets by the tokens that at least two of them have."""
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    token, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    kept = np.cumsum(times > 1) - 1
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    use = times[column] > 1
    out = np.zeros((len(sets), int((times > 1).sum())), np.float32)
    out[row[use], kept[column[use]]] = 1
    return out


def links_of_tiles(percent: int):
    """For a group of two tiles: links between sets of different components."""

    def look(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        sig, n, root = (group.column(c).to_numpy() for c in ("sig", "n", "root"))
        open_pairs = np.triu(root[:, None] != root[None, :], 1)
        open_pairs &= (100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :]))
        for order in ORDERS:  # candidates share prefix tokens under every order
            if open_pairs.any():
                m = incidence([np.frombuffer(v.as_py(), np.uint64) for v in group.column(order)])
                open_pairs &= (m @ m.T) > 0
        a, b = np.nonzero(open_pairs)
        links_a, links_b = [], []
        if len(a):
            sets = [np.frombuffer(v.as_py(), np.uint64) for v in group.column("tokens")]
            joined = {int(r): int(r) for r in root}

            def top(r):
                while joined[r] != r:
                    r = joined[r]
                return r

            for i, j in zip(a.tolist(), b.tolist()):
                ri, rj = top(int(root[i])), top(int(root[j]))
                if ri == rj:
                    continue
                if similar(n[i], n[j], len(np.intersect1d(sets[i], sets[j], assume_unique=True)), percent):
                    joined[max(ri, rj)] = min(ri, rj)
                    links_a.append(sig[i])
                    links_b.append(sig[j])
        return pa.table({"a": pa.array(links_a, pa.int64()), "b": pa.array(links_b, pa.int64())})

    return look


def links(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(documents, links): doc_id, sig, num (set size) of all documents, and links
    (a, b) between set hashes that span every component."""
    docs = docs.select("doc_id", "text")
    first = put_forward(docs, width, percent).repartition("token").mapInArrow(count_shared, "kind byte, doc_id long, sig long, num long")
    first = write_table(first, "order_1")
    documents = first.where(F.col("kind") == DOCUMENT).select("doc_id", "sig", "num")
    shared = first.where(F.col("kind") == SHARED).groupBy("sig").agg(F.sum("num").alias("shared"))
    return documents, write_result(lambda: links_among(docs, documents, shared, width, percent), "all_links")


def links_among(docs: DataFrame, documents: DataFrame, shared: DataFrame, width: int, percent: int) -> DataFrame:
    """The links of ``links``; ``shared`` has the shingles that a set shares with others (sig, shared)."""
    classes = documents.where("num > 0").groupBy("sig", "num").agg(F.min("doc_id").alias("rep"))
    partner = F.ceil(F.col("num") * percent / 100)
    left = write_table(classes.join(shared, "sig").where(F.col("shared") >= 1 + F.floor(partner / 10)).select("sig", "rep"), "survivors")

    flat = write_table(tokens_of_survivors(docs, left, width), "tokens")
    often = write_table(flat.groupBy("token").agg(F.count("*").alias("often")).where("often > 1"), "token_counts")
    sets = flat.join(often, "token").groupBy("sig", "n").agg(F.collect_list(F.struct("token", "often")).alias("tokens"))
    sets = sets.withColumn("s", F.size("tokens").cast("long")).where(F.col("s") >= F.ceil(F.col("n") * percent / 100))
    sets = write_table(ordered_sets(sets, percent), "sets")

    prefixes = write_table(prefix_rows(sets), "prefixes")
    pivots = prefixes.groupBy("token").agg(F.min_by("sig", "rank").alias("b"), F.min("rank").alias("b_rank"), F.count("*").alias("members"))
    pivots = write_table(pivots.where("members > 1").select(F.col("token").alias("at"), "b", "b_rank"), "pivots")
    stars = prefixes.join(pivots, F.col("token") == F.col("at")).where(F.col("sig") != F.col("b"))
    stars = write_table(stars.groupBy(F.col("sig").alias("a")).agg(F.min_by("b", "b_rank").alias("b")), "star_pairs")
    found = write_table(verified_stars(stars, sets, percent), "star_links")

    roots = write_table(connected_components(found), "star_components")
    named = sets.select("sig").join(roots, F.col("sig") == F.col("node"), "left").select("sig", F.coalesce("root", "sig").alias("root"))
    named = write_table(named, "set_roots")
    lean = named.join(stars, F.col("sig") == F.col("a"), "left").select("sig", "root", F.when(F.col("root") == F.col("sig"), F.col("b")).alias("to"))
    target = named.select(F.col("sig").alias("t_sig"), F.col("root").alias("t_root"))
    lean = write_table(lean.join(target, F.col("to") == F.col("t_sig"), "left").select("sig", "root", F.coalesce("t_root", "root").alias("family")), "families")
    size = write_table(lean.groupBy("family").agg(F.ceil(F.count("*") / TILE).alias("tiles")), "family_sizes")
    tiles = lean.join(size, "family").select("sig", "root", F.xxhash64("family", F.pmod(F.xxhash64("sig"), F.col("tiles"))).alias("tile"))
    tiles = write_table(tiles, "tiles")

    places = prefixes.join(tiles, "sig").groupBy("token", "tile").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.min("n").alias("n_low"), F.max("n").alias("n_high"), F.max("rest").alias("rest"))
    # only tokens met by several components matter from here on
    mixed = places.groupBy("token").agg((F.min("low") != F.max("high")).alias("mixed")).where("mixed").select(F.col("token").alias("m_token"))
    places = write_table(places, "tile_tokens")
    places = write_table(places.join(write_table(mixed, "mixed_tokens"), F.col("token") == F.col("m_token"), "left_semi"), "mixed_places")
    x, y = places.alias("x"), places.alias("y")
    meet = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.tile") <= F.col("y.tile")))
    apart = (F.least("x.low", "y.low") != F.greatest("x.high", "y.high"))
    long_enough = (100 * F.col("x.n_high") >= percent * F.col("y.n_low")) & (100 * F.col("y.n_high") >= percent * F.col("x.n_low"))
    need = F.ceil(percent * (F.col("x.n_low") + F.col("y.n_low")) / (100 + percent))
    reach = F.least("x.rest", "y.rest") >= need
    meet = write_table(meet.where(apart & long_enough & reach).select(F.col("x.tile").alias("p"), F.col("y.tile").alias("q")).distinct(), "tile_pairs")
    sides = meet.select("p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("side"))
    sides = sides.join(tiles, F.col("side") == F.col("tile")).select("p", "q", "sig", "root")
    work = write_table(sides, "tile_members").join(sets.select("sig", "n", "tokens", *ORDERS), "sig").select("p", "q", "sig", "n", "root", "tokens", *ORDERS)
    more = work.groupBy("p", "q").applyInArrow(links_of_tiles(percent), "a long, b long")
    return found.unionByName(more)


def jaccard_join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    rows = texts_of(docs).select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    documents, found = links(rows, width, percent)
    classes = write_result(lambda: class_components(documents, found), "class_components")
    joined = documents.join(classes, (F.col("sig") == F.col("c_sig")) & (F.col("num") == F.col("c_num")), "left")
    return joined.select("doc_id", F.col("num").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def class_components(documents: DataFrame, found: DataFrame) -> DataFrame:
    """The component of each set of shingles (c_sig, c_num, component_id)."""
    roots = connected_components(found)
    classes = documents.where("num > 0").groupBy("sig", "num").agg(F.min("doc_id").alias("rep"))
    rooted = classes.join(roots, F.col("sig") == F.col("node"), "left").select("sig", "num", "rep", F.coalesce("root", "sig").alias("root"))
    rooted = write_table(rooted, "class_roots")
    named = write_table(rooted.groupBy("root").agg(F.min("rep").alias("component_id")), "component_ids")
    return rooted.join(named, "root").select(F.col("sig").alias("c_sig"), F.col("num").alias("c_num"), "component_id")
