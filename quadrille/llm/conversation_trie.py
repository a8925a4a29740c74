"""Prefix trie of conversations, from padded matrices of turn ids.

``turn_keys`` orders the turns of every conversation by turn (null first, then by
role and text), numbers them and hashes (role, text) to 128 bits.  ``trie_of``
returns one row per distinct prefix:

1. Conversations are cut into chunks of ``WIDTH`` turns; a chunk's key is its turn
   hashes in a row.  Chunks are range-partitioned and sorted by (key, conv_id), so
   that a group of equal conversations spreads over shards.
2. Each shard goes through in blocks of ``BLOCK_CELLS`` matrix cells.  A block's
   turn ids form a padded matrix; ``lexsort`` orders its rows, the accumulated OR of
   the changes between neighbouring rows, column by column, marks where nodes of
   every depth start, and ``reduceat`` sums over them, deepest first.
3. Nodes that hold a block's first or last row may go on in the next block.  Those
   alone (two paths a block) are kept as parts under a digest of their prefix; an
   aggregate adds the parts up, each such node's own share is given to one path,
   and sums along the paths complete the subtree totals of the nodes above.
4. Chunks that follow a prefix which several conversations share are sorted in turn,
   under the digest of that prefix, deepest level first, and their totals are added
   to the node they hang on.  A conversation that is alone from a chunk on has one
   node a turn there, which need no sorting: so a very long conversation costs no
   more rounds than the longest prefix two conversations share.

The digest of the ids that end at a node is inherently sequential; where such a list
goes over several blocks it is streamed, in order, piece by piece.

Result: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs,
n_children, n_leaves, saved_tokens, ends_sha256.  Null roles and texts are empty.  Rows
without a conv_id belong to no conversation and are left out; ids are integers.
Repeated rows are turns of their own.  Extra columns are ignored.  An empty table has no
conversation and gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.common import write_table
from quadrille.llm.textkit import releasing

WIDTH = 512
BLOCK_CELLS = 1 << 19
HASH = 16  # bytes of a turn's hash
LIST = 1024  # ids in a piece of a long list
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
OUT = NODE + ", kind string, id binary, up binary, block long, side int, longest long, bytes long, ids array<bigint>"
NAMES = [f.split(" ")[0] for f in OUT.split(", ")]


def turn_keys(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, pos, key, n_bytes) of every turn; ``pos`` counts from 0."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256), 1, 2 * HASH))
    rows = rows.select("conv_id", digest.alias("key"), F.octet_length("text").cast("long").alias("n_bytes"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first = last = None
        behind = 0  # rows of the last conversation so far
        for batch in batches:
            if not len(batch):
                continue
            conv = batch.column("conv_id").to_numpy()
            first = conv[0] if first is None else first
            begin = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
            pos = np.arange(len(conv)) - np.repeat(begin, np.diff(np.append(begin, len(conv))))
            if conv[0] == last:
                pos[:begin[1] if len(begin) > 1 else len(conv)] += behind
            last, behind = conv[-1], int(pos[-1]) + 1
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(pos), batch.column("key"), batch.column("n_bytes"),
                                              pa.array(np.full(len(conv), part)), pa.array(conv == first)],
                                             names=["conv_id", "pos", "key", "n_bytes", "part", "opens"])

    rows = write_table(rows.mapInArrow(number, "conv_id long, pos long, key binary, n_bytes long, part long, opens boolean"), "turns")
    # a conversation goes over several parts only as the first of all but one: a row a part
    parts = rows.groupBy("part").agg(F.max("conv_id").alias("last"), F.min("conv_id").alias("first"),
                                     F.max_by("pos", F.struct("conv_id", "pos")).alias("pos")).orderBy("part").collect()
    before, held = [], (None, 0)
    for p in parts:
        ahead = held[1] if held[0] == p["first"] else 0
        if ahead:
            before.append((p["part"], ahead))
        held = p["last"], p["pos"] + 1 + (ahead if p["first"] == p["last"] else 0)
    if not before:
        return rows.select("conv_id", "pos", "key", "n_bytes")
    before = rows.sparkSession.createDataFrame(before, "own long, ahead long")
    rows = rows.join(F.broadcast(before), (F.col("part") == F.col("own")) & F.col("opens"), "left")
    return rows.select("conv_id", (F.col("pos") + F.coalesce("ahead", F.lit(0))).alias("pos"), "key", "n_bytes")


def path_ids(seg: bytes, key: bytes) -> list[bytes]:
    """Digests of a row's prefixes, the empty one first."""
    running = hashlib.sha256(seg + b"/")
    ids = [running.digest()]
    for at in range(0, len(key), HASH):
        running.update(key[at:at + HASH])
        ids.append(running.digest())
    return ids


def ids_digest(ids: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest()


def ranks(values: pa.Array) -> np.ndarray:
    """1, 2, ... in the order of the distinct binary values."""
    coded = values.dictionary_encode()
    words = coded.dictionary.to_pylist()
    rank = np.empty(max(1, len(words)), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(1, len(words) + 1)
    return rank[coded.indices.to_numpy()]


def block_nodes(rows: pa.RecordBatch, block: int, base: int) -> pa.RecordBatch:
    """Nodes of a block of sorted rows: whole ones, parts of those that may go on, lists of ids.

    ``base`` is the depth at which the block's level hangs.
    """
    n = len(rows)
    keys = rows.column("key").to_pylist()
    length = np.array([len(k) // HASH for k in keys], np.int64)
    width = int(length.max())
    matrix, size = np.zeros((n, width + 1), np.int32), np.zeros((n, width + 1), np.int64)
    matrix[:, 0] = ranks(rows.column("seg"))
    cell = np.repeat(np.arange(n) * (width + 1) + 1 - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
    if len(cell):
        letters = pa.FixedSizeBinaryArray.from_buffers(pa.binary(HASH), len(cell), [None, pa.py_buffer(b"".join(keys))])
        matrix.reshape(-1)[cell] = ranks(letters)
        size.reshape(-1)[cell] = rows.column("sizes").flatten().to_numpy()
    conv = rows.column("conv_id").to_numpy()
    order = np.lexsort((conv, *matrix.T[::-1]))
    matrix, size, length, conv = matrix[order], size[order], length[order], conv[order]
    more = rows.column("more").to_numpy(zero_copy_only=False)[order]
    hang_kids, leaves, saved, above = (rows.column(c).fill_null(0).to_numpy()[order] for c in ("kids", "leaves", "saved", "above"))
    reach = length + more

    starts = np.vstack([np.ones((1, width + 1), bool), np.logical_or.accumulate(matrix[1:] != matrix[:-1], axis=1)])
    runs = [np.flatnonzero(starts[:, d]) for d in range(width + 1)]
    least = [np.minimum.reduceat(conv, s) for s in runs]

    # where conversations end: rows of one sequence lie together, at the start of their node
    same = np.flatnonzero(np.append(True, (matrix[1:] != matrix[:-1]).any(axis=1)))
    stop = np.append(same[1:], n)
    first_ids, last_ids = (path_ids(rows.column("seg")[int(order[r])].as_py(), keys[order[r]]) for r in (0, -1))

    out: dict[str, list] = {c: [] for c in NAMES}

    def add(count: int, **values) -> None:
        for c in NAMES:
            v = values.get(c)
            out[c].extend([None] * count if v is None else v.tolist() if isinstance(v, np.ndarray) else v if isinstance(v, list) else [v] * count)

    opened = np.zeros(n, bool)  # where whole nodes one level deeper start
    for d in range(width, -1, -1):
        s = runs[d]
        real = matrix[s, d] != 0
        end = np.append(s[1:], n)
        count = end - s
        whole = real & (s > 0) & (end < n)
        leaf = np.maximum.reduceat(reach, s) == d
        kids = np.add.reduceat(opened + np.where(length == d, hang_kids, 0), s)
        if d:
            leaves[s[whole]] += leaf[whole]
            saved[s[whole]] += ((count - 1) * size[s, d])[whole]
        below, spared = np.add.reduceat(leaves, s), np.add.reduceat(saved, s)
        opened = np.zeros(n, bool)
        opened[s[whole]] = True
        parent = np.searchsorted(runs[max(d - 1, 0)], s, side="right") - 1
        w = np.flatnonzero(whole)
        if len(w):
            up, over = [None] * len(w), (above[s[w]] if d < 2 else least[d - 1][parent[w]]).tolist()
            if d > 1 or (d == 1 and base == 0):  # a parent that may go on is known by its digest
                top = runs[d - 1][parent[w]]
                close = np.append(runs[d - 1][1:], n)[parent[w]]
                for j in np.flatnonzero((top == 0) | (close == n)).tolist():
                    up[j], over[j] = (first_ids if top[j] == 0 else last_ids)[d - 1], None
            add(len(w), kind="node" if d else "top", conv_id=least[d][w], depth=base + d, parent_conv_id=over, n_convs=count[w], n_children=kids[w],
                n_leaves=below[w], saved_tokens=spared[w], ends_sha256=EMPTY, up=up, block=s[w], side=d,
                id=[rows.column("seg")[int(order[r])].as_py() for r in s[w]] if not d else None)
        for side, ids, run in ((0, first_ids, 0), (1, last_ids, len(s) - 1)):
            if d < len(ids):
                own = side == 0 or s[run] > 0  # else the first path tells it
                add(1, kind="part", conv_id=[int(least[d][run])], depth=[base + d], n_convs=[int(count[run]) if own else 0],
                    parent_conv_id=[None if d != 1 or base == 0 else int(above[s[run]])],
                    n_children=[int(kids[run]) if own else 0], n_leaves=[int(below[run]) if own else 0], saved_tokens=[int(spared[run]) if own else 0],
                    id=[ids[d]], up=[ids[d - 1] if d else rows.column("seg")[int(order[s[run]])].as_py()],
                    block=[block], side=[side], longest=[base + int(reach[s[run]:end[run]].max())], bytes=[int(size[s[run], d])])

    # digests of the ids that end at whole nodes; lists for the parts
    at = {(r, d): i for i, (k, r, d) in enumerate(zip(out["kind"], out["block"], out["side"])) if k == "node"}
    for a, b in zip(same.tolist(), stop.tolist()):
        ended = conv[a:b][~more[a:b]]
        if not len(ended):
            continue
        d = int(length[a])
        i = at.get((a, d))
        if i is not None:
            out["ends_sha256"][i] = ids_digest(ended)
        else:
            own = first_ids if starts[:a + 1, d].sum() == 1 else last_ids
            for x in range(0, len(ended), LIST):
                add(1, kind="ends", id=[own[d]], conv_id=[int(ended[x])], ids=[ended[x:x + LIST].tolist()])
    for i in at.values():
        out["block"][i] = out["side"][i] = None
    return pa.RecordBatch.from_arrays([pa.array(out[c], t) for c, t in zip(NAMES, TYPES)], names=NAMES)


ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "array<bigint>": pa.list_(pa.int64())}
TYPES = [ARROW[f.split(" ")[1]] for f in OUT.split(", ")]


def blocks_of(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose padded matrix has about ``cells`` cells (a row at least)."""
    held, rows, width = [], 0, 0
    for batch in batches:
        lengths = np.array([len(k) // HASH + 1 for k in batch.column("key").to_pylist()], np.int64)
        at = 0
        while at < len(batch):
            widest = np.maximum(np.maximum.accumulate(lengths[at:]), width)
            fits = int(np.searchsorted(widest * (np.arange(len(widest)) + 1 + rows), cells, side="right"))
            if fits == 0 and not rows:
                fits = 1
            if fits:
                held.append(batch.slice(at, fits))
                rows, width, at = rows + fits, int(widest[fits - 1]), at + fits
            if at < len(batch):
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, rows, width = [], 0, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def ends_of(lists: DataFrame) -> DataFrame:
    """(id, ends_sha256) of lists in pieces: (id, conv_id: the first, ids)."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = running = None
        for batch in batches:
            done = []
            for key, ids in zip(batch.column("id").to_pylist(), batch.column("ids")):
                text = ",".join(map(str, ids.values.to_numpy().tolist())).encode()
                if key == own:
                    running.update(b"," + text)
                    continue
                if own is not None:
                    done.append((own, running.hexdigest()))
                own, running = key, hashlib.sha256(text)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([h for _, h in done], pa.string())], names=["own", "ends"])
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array([own], pa.binary()), pa.array([running.hexdigest()])], names=["own", "ends"])

    return lists.repartition("id").sortWithinPartitions("id", "conv_id").mapInArrow(digest, "own binary, ends string")


def level_nodes(rows: DataFrame, level: int, width: int, cells: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, tops) of one level; ``tops`` has the totals of what hangs on each prefix (seg)."""
    base = level * width

    @releasing
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for rows in blocks_of(batches, cells):
            yield block_nodes(rows, block, base)
            block += 1

    order = ["seg", "key", "conv_id"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    found = write_table(rows.mapInArrow(build, OUT), "trie_blocks")

    # parts of one node add up
    parts = found.where("kind = 'part'")
    edges = parts.groupBy("id").agg(
        F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.max("parent_conv_id").alias("parent_conv_id"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"),
        F.max("longest").alias("longest"), F.max("bytes").alias("bytes"), F.max("up").alias("up"), F.min(F.struct("block", "side")).alias("owner"))
    edges = write_table(edges, "trie_edges")
    # a node's own share belongs to one path; sums from the deepest node on give it to those above
    share = edges.select(F.col("id").alias("of"), "owner", F.col("longest").alias("far"), (F.col("n_convs") - 1).alias("again"), F.col("bytes").alias("each"))
    path = parts.join(share, F.col("id") == F.col("of"))
    mine = F.col("owner") == F.struct("block", "side")
    counts = mine & ((F.col("depth") > base) | (base == 0))
    along = Window.partitionBy("block", "side").orderBy(F.col("depth").desc())
    path = path.select("of", F.sum(F.when(counts & (F.col("far") == F.col("depth")), 1).otherwise(0)).over(along).alias("leaves"),
                       F.sum(F.when(counts & (F.col("depth") > base), F.col("again") * F.col("each")).otherwise(0)).over(along).alias("saved"),
                       F.lag(mine.cast("long"), 1, 0).over(along).alias("kid"))
    path = path.groupBy("of").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.sum("kid").alias("kid"))
    ends = ends_of(found.where("kind = 'ends'").select("id", "conv_id", "ids"))
    edges = edges.join(path, F.col("id") == F.col("of")).join(ends, F.col("id") == F.col("own"), "left")
    edges = write_table(edges.select(
        "id", "up", "conv_id", "depth", "parent_conv_id", "n_convs", (F.col("n_children") + F.col("kid")).alias("n_children"),
        (F.col("n_leaves") + F.col("leaves")).alias("n_leaves"), (F.col("saved_tokens") + F.col("saved")).alias("saved_tokens"),
        F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256")), "trie_paths")

    names = [f.split(" ")[0] for f in NODE.split(", ")]
    over = edges.select(F.col("id").alias("of"), F.col("conv_id").alias("over"))
    inner = edges.where(F.col("depth") > base) if level else edges
    some = found.where("kind = 'node'").select("up", *names).unionByName(inner.select("up", *names))
    nodes = some.where(F.col("parent_conv_id").isNotNull() | F.col("up").isNull()).select(*names).unionByName(
        some.where(F.col("parent_conv_id").isNull() & F.col("up").isNotNull()).join(over, F.col("up") == F.col("of"), "left")
        .withColumn("parent_conv_id", F.col("over")).select(*names))
    total = ["n_children", "n_leaves", "saved_tokens"]
    tops = found.where("kind = 'top'").select("id", *total).unionByName(edges.where(F.col("depth") == base).select(F.col("up").alias("id"), *total))
    return nodes, tops


def trie_of(keys: DataFrame, width: int = WIDTH, cells: int = BLOCK_CELLS) -> DataFrame:
    """The nodes of all conversations in ``keys`` (conv_id, pos, key, n_bytes).

    A row with a null ``pos`` says that there is such a conversation, with turns or not.
    """
    turn = F.when(F.col("pos").isNotNull(), F.struct("pos", F.hex("key").alias("key"), "n_bytes"))
    chunk = F.coalesce(F.floor(F.col("pos") / width), F.lit(0)).cast("long")
    chunks = keys.groupBy("conv_id", chunk.alias("chunk")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    chunks = write_table(chunks.select("conv_id", "chunk", F.unhex(F.array_join("turns.key", "")).alias("key"),
                                       F.col("turns.n_bytes").alias("sizes")), "chunks")
    deepest = chunks.agg(F.max("chunk")).first()[0]
    if deepest is None:
        return chunks.sparkSession.createDataFrame([], NODE)

    none = F.lit(0).cast("long")
    now = chunks.where("chunk = 0").select(F.lit(b"").alias("seg"), "conv_id", "key", "sizes", F.lit(None).cast("long").alias("above"))
    levels, tails = [], []
    while True:
        level = len(levels)
        if level == deepest:
            levels.append((now, None, None))
            break
        hang = F.unhex(F.sha2(F.concat("seg", F.lit(b"/"), "key"), 256))
        now = write_table(now.withColumn("hang", hang), "trie_level")
        follow = chunks.where(F.col("chunk") == level + 1).select(F.col("conv_id").alias("who"), F.col("key").alias("next_key"), F.col("sizes").alias("next_sizes"))
        # the smallest member of the node that the next chunk hangs on, and who goes on
        over = now.groupBy("hang").agg(F.min("conv_id").alias("above")).withColumnRenamed("hang", "at")
        on = now.drop("above").join(follow, F.col("conv_id") == F.col("who"))
        on = write_table(on.select("conv_id", "hang", F.col("next_key").alias("key"), F.col("next_sizes").alias("sizes")), "trie_next")
        met = write_table(on.groupBy("hang").agg(F.count("*").alias("n"), F.min("conv_id").alias("least")).withColumnRenamed("hang", "to")
                          .join(over, F.col("to") == F.col("at")).drop("at"), "trie_met")
        levels.append((now, on, met))
        on = on.join(met, F.col("hang") == F.col("to"))
        tails.append((level + 1, on.where("n = 1").select("conv_id", "above")))
        now = on.where("n > 1").select(F.col("hang").alias("seg"), "conv_id", "key", "sizes", "above")
        if not met.where("n > 1").limit(1).count():
            break

    results, tops = [], None
    for level in range(len(levels) - 1, -1, -1):
        rows, on, met = levels[level]
        if on is None:
            rows = rows.select("seg", "conv_id", "key", "sizes", "above", F.lit(False).alias("more"), none.alias("kids"), none.alias("leaves"), none.alias("saved"))
        else:
            on = on.select(F.col("conv_id").alias("who"))
            lone = met.where("n = 1").select(F.col("least").alias("first"), F.lit(1).cast("long").alias("k"), F.lit(1).cast("long").alias("l"), none.alias("s"))
            if tops is not None:
                lone = lone.unionByName(tops.join(met.where("n > 1"), F.col("id") == F.col("to")).select(
                    F.col("least").alias("first"), F.col("n_children").alias("k"), F.col("n_leaves").alias("l"), F.col("saved_tokens").alias("s")))
            rows = rows.join(on, F.col("conv_id") == F.col("who"), "left").join(lone, F.col("conv_id") == F.col("first"), "left")
            rows = rows.select("seg", "conv_id", "key", "sizes", "above", F.col("who").isNotNull().alias("more"),
                               *(F.coalesce(c, none).alias(x) for c, x in (("k", "kids"), ("l", "leaves"), ("s", "saved"))))
        nodes, tops = level_nodes(rows, level, width, cells)
        results.append(nodes)
    if tails:
        last = chunks.groupBy("conv_id").agg((F.max(F.col("chunk") * width + F.size("sizes"))).alias("n")).withColumnRenamed("conv_id", "of")
        alone = None
        for level, who in tails:
            one = who.select(F.col("conv_id").alias("who"), "above", F.lit(level).alias("from"))
            alone = one if alone is None else alone.unionByName(one)
        alone = write_table(alone.join(last, F.col("who") == F.col("of")).drop("of"), "trie_tails")
        turns = chunks.join(alone, (F.col("conv_id") == F.col("who")) & (F.col("chunk") >= F.col("from")))
        turns = turns.select("conv_id", "above", "from", "n", (F.col("chunk") * width).alias("at"), F.explode(F.sequence(F.lit(1), F.size("sizes"))).alias("j"))
        depth = F.col("at") + F.col("j")
        ends = depth == F.col("n")
        one = F.lit(1).cast("long")
        results.append(turns.select(
            "conv_id", depth.alias("depth"), F.when(depth == F.col("from") * width + 1, F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
            one.alias("n_convs"), F.when(ends, none).otherwise(one).alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"),
            F.when(ends, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(EMPTY)).alias("ends_sha256")))
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out


def conversation_trie(turns: DataFrame, width: int = WIDTH, cells: int = BLOCK_CELLS, **columns) -> DataFrame:
    """The prefix trie of the conversations in a table of turns."""
    return trie_of(turn_keys(turns, **columns), width, cells)


def spliced(keys: DataFrame, h, most: int, of) -> DataFrame:
    """Keys of rebuilt conversations: the first ``h`` turns of conversation ``of``
    (none if it is absent), then the own turns after the first ``h``.

    ``h`` (at most ``most``) and ``of`` are columns over ``conv_id``.
    """
    opening = F.sort_array(F.collect_list(F.when(F.col("pos") < most, F.struct("pos", "key", "n_bytes"))))
    convs = write_table(keys.groupBy("conv_id").agg(opening.alias("opening")), "openings")
    given = convs.select(F.col("conv_id").alias("giver"), F.col("opening").alias("given"))
    convs = convs.select("conv_id", h.alias("h"), of.alias("of")).join(given, F.col("of") == F.col("giver"), "left")
    head = F.when(F.col("h") > 0, F.slice(F.coalesce("given", F.array().cast("array<struct<pos:bigint,key:binary,n_bytes:bigint>>")), 1, F.greatest("h", F.lit(1)).cast("int")))
    convs = write_table(convs.select("conv_id", "h", F.coalesce(head, F.array().cast("array<struct<pos:bigint,key:binary,n_bytes:bigint>>")).alias("head")), "heads")
    front = convs.select("conv_id", F.explode_outer("head").alias("t")).select("conv_id", "t.pos", "t.key", "t.n_bytes")
    shift = convs.select(F.col("conv_id").alias("who"), "h", F.size("head").alias("m"))
    rest = keys.join(shift, (F.col("conv_id") == F.col("who")) & (F.col("pos") >= F.col("h")))
    return front.unionByName(rest.select("conv_id", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "key", "n_bytes"))
