"""Token-ID output in Arrow IPC files of fixed-size-list batches.

Documents in ascending id order (null ids last, equal ids by text) are encoded,
an end id is appended to each, and the ids of a file's documents form one stream
that is cut into sequences of equal length.  A file holds record batches of
``BATCH`` sequences (the last batch may be shorter), so sequence ``i`` sits in
batch ``i // BATCH`` at row ``i % BATCH`` and is read from the memory map
without a copy:

* ``ids``: fixed_size_list<uint16 or uint32, seq_len>, by vocabulary size,
* ``mask``: fixed_size_list<bool, seq_len>, false on the padding that fills up
  the last sequence of a file.

Beside each file lies ``<file>.docs``, an Arrow file (doc_id, first, n_tokens)
with each document's place in the stream.  Both are written by the task that
owns the range of ids under names of their own; a table of the files that
finished tasks wrote is the commit, so files of lost tasks are never read.

Null and empty texts give the end id alone.  Repeated rows are separate
documents.  Extra columns are ignored.  An empty table gives no files and an
empty result.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.llm.common import task_filesystem, text_or_empty, texts_of, write_table
from quadrille.llm.textkit import SHORT, eights, masked, releasing, slices, words_of
from quadrille.plans.session import shared_output_dir

SEQ_LEN = 2048
BATCH = 64  # sequences of a record batch
REMEMBER = 1 << 21  # words a worker remembers at most (a power of two; about 24 bytes each)
MOST_OTHERS = 20_000  # other pieces
TEXT_BYTES = 1 << 20  # encoded at a time
BLANKS = " \t\n\r"
JOINED = 500  # pieces encoded as one text

#: White space beyond ASCII, in UTF-8: texts that hold it are encoded whole.
FAR_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def equal_spans(data: np.ndarray, starts: np.ndarray, other: np.ndarray, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether spans of equal sizes hold the same bytes, eight at a time."""
    same = np.ones(len(sizes), bool)
    alive, at = np.arange(len(sizes)), 0
    ours, theirs = eights(data), eights(other)
    while len(alive):
        left = sizes[alive] - at
        ok = masked(ours[starts[alive] + at], left) == masked(theirs[others[alive] + at], left)
        same[alive[~ok]] = False
        at += 8
        alive = alive[ok & (left > 8)]
    return same


class Encoder:
    """Encodes batches of texts; what it has met before it looks up.

    A text is cut before every white space that follows another character, where
    no token of byte-level BPE can span.  Nearly all pieces are a space and a
    word: a table of ``slots`` entries, addressed by the word's hash, says where
    their ids are in ``flat``, and where its bytes are in ``letters``: an entry holds
    for a word only if all bytes agree.  A newer word takes over an entry; when ``flat``
    is full the table starts anew, so memory is bounded.  Other pieces (words over 64
    bytes, after line feeds or several spaces, at the start or the end) are kept by
    their bytes.
    """

    def __init__(self, path: str, end_id: int, slots: int = REMEMBER):
        self.slots = slots
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.end = end_id
        self.forget()

    def forget(self) -> None:
        self.spelt, self.size = np.zeros(self.slots, np.int32), np.zeros(self.slots, np.uint8)
        self.letters, self.written = np.zeros(1 << 16, np.uint8), 0
        self.place, self.length = np.zeros(self.slots, np.int32), np.zeros(self.slots, np.int32)
        self.flat = np.zeros(1 << 16, self.dtype)
        self.flat[0], self.used = self.end, 1
        self.others: dict[bytes, tuple[int, int]] = {}

    def ids_of(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each piece.

        Pieces that start with white space and end in another character are no
        different next to each other, so they are encoded as one text.
        """
        found: dict[str, list[int]] = {}
        plain = [p for p in pieces if p[0] in BLANKS and not p[-1].isspace()]
        for at in range(0, len(plain), JOINED):
            some = plain[at:at + JOINED]
            whole = self.tokenizer.encode("".join(some), add_special_tokens=False)
            place = np.array([o[0] for o in whole.offsets], np.int64)
            ids, last = whole.ids, 0
            for p, cut in zip(some, np.searchsorted(place, np.cumsum([len(p) for p in some])).tolist()):
                found[p], last = ids[last:cut], cut
        return [found[p] if p in found else self.tokenizer.encode(p, add_special_tokens=False).ids for p in pieces]

    def keep(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Encodes pieces into ``flat``: their places and lengths."""
        each = self.ids_of([p.decode("utf-8") for p in pieces])
        lengths = np.array([len(e) for e in each], np.int64)
        need = self.used + int(lengths.sum())
        while need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used:need] = np.fromiter(chain.from_iterable(each), self.dtype, need - self.used)
        places = self.used + np.cumsum(lengths) - lengths
        self.used = need
        return places, lengths

    def agree(self, slot: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether the entries hold these very words, by length and bytes."""
        same = self.size[slot] == sizes
        same[same] = equal_spans(self.letters, self.spelt[slot[same]], data, starts[same], sizes[same])
        return same

    def spell(self, slot: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        """Notes the words' bytes for their entries."""
        need = self.written + int(sizes.sum())
        while need > len(self.letters):
            self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
        upto = np.cumsum(sizes) - sizes
        self.letters[self.written:need] = data[np.repeat(starts - upto, sizes) + np.arange(need - self.written)]
        self.spelt[slot], self.size[slot] = self.written + upto, sizes
        self.written = need

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, each with the end id behind it, and how many each has."""
        if self.used > 4 * self.slots or self.written > 16 * self.slots:
            self.forget()
        words = words_of(texts, lower=False)
        data, bounds = words.data, words.row_bytes
        raw = data.tobytes()
        rows = np.repeat(np.arange(len(texts)), np.diff(words.row_first))
        far = np.zeros(len(texts), bool)
        far[np.searchsorted(bounds, [m.start() for m in FAR_SPACE.finditer(raw)], side="right") - 1] = True
        use = ~far[rows]
        starts, ends, hashes, rows = words.starts[use], words.ends[use], words.hashes[use], rows[use]

        # the bytes from the last word on belong to a piece
        begins = bounds[rows].copy()
        follows = rows[1:] == rows[:-1]
        begins[1:][follows] = ends[:-1][follows]
        plain = np.append(False, follows)[:len(rows)] & (starts - begins == 1)
        plain[plain] = data[begins[plain]] == 32
        plain &= ends - starts <= SHORT

        place, length = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        slot = (hashes & np.uint64(self.slots - 1)).astype(np.int64)
        met = plain.copy()
        met[plain] = self.agree(slot[plain], data, starts[plain], (ends - starts)[plain])
        place[met], length[met] = self.place[slot[met]], self.length[slot[met]]
        new = np.flatnonzero(plain & ~met)
        if len(new):
            first, which = np.unique(hashes[new], return_index=True, return_inverse=True)[1:]
            sizes, other = (ends - starts)[new], new[first][which]
            if not (np.array_equal(sizes, (ends - starts)[other]) and equal_spans(data, starts[new], data, starts[other], sizes).all()):
                # words that differ in spite of one hash are told apart by their bytes
                spans = pa.array([raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist())], pa.large_binary())
                which = spans.dictionary_encode().indices.to_numpy()
                first = np.unique(which, return_index=True)[1]
            at = new[first]
            p, n = self.keep([raw[a:b] for a, b in zip(begins[at].tolist(), ends[at].tolist())])
            place[new], length[new] = p[which], n[which]
            self.place[slot[at]], self.length[slot[at]] = p, n
            self.spell(slot[at], data, starts[at], (ends - starts)[at])

        # other pieces: odd white space, text behind the last word, whole texts
        odd = np.flatnonzero(~plain)
        last = bounds[:-1].copy()
        last[rows] = ends
        tails = np.flatnonzero(last < bounds[1:])
        spans = [raw[a:b] for a, b in zip(begins[odd].tolist(), ends[odd].tolist())] + [raw[a:b] for a, b in zip(last[tails].tolist(), bounds[1:][tails].tolist())]
        missing = list(dict.fromkeys(x for x in spans if x not in self.others))
        if missing:
            p, n = self.keep(missing)
            self.others.update(zip(missing, zip(p.tolist(), n.tolist())))
        found = np.array([self.others[x] for x in spans], np.int64).reshape(-1, 2)
        place[odd], length[odd] = found[:len(odd)].T
        if len(self.others) > MOST_OTHERS:
            self.others = {}

        # each text: its words, its tail, the end id (at place 0)
        behind = np.searchsorted(rows, tails, side="right")
        place, length = np.insert(place, behind, found[len(odd):, 0]), np.insert(length, behind, found[len(odd):, 1])
        rows = np.insert(rows, behind, tails)
        behind = np.searchsorted(rows, np.arange(len(texts)), side="right")
        place, length = np.insert(place, behind, 0), np.insert(length, behind, 1)
        upto = np.concatenate([[0], np.cumsum(length)])
        counts = np.diff(upto[np.concatenate([[0], behind + np.arange(1, len(texts) + 1)])])
        return self.flat[np.arange(upto[-1]) + np.repeat(place - upto[:-1], length)], counts


_encoders: dict[tuple, Encoder] = {}


def encoder_of(path: str, end_id: int, slots: int) -> Encoder:
    """The worker's encoder; later tasks of the same process know its pieces."""
    key = path, end_id, slots
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


class SequenceWriter:
    """Cuts a stream of ids into equal sequences and writes them in batches."""

    def __init__(self, sink, seq_len: int, dtype):
        ids = pa.uint16() if dtype == np.uint16 else pa.uint32()
        self.schema = pa.schema([("ids", pa.list_(ids, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])
        self.file = pa.ipc.new_file(sink, self.schema)
        self.seq_len, self.room = seq_len, seq_len * BATCH
        self.buffer, self.filled, self.total = np.zeros(self.room, dtype), 0, 0

    def add(self, ids: np.ndarray) -> None:
        self.total += len(ids)
        while len(ids):
            n = min(len(ids), self.room - self.filled)
            self.buffer[self.filled:self.filled + n] = ids[:n]
            self.filled += n
            ids = ids[n:]
            if self.filled == self.room:
                self.flush()

    def flush(self) -> None:
        n = -(-self.filled // self.seq_len) * self.seq_len
        if n:
            ids = self.buffer[:n].copy()
            ids[self.filled:] = 0
            mask = np.arange(n) < self.filled
            arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.seq_len) for x in (ids, mask)]
            self.file.write_batch(pa.RecordBatch.from_arrays(
                [a.cast(f.type) for a, f in zip(arrays, self.schema)], schema=self.schema))
        self.filled = 0

    def close(self) -> None:
        self.flush()
        self.file.close()


FILES = "part long, path string, n_docs long, n_tokens long"


def write_token_files(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                      seq_len: int = SEQ_LEN, end_id: int = 0, out: str | None = None, remember: int = REMEMBER) -> DataFrame:
    """Writes the files and returns the table of them (part, path, n_docs, n_tokens).

    ``part`` numbers the files in ascending id order.  ``remember`` trades a
    worker's memory for time: words that it keeps the ids of.
    """
    spark = docs.sparkSession
    out = out or shared_output_dir(spark, "tokens")
    id_type = {"int": pa.int32(), "bigint": pa.int64()}.get(dict(docs.dtypes)[id_col], pa.string())

    @releasing
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = encoder = None
        n_docs = 0
        for batch in batches:
            if not len(batch):
                continue
            if writer is None:
                fs, folder = task_filesystem(out)
                fs.create_dir(folder, recursive=True)
                part = TaskContext.get().partitionId()
                name = f"tokens-{part:06d}-{uuid.uuid4().hex}.arrow"
                encoder = encoder_of(tokenizer, end_id, remember)
                sink = fs.open_output_stream(f"{folder}/{name}")
                writer = SequenceWriter(sink, seq_len, encoder.dtype)
                side = fs.open_output_stream(f"{folder}/{name}.docs")
                places = pa.ipc.new_file(side, places_schema(id_type))
            for piece in slices(batch, most=TEXT_BYTES):
                ids, counts = encoder.encode(piece.column("text"))
                first = writer.total + np.cumsum(counts) - counts
                writer.add(ids)
                places.write_batch(pa.RecordBatch.from_arrays(
                    [piece.column("doc_id").cast(id_type), pa.array(first, pa.int64()), pa.array(counts, pa.int64())], schema=places_schema(id_type)))
            n_docs += len(batch)
        if writer is not None:
            writer.close()
            places.close()
            sink.close()
            side.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "path": [f"{out}/{name}"],
                                              "n_docs": pa.array([n_docs], pa.int64()), "n_tokens": pa.array([writer.total], pa.int64())})

    rows = texts_of(docs).select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    return write_table(rows.mapInArrow(write, FILES), "token_files")


def places_schema(id_type: pa.DataType) -> pa.Schema:
    return pa.schema([("doc_id", id_type), ("first", pa.int64()), ("n_tokens", pa.int64())])


class TokenFile:
    """Random access to the sequences of a written file."""

    def __init__(self, path: str):
        fs, where = task_filesystem(path)
        self.reader = pa.ipc.open_file(fs.open_input_file(where))
        batches = self.reader.num_record_batches
        self.n = (batches - 1) * BATCH + len(self.reader.get_batch(batches - 1)) if batches else 0

    def __len__(self) -> int:
        return self.n

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of sequence ``i``, both views of the memory map (the mask has a bit an id)."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        batch = self.reader.get_batch(i // BATCH)
        ids, mask = batch.column("ids")[i % BATCH].values, batch.column("mask")[i % BATCH].values
        return ids.to_numpy(zero_copy_only=True), mask

    def streams(self) -> Iterator[np.ndarray]:
        """The unmasked ids, batch by batch, without copies."""
        for k in range(self.reader.num_record_batches):
            batch = self.reader.get_batch(k)
            ids = batch.column("ids").flatten().to_numpy(zero_copy_only=True)
            yield ids[:batch.column("mask").flatten().true_count]


def document_checksums(path: str, places: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, first, n_tokens, ids_crc32) of the documents of one file."""
    stream = TokenFile(path).streams()
    held, at = np.zeros(0, np.uint32), 0
    for batch in places:
        sums = []
        for need in batch.column("n_tokens").to_pylist():
            crc = 0
            while need:
                if at == len(held):
                    held, at = next(stream).astype("<u4"), 0
                n = min(need, len(held) - at)
                crc = zlib.crc32(held[at:at + n], crc)
                at, need = at + n, need - n
            sums.append(crc)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.int64())], names=[*batch.schema.names, "ids_crc32"])


def read_token_files(spark: SparkSession, files: DataFrame, id_type: str = "bigint") -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, path.

    ``start`` counts the ids of all files before by a window over the table of
    files (one row per file).
    """
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = write_table(files.select("part", "path", before.alias("base")), "token_bases")

    @releasing
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                fs, where = task_filesystem(path + ".docs")
                reader = pa.ipc.open_file(fs.open_input_file(where))
                places = (reader.get_batch(k) for k in range(reader.num_record_batches))
                for out in document_checksums(path, places):
                    start = pc.add(out.column("first"), pa.scalar(base, pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [out.column("doc_id"), start, out.column("n_tokens"), out.column("ids_crc32"), pa.array([path] * len(out))],
                        names=["doc_id", "start", "n_tokens", "ids_crc32", "path"])

    n = max(1, files.count())
    return files.repartition(n, "path").mapInArrow(look, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long, path string")


def token_output(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Writes the token files and describes every document as read back from them."""
    kind = dict(docs.dtypes)[id_col]
    files = write_token_files(docs, tokenizer, id_col, text_col, **how)
    return read_token_files(docs.sparkSession, files, kind if kind in ("int", "bigint") else "string")
