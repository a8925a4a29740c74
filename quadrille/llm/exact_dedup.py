"""Exact dedup by composable polynomial fingerprints.

A text is its bytes after every run of white space became one space.  Its
fingerprint is a polynomial of the bytes modulo two primes.  Texts longer than
one part are cut into parts that any task can hash; a part's hash shifted by
the number of bytes behind it adds up to the hash of the whole.  Texts of equal
fingerprint and length are then compared chunk by chunk: per chunk position the
smallest and the largest bytes of the group must agree (an aggregate with a
map-side half, so a group of any size moves one chunk per task).  Groups that
disagree are split by their full SHA-256.

Null texts count as empty; all empty texts are equal.  Of equal texts the one
with the smallest id stays (null ids only if no other).  Rows that repeat both
the id and the text of the one that stays are the same document and stay.
Extra columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import SPACES, text_or_empty, texts_of, write_table
from quadrille.llm.textkit import releasing

PRIMES = (2147483647, 2147483629)  # the two largest primes below 2**31
SENT = 1_000_000  # rows of four numbers that may be broadcast (about 100 MB as a hash table)
BASES = (1103515245, 1566083941)
PART = 1 << 16  # bytes hashed as one part
CHUNK = 1 << 14  # bytes compared at a time

_tables: dict[int, np.ndarray] = {}


def _powers(which: int) -> np.ndarray:
    """BASE**0 .. BASE**PART modulo the prime."""
    if which not in _tables:
        p, b = PRIMES[which], BASES[which]
        out = np.ones(1, np.uint64)
        while len(out) <= PART:  # doubling: the second half is the first, shifted
            out = np.concatenate([out, out * np.uint64(pow(b, len(out), p)) % np.uint64(p)])
        _tables[which] = out
    return _tables[which]


def part_hashes(data: np.ndarray, offsets: np.ndarray, which: int) -> np.ndarray:
    """Hash of each part of at most PART bytes in a concatenated buffer."""
    p = np.uint64(PRIMES[which])
    lengths = np.diff(offsets)
    out = np.zeros(len(lengths), np.uint64)
    some = np.flatnonzero(lengths)
    step = max(1, (1 << 20) // PART)
    powers = _powers(which)
    for lo in range(0, len(some), step):
        r = some[lo:lo + step]
        left, right = offsets[r[0]], offsets[r[-1] + 1]
        ends = np.repeat(offsets[r + 1], lengths[r])
        value = (data[left:right].astype(np.uint64) + np.uint64(1)) * powers[ends - 1 - np.arange(left, right)]
        out[r] = np.add.reduceat(value, offsets[r] - left) % p
    return out


@releasing
def fingerprint_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds f1, f2: each part's hash shifted by the bytes behind it."""
    for batch in batches:
        column = batch.column("part").cast(pa.large_binary())
        _, offs, raw = column.buffers()
        out = []
        if len(column):
            offsets = np.frombuffer(offs, np.int64)[column.offset:column.offset + len(column) + 1]
            data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
            behind = batch.column("behind").to_numpy(zero_copy_only=False)
            for which, p in enumerate(PRIMES):
                h = part_hashes(data, offsets, which)
                for r in np.flatnonzero(behind):
                    h[r] = int(h[r]) * pow(BASES[which], int(behind[r]), p) % p
                out.append(pa.array(h.astype(np.int64)))
        else:
            out = [pa.array([], pa.int64())] * 2
        keep = [n for n in batch.schema.names if n not in ("part", "behind")]
        yield pa.RecordBatch.from_arrays([batch.column(n) for n in keep] + out, names=keep + ["f1", "f2"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part: int = PART) -> DataFrame:
    """One row per document: doc_id, text_sha256, n_bytes, f1, f2."""
    if part > PART:
        raise ValueError(f"part must be at most {PART}")
    norm = F.regexp_replace(text_or_empty(text_col), SPACES, " ")
    rows = (texts_of(docs).select(F.col(id_col).alias("doc_id"), norm.cast("binary").alias("norm"))
            .select("doc_id", "norm", F.sha2("norm", 256).alias("text_sha256"),
                    F.octet_length("norm").cast("long").alias("n_bytes")))
    small = (rows.where(F.col("n_bytes") <= part)
             .select("doc_id", "text_sha256", "n_bytes", F.lit(0).cast("long").alias("behind"), F.col("norm").alias("part")))
    head = "doc_id " + dict(small.dtypes)["doc_id"] + ", text_sha256 string, n_bytes long"
    small = small.mapInArrow(fingerprint_parts, head + ", f1 long, f2 long")
    # long texts: every part is a row of its own, dealt out over all tasks
    last = F.floor((F.col("n_bytes") - 1) / part)
    cut = (rows.where(F.col("n_bytes") > part)
           .select("doc_id", "text_sha256", "n_bytes", "norm", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("i"))
           .select("doc_id", "text_sha256", "n_bytes", "i",
                   F.greatest(F.col("n_bytes") - (F.col("i") + 1) * part, F.lit(0)).alias("behind"),
                   F.expr(f"substring(norm, int(i * {part} + 1), {part})").alias("part"))
           .repartition("doc_id", "text_sha256", "i"))
    cut = cut.mapInArrow(fingerprint_parts, head + ", i long, f1 long, f2 long")
    # a repeated row repeats its parts: one of each counts
    long = (cut.groupBy("doc_id", "text_sha256", "n_bytes", "i").agg(F.max("f1").alias("f1"), F.max("f2").alias("f2"), F.count("*").alias("n"))
            .groupBy("doc_id", "text_sha256", "n_bytes").agg((F.sum("f1") % PRIMES[0]).alias("f1"), (F.sum("f2") % PRIMES[1]).alias("f2"), F.max("n").alias("n"))
            .withColumn("n", F.explode(F.expr("sequence(1, int(n))"))).drop("n"))
    return small.unionByName(long)


def collided(docs: DataFrame, prints: DataFrame, id_col: str, text_col: str, chunk: int) -> DataFrame:
    """Fingerprints whose texts differ somewhere, found by comparing chunks."""
    key = ["f1", "f2", "n_bytes"]
    several = write_table(prints.groupBy(*key).count().where("count > 1").drop("count"), "fingerprint_groups")
    p, s = prints.alias("p"), several.alias("s")

    def mark(own: str, sha: str):
        return F.xxhash64(F.col(own).isNull(), own, sha)

    # a mark met by chance only adds a text to a comparison that then fails and falls back to SHA-256
    members = p.join(s, [F.col(f"p.{k}") == F.col(f"s.{k}") for k in key], "left_semi")
    members = write_table(members.select(mark("doc_id", "text_sha256").alias("m"), *key).distinct(), "fingerprint_members")
    if members.count() <= SENT:  # else texts and marks are exchanged
        members = F.broadcast(members)
    norm = F.regexp_replace(text_or_empty(text_col), SPACES, " ").cast("binary")
    texts = docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm")).withColumn("sha", F.sha2("norm", 256))
    both = texts.select("norm", mark("doc_id", "sha").alias("mark")).join(members, F.col("mark") == F.col("m"))
    last = F.floor(F.greatest(F.col("n_bytes") - 1, F.lit(0)) / chunk)
    pieces = both.select(*key, "norm", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("i")).select(
        *key, "i", F.expr(f"substring(norm, int(i * {chunk} + 1), {chunk})").alias("piece"))
    return (pieces.groupBy(*key, "i").agg(F.min("piece").alias("low"), F.max("piece").alias("high"))
            .where(F.col("low") != F.col("high")).select(*key).distinct())


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part: int = PART, chunk: int = CHUNK) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_bytes."""
    prints = write_table(fingerprints(docs, id_col, text_col, part), "fingerprints")
    bad = write_table(collided(docs, prints, id_col, text_col, chunk), "collisions")
    key = ["f1", "f2", "n_bytes"]
    # splits a collided fingerprint by content; elsewhere a constant
    prints = write_table(prints.join(bad.withColumn("bad", F.lit(True)), key, "left").select(
        "doc_id", "text_sha256", *key, F.when(F.col("bad"), F.col("text_sha256")).otherwise("").alias("sub")), "split_prints")
    groups = write_table(prints.groupBy(*key, "sub").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "equal_texts")
    return prints.join(groups, [*key, "sub"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "n_bytes")
