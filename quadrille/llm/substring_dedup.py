"""Substring dedup by hashing lines and the sentences of lines.

A text is cut at line feeds, and lines after each full stop followed by a space,
so that a passage set inside a line is met as well.  A unit is lower-cased, its
white space becomes single spaces, and a closing full stop goes; units of fewer
than ``min_words`` words are left alone.  Digests (128 bits) are grouped over
all documents.  Of equal units the occurrence with the smallest id, then the
smallest start, is kept; the others are removed, and their code point offsets
in the original text are reported.

With ``units="passages"`` the least number of words holds for passages instead:
runs of consecutive sentences, over line ends as well, that just reach it to
either side of each sentence, and whole paragraphs (between blank lines).  A
repeated line, paragraph or passage of whole sentences then goes with all its
short sentences.  This is what the registered query does; SQL states both.

Digests meet in an aggregate with a map-side half, and the join back is of two
exchanged sides, so that Spark can split a digest that a third of the rows share.

Null texts count as empty.  A null id comes last.  Rows with equal ids count as
one document: each keeps its own first occurrence.  Extra columns are ignored by
:func:`repeated_units` and kept by :func:`cut_repeats`.  An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.common import text_or_empty, texts_of, write_table
from quadrille.llm.textkit import releasing

MIN_WORDS = 8
ROWS = 1 << 16  # units handed to Spark at a time


def units_of(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, unit) of every unit; separators belong to none."""
    at = 0
    for line in text.split("\n"):
        here = at
        for piece in line.split(". "):
            yield here, here + len(piece), piece
            here += len(piece) + 2
        at += len(line) + 1


def normalise(unit: str) -> list[str]:
    """Words of the normalised unit."""
    return unit.lower().removesuffix(".").split()


def passages_of(text: str, least: int) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, words) by start: the shortest runs of sentences of ``least`` words from and up to each, and paragraphs of as many."""
    pieces, total, own, at, paragraph = [], [0], [], 0, 0
    for line in text.split("\n"):
        here = at
        if not line.strip():
            paragraph += 1
        for piece in line.split(". "):
            words = normalise(piece)
            if words:
                pieces.append((here, here + len(piece), words))
                total.append(total[-1] + len(words))
                own.append(paragraph)
            here += len(piece) + 2
        at += len(line) + 1
    runs, n, j = set(), len(pieces), 0
    for i in range(n):
        j = max(i, j)
        while j < n and total[j + 1] - total[i] < least:
            j += 1
        if j == n:
            break
        runs.add((i, j))
    i = 0
    for j in range(n):
        while i < j and total[j + 1] - total[i + 1] >= least:
            i += 1
        if total[j + 1] - total[i] >= least:
            runs.add((i, j))
    first = 0
    for j in range(n):
        if j + 1 == n or own[j + 1] != own[j]:
            if total[j + 1] - total[first] >= least:
                runs.add((first, j))
            first = j + 1
    for i, j in sorted(runs):
        yield pieces[i][0], pieces[j][1], [w for _, _, words in pieces[i:j + 1] for w in words]


def sentences_of(text: str, least: int) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, words) of the units of at least ``least`` words."""
    for start, end, unit in units_of(text):
        words = normalise(unit)
        if len(words) >= least:
            yield start, end, words


KINDS = {"sentences": sentences_of, "passages": passages_of}

UNITS = pa.schema([("mark", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("words", pa.int64()),
                   ("again", pa.bool_()), ("d1", pa.int64()), ("d2", pa.int64())])


def unit_rows(docs: DataFrame, id_col: str, text_col: str, min_words: int, units: str = "sentences") -> DataFrame:
    """Every unit: doc_id, mark, start, end, words, again (repeats one before it in its text), d1, d2."""
    rows = texts_of(docs).select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("mark", F.xxhash64("text"))
    kind, cut_text = dict(rows.dtypes)["doc_id"], KINDS[units]

    @releasing
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, which, out = batch.column("doc_id"), [], {n: [] for n in UNITS.names}

            def packed():
                return pa.RecordBatch.from_arrays([ids.take(pa.array(which, pa.int64()))] + [pa.array(out[f.name], f.type) for f in UNITS],
                                                  names=["doc_id", *UNITS.names])

            for r, (text, mark) in enumerate(zip(batch.column("text"), batch.column("mark").to_pylist())):
                seen = {}  # digest: end of its first unit; passages that overlap it are not cut from it
                for start, end, words in cut_text(text.as_py(), min_words):
                    digest = hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    again = start >= seen.setdefault(digest, end)
                    which.append(r)
                    for name, value in zip(UNITS.names, (mark, start, end, len(words), again, int.from_bytes(digest[:8], "little", signed=True),
                                                         int.from_bytes(digest[8:], "little", signed=True))):
                        out[name].append(value)
                    if len(which) == ROWS:
                        yield packed()
                        which, out = [], {n: [] for n in UNITS.names}
            if which:
                yield packed()

    return rows.mapInArrow(cut, f"doc_id {kind}, mark long, start long, end long, words long, again boolean, d1 long, d2 long")


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, units: str = "sentences") -> DataFrame:
    """One row per removed unit: doc_id, start, end, words, keep_doc_id, mark (hash of the text)."""
    every = write_table(unit_rows(docs, id_col, text_col, min_words, units), "units")
    groups = (every.groupBy("d1", "d2").agg(F.min("doc_id").alias("keep_doc_id"), F.count("*").alias("n")).where("n > 1")
              .select(F.col("d1").alias("g1"), F.col("d2").alias("g2"), "keep_doc_id"))
    groups = write_table(groups, "repeated_digests")
    met = every.join(groups, (every["d1"] == groups["g1"]) & (every["d2"] == groups["g2"]))
    removed = F.col("again") | ~F.col("doc_id").eqNullSafe(F.col("keep_doc_id"))
    return met.where(removed).select("doc_id", "start", "end", "words", "keep_doc_id", "mark")


def merged(removed: DataFrame) -> DataFrame:
    """doc_id, mark, start, end: spans that overlap made one."""
    upto = Window.partitionBy("doc_id", "mark").orderBy("start", "end")
    before = F.max("end").over(upto.rowsBetween(Window.unboundedPreceding, -1))
    opens = removed.select("doc_id", "mark", "start", "end", (F.col("start") >= F.coalesce(before, F.lit(-1))).cast("long").alias("opens"))
    return opens.withColumn("span", F.sum("opens").over(upto.rowsBetween(Window.unboundedPreceding, 0))).groupBy("doc_id", "mark", "span").agg(
        F.min("start").alias("start"), F.max("end").alias("end"))


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, units: str = "sentences") -> DataFrame:
    """``docs`` without the removed units; original offsets stay in ``removed``."""
    gone = merged(repeated_units(docs, id_col, text_col, min_words, units)).groupBy("doc_id", "mark").agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("removed"))
    gone = gone.withColumnsRenamed({"doc_id": "gone_id", "mark": "gone_mark"})
    names = [n for n in docs.columns if n != "removed"]
    text = F.col(text_col)
    joined = docs.select(*[F.col(f"`{n}`") for n in names]).withColumn("own_mark", F.xxhash64(text_or_empty(text_col)))
    joined = joined.join(gone, F.col(id_col).eqNullSafe(F.col("gone_id")) & (F.col("own_mark") == F.col("gone_mark")), "left")
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("removed", lambda r: r["end"]))
    starts = F.concat(F.transform("removed", lambda r: r["start"]), F.array(F.char_length(text).cast("long")))
    kept = F.array_join(F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")),
                                    lambda s: F.substring(text, (s["a"] + 1).cast("int"), (s["b"] - s["a"]).cast("int"))), "")
    cut = F.when(F.col("removed").isNull(), text).otherwise(kept)
    return joined.select(*[(cut if n == text_col else F.col(f"`{n}`")).alias(n) for n in names], F.coalesce("removed", empty).alias("removed"))
