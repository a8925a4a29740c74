"""Token counts by distinct pre-token.

A pre-token is a run of spaces with the characters behind it.  Where no piece of
the vocabulary holds a space behind another character, no merge crosses the start
of a pre-token, so a text has as many tokens as its pre-tokens have, and a
pre-token has the same number wherever it stands.  White space of one byte that no
longer piece holds (line feed and tab, as a rule) stands alone and is one token.
The cuts are proven from the model's own pieces; a model that allows none is refused.

1. Every task emits the pre-tokens of its texts with their frequency; an aggregate
   with a map-side half leaves each distinct one once.
2. The tokenizer runs once per distinct pre-token.
3. Every document's pre-token frequencies meet those counts: the frequent head of
   the vocabulary (at most ``HEAD_ROWS`` entries and ``HEAD_BYTES`` bytes, taken by
   doublings of frequency) is broadcast, so hot words are never exchanged; the rest
   is joined by an exchange.  Only sums per document remain: no ids are kept.

Null and empty texts have 0 tokens.  Repeated rows and null ids are rows of their
own.  Texts are cut in slices of about ``TEXT_BYTES``, a longer text is a slice of
its own.  Extra columns are ignored.  An empty table gives an empty result.  Rows
are told apart by their place in the scan: pass a table that reads alike each time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import text_or_empty, texts_of, write_table
from quadrille.llm.textkit import releasing, slices, text_buffer

LIMIT = 4096
HEAD_ROWS = 1 << 20
HEAD_BYTES = 1 << 25
TEXT_BYTES = 4 << 20
MARK = "▁"  # sentencepiece's sign for a space

_models: dict = {}


def model_of(path: str):
    """The worker's tokenizer."""
    if path not in _models:
        import sentencepiece
        _models[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _models[path]


def alone(path: str) -> np.ndarray:
    """The ASCII white space but the space that no longer piece holds; checks the cuts."""
    model = model_of(path)
    pieces = [model.id_to_piece(i) for i in range(model.vocab_size())
              if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    if any(MARK in p.lstrip(MARK) for p in pieces):
        raise ValueError("pieces of this model span pre-tokens")
    probe = " a  ﬁ A\n "
    if model.encode(probe) != model.encode(probe.replace(" ", MARK)) or model.decode(model.encode(probe)) != probe:
        raise ValueError("this model normalises texts")
    joined = {c for p in pieces if len(p) > 1 for c in p}
    bytes_ = [b for b in (9, 10, 11, 12, 13) if chr(b) not in joined]
    if 10 not in bytes_:
        raise ValueError("pieces of this model hold line feeds")
    return np.array(bytes_, np.uint8)


def pretokens(texts: pa.Array, single: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """``(pre-tokens, the row of each, single characters of each row)``.

    The model sets a space before a text that is not empty, and so do we.
    """
    texts = pc.replace_substring(pc.fill_null(texts, "").cast(pa.large_string()), MARK, " ")
    rows = len(texts)
    empty, blank = (pa.scalar(s, pa.large_string()) for s in ("", " "))
    filled = pc.if_else(pc.equal(pc.binary_length(texts), 0), empty, pc.binary_join_element_wise(blank, texts, empty))
    data, offsets = text_buffer(filled)
    n = len(data)
    if n == 0:
        return pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(rows, np.int64)
    table = np.zeros(256, bool)
    table[single] = True
    apart, space = table[data], data == 32
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    begin = first[:n].copy()
    begin[1:] |= (space[1:] & ~space[:-1]) | apart[:-1]
    begin &= ~apart
    upto = np.concatenate([[0], np.cumsum(apart)])
    starts = np.flatnonzero(begin)
    row = np.searchsorted(offsets, starts, side="right") - 1
    kept = data[~apart] if upto[-1] else data
    bounds = np.append(starts - upto[starts], len(kept)).astype(np.int64)
    found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(kept)))
    return found, row, np.diff(upto[offsets])


def count_pieces(batch: list[str], path: str) -> np.ndarray:
    """How many tokens each pre-token has.

    The line feed before it takes the space that the model sets before a text;
    both are a token of their own.
    """
    return np.array([len(ids) - 2 for ids in model_of(path).encode(["\n" + p for p in batch], num_threads=1)], np.int64)


def vocabulary(rows: DataFrame, path: str, single: np.ndarray) -> DataFrame:
    """(piece, weight, n): distinct pre-tokens, their frequency and their tokens."""

    @releasing
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=TEXT_BYTES):
                found, _, _ = pretokens(part.column("text"), single)
                if len(found):
                    counted = found.value_counts()
                    yield pa.RecordBatch.from_arrays([counted.field(0).cast(pa.string()), counted.field(1)], names=["piece", "weight"])

    @releasing
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "piece", TEXT_BYTES):
                n = count_pieces(part.column("piece").to_pylist(), path)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n)], names=["piece", "weight", "n"])

    pieces = rows.select("text").mapInArrow(emit, "piece string, weight long").groupBy("piece").agg(F.sum("weight").alias("weight"))
    return write_table(pieces.mapInArrow(count, "piece string, weight long, n long"), "pretokens")


def head_of(words: DataFrame, most_rows: int, most_bytes: int) -> tuple[int, bool]:
    """``(least weight of the head, whether anything is left)`` from a histogram of doublings."""
    level = F.floor(F.log2("weight")).cast("int").alias("level")
    seen = words.groupBy(level).agg(F.count("*").alias("n"), F.sum(F.octet_length("piece") + 16).alias("bytes")).collect()
    rows = size = 0
    least = 62
    for r in sorted(seen, key=lambda r: -r["level"]):
        rows, size = rows + r["n"], size + r["bytes"]
        if rows > most_rows or size > most_bytes:
            return 1 << least, True
        least = r["level"]
    return 1, False


def frequencies(rows: DataFrame, single: np.ndarray) -> DataFrame:
    """(row, id, n_bytes, piece, freq) per document and distinct pre-token.

    Every document has one more row without a piece: its single characters.
    """

    @releasing
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=TEXT_BYTES):
                found, row, singles = pretokens(part.column("text"), single)
                coded = found.dictionary_encode()
                words = max(1, len(coded.dictionary))
                pairs, freq = np.unique(row * words + coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
                row = np.concatenate([np.arange(len(part)), pairs // words])
                order = np.argsort(row, kind="stable")
                piece = pa.concat_arrays([pa.nulls(len(part), pa.large_string()), coded.dictionary.take(pa.array(pairs % words))])
                freq = np.concatenate([singles, freq])[order]
                own = part.select(["row", "id", "n_bytes"]).take(pa.array(row[order]))
                yield pa.RecordBatch.from_arrays([*own.columns, piece.take(pa.array(order)).cast(pa.string()), pa.array(freq.astype(np.int64))],
                                                 names=["row", "id", "n_bytes", "piece", "freq"])

    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(emit, f"row long, id {kind}, n_bytes long, piece string, freq long")


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT,
                 head_rows: int = HEAD_ROWS, head_bytes: int = HEAD_BYTES) -> DataFrame:
    """(``id_col``, n_bytes, n_tokens, over_limit) of every row of ``docs``."""
    text = text_or_empty(text_col)
    rows = texts_of(docs).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                                 F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    single = alone(model)
    words = vocabulary(rows, model, single)
    least, rest = head_of(words, head_rows, head_bytes)
    head = words.where(F.col("weight") >= least).select(F.col("piece").alias("known"), "n")
    met = frequencies(rows, single).join(F.broadcast(head), F.col("piece") == F.col("known"), "left")
    each = F.when(F.col("piece").isNull(), F.col("freq")).otherwise(F.col("freq") * F.col("n"))
    if rest:
        left = F.col("piece").isNotNull() & F.col("known").isNull()
        # a row a document for what is counted, under a key of its own, so that it spreads
        # over all tasks; the rows that are exchanged for their counts carry no more than they need
        key = F.when(left, F.col("piece")).otherwise(F.concat(F.lit("\n"), F.col("row").cast("string")))
        met = met.groupBy("row", key.alias("key"), *(F.when(~left, F.col(c)).alias(c) for c in ("id", "n_bytes"))).agg(
            F.sum(F.when(left, F.col("freq")).otherwise(each)).alias("freq"))
        tail = words.where(F.col("weight") < least).select(F.col("piece").alias("known"), F.col("n").cast("int").alias("n"))
        met = met.join(tail, F.col("key") == F.col("known"), "left")
        each = F.col("freq") * F.coalesce("n", F.lit(1))
        met = met.groupBy("row").agg(F.max("id").alias("id"), F.max("n_bytes").alias("n_bytes"), F.sum(each).alias("n_tokens"))
    else:
        met = met.groupBy("row", "id", "n_bytes").agg(F.sum(each).alias("n_tokens"))
    return met.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
