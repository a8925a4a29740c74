import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quadrille.llm import token_output as to
from quadrille.llm import warc
from quadrille.llm.jaccard_join import jaccard_join
from tests.llm.conftest import MESSY, frame

BPE = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "\n", "a", " a", "a ", "a  b", "a \n b", "a\n \nb", "don't stop", "we're, it's 'quoted'", "x  y", "\x1c! \x1c!", "\t\tTab. Two!?",
       "naïve café", "1,234.5 and 6", "<|endoftext|> end", "word...more", "a_b _c_ d", "emoji 😀 end", " \r\n  x", "“q” – z", "%%% ***", "a b c", "中文 字符 。"]


@pytest.mark.parametrize("slots", [to.REMEMBER, 8])  # all remembered; nearly all forgotten
def test_pieces_encode_as_the_whole(monkeypatch, slots):
    monkeypatch.setattr(to, "MOST_OTHERS", min(slots, to.MOST_OTHERS))
    plain, mine = Tokenizer.from_file(BPE), to.Encoder(BPE, 0, slots)
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice(["a", "B", "é", "7", " ", "  ", "\n", "\t", "'", "'s", ".", ",", "_", " ", "\x1c", "-", '"', "%", "ß", "中"]) for _ in range(rng.randint(1, 60)))
                   for _ in range(3000)]
    for at in range(0, len(texts), 200):
        ids, counts = mine.encode(pa.array(texts[at:at + 200]))
        ends = np.cumsum(counts)
        for text, end, n in zip(texts[at:], ends, counts):
            want = plain.encode(text, add_special_tokens=False).ids + [0]
            assert ids[end - n:end].tolist() == want, repr(text)


def test_token_files_round_trip(spark, documents, prose):
    rows = MESSY + [(100 - i, t) for i, t in enumerate(ODD)] + [(200 + i, prose(50 * i)) for i in range(20)]
    docs = documents(rows).repartition(5)
    got = sorted(to.token_output(docs, BPE, seq_len=128).drop("path").collect(), key=lambda r: r["start"])
    plain, start, seen = Tokenizer.from_file(BPE), 0, []
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(plain.encode(t or "", add_special_tokens=False).ids + [0])
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
        seen.append(r["doc_id"])
        sums = [(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in want[r["doc_id"]]]
        assert (r["n_tokens"], r["ids_crc32"]) in sums
    assert seen == sorted((r[0] for r in rows if r[0] is not None)) + [None]


def test_sequences_are_read_in_place(spark, documents, prose):
    rows = [(i, prose(90)) for i in range(30)]
    files = to.write_token_files(documents(rows).coalesce(1), BPE, seq_len=64).collect()
    plain = Tokenizer.from_file(BPE)
    for f in files:
        tokens = to.TokenFile(f["path"])
        ids = [(i, m.to_numpy(zero_copy_only=False)) for i, m in map(tokens.sequence, range(len(tokens)))]
        assert all(len(a) == 64 and a.dtype == np.uint16 and not a.flags.owndata for a, _ in ids)
        stream = np.concatenate([a[m] for a, m in ids])
        assert len(stream) == f["n_tokens"]
        assert [len(tokens)] == [-(-f["n_tokens"] // 64)]
    total = sum(f["n_tokens"] for f in files)
    assert total == sum(len(plain.encode(t, add_special_tokens=False).ids) + 1 for _, t in rows)


def test_token_files_of_nothing(spark, documents):
    assert to.token_output(documents([]), BPE).count() == 0


def pages(spark, rows):
    return frame(spark, rows, ["page_id", "url", "html"], ["long", "string", "string"])


def test_revisits_match_brute_force(spark, prose):
    rows = [(i, f"http://h/{i}", h) for i, h in enumerate([None, "", "<p>é</p>", "<p>é</p>", "x", "<p>é</p>", "x" * 200_000, "x" * 200_000])]
    rows += [(50, None, "no url"), (51, "http://a\r\nb c", "no url"), (None, "http://n", "null id"), (60, "http://r", "twice"), (60, "http://r", "twice")]
    rows += [(100 + i, "u", "hot") for i in range(150)] + [(None, "http://n", "hot")]
    archives = warc.deduplicate(warc.records_of(pages(spark, rows)))
    got = warc.read_archives(spark, archives, payloads=True).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in rows:
        x, keep = (h or "").encode(), first.get(h or "")
        kind = "response" if i == keep else "revisit"
        want.append((i, len(x), base64.b32encode(hashlib.sha1(x).digest()).decode(), kind, keep if kind == "revisit" else None))
    assert sorted([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got], key=repr) == sorted(want, key=repr)
    html = {i: (h or "").encode() for i, _, h in rows}
    assert all(bytes(r["payload"]) == html[r["page_id"]] for r in got if r["record_type"] == "response" and r["page_id"] is not None)
    assert {r["url"] for r in got if r["page_id"] == 51} == {"http://a%0D%0Ab%20c"}


def test_small_payloads_are_left_alone(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")]
    got = warc.read_archives(spark, warc.deduplicate(warc.records_of(pages(spark, rows)), min_bytes=3)).collect()
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in got} == {(1, "response", None), (2, "response", None), (3, "response", None), (4, "revisit", 3)}


def test_records_of_archives_resolve_again(spark):
    """Revisits read from archives find their original by digest, or stay open."""
    records = warc.records_of(pages(spark, [(5, "u", "body"), (7, "u", "other")]))
    old = records.where("page_id = 5").withColumns({"page_id": F.lit(2).cast("long"), "record_type": F.lit("revisit")})
    lost = records.where("page_id = 7").withColumns({"page_id": F.lit(9).cast("long"), "record_type": F.lit("revisit"), "payload_digest": F.lit("GONE")})
    decided = warc.resolve_revisits(records.unionByName(old).unionByName(lost)).collect()
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in decided} == {
        (5, "response", None), (2, "revisit", 5), (7, "response", None), (9, "revisit", None)}


def test_no_pages(spark):
    assert warc.read_archives(spark, warc.deduplicate(warc.records_of(pages(spark, [])))).count() == 0


def swapped(n, a, b):
    """Strings of 2**n letters that a polynomial hash modulo 2**64 cannot tell apart (a and b swapped)."""
    out = a
    for _ in range(n):
        out += "".join(b if c == a else a for c in out)
    return out


@pytest.mark.parametrize("letters", [10, 5])
def test_words_that_hash_alike_modulo_a_power_of_two(spark, documents, letters):
    one, two = swapped(letters, "a", "b"), swapped(letters, "b", "a")
    rows = [(1, f"z {one} q"), (2, f"z {two} q"), (3, f"z {one} q {two} q")]
    got = {r["doc_id"]: r for r in to.token_output(documents(rows), BPE).collect()}
    tokenizer = Tokenizer.from_file(BPE)
    for i, text in rows:
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert got[i]["ids_crc32"] == zlib.crc32(ids) and got[i]["n_tokens"] == len(ids)
    joined = {r["doc_id"]: r["component_id"] for r in jaccard_join(documents(rows[:2])).collect()}
    assert joined == {1: 1, 2: 2}


def test_encoder_tells_words_of_one_hash_apart(monkeypatch):
    from quadrille.llm import textkit
    monkeypatch.setattr(textkit, "hash_spans", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    encoder, tokenizer = to.Encoder(BPE, 0, 64), Tokenizer.from_file(BPE)
    texts = ["z one two three two one", "a three one four", "z two", "é één " + "x" * 64 + " " + "x" * 65 + " q"]
    for _ in range(2):
        ids, _ = encoder.encode(pa.array(texts))
        assert ids.tolist() == [i for t in texts for i in [*tokenizer.encode(t, add_special_tokens=False).ids, 0]]


def test_file_table_counts_documents(spark, documents, prose):
    rows = [(i, prose(5)) for i in range(50)]
    files = to.write_token_files(documents(rows), BPE)
    assert sum(r["n_docs"] for r in files.collect()) == 50
