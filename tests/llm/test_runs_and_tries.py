import hashlib
import random
import re
import zlib
from fractions import Fraction

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from quadrille.llm import conversation_trie as ct
from quadrille.llm import periodic_runs as pr
from quadrille.llm import queries as Q
from quadrille.llm import token_counts as tc
from tests.llm.conftest import CLASH, MESSY, frame

MODEL = public_tokenizers.path("piece_bpe_32k.model")


# periodic runs

def brute_runs(words):
    out = []
    for p in range(1, len(words) // 4 + 1):
        i = 0
        while i + p < len(words):
            if words[i] != words[i + p]:
                i += 1
                continue
            start = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            length = i - start + p
            run = words[start:start + length]
            if length >= max(6, 4 * p) and not any(all(run[j] == run[j + q] for j in range(length - q)) for q in range(1, p)):
                out.append((start, length, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def stuttering(rng):
    words = []
    for _ in range(rng.randint(0, 5)):
        if rng.random() < 0.6:
            unit = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
            words += (unit * 9)[:rng.randint(1, 8 * len(unit))]
        else:
            words += [rng.choice("abcdé") for _ in range(rng.randint(0, 6))]
    return words


def test_runs_by_brute_force():
    rng = random.Random(11)
    for _ in range(400):
        docs = [stuttering(rng) for _ in range(rng.randint(1, 4))]
        runs, own, words, first = pr.runs_of(pa.array([" ".join(d) if d else None for d in docs]))
        got = [[tuple(r) for r, o in zip(runs.tolist(), own) if o == k] for k in range(len(docs))]
        assert got == [brute_runs(d) for d in docs]
        assert pr.collapse(runs, own, words, first).to_pylist() == [collapsed(d, brute_runs(d)) for d in docs]


def test_wavelet_tree():
    rng = random.Random(2)
    import numpy as np
    values = np.array(rng.sample(range(100), 100))
    tree = pr.WaveletTree(values)
    for _ in range(100):
        a, b = sorted(rng.sample(range(101), 2))
        x = rng.randint(0, 99)
        k = rng.randrange(b - a)
        assert tree.smaller(np.array([a]), np.array([b]), np.array([x]))[0] == (values[a:b] < x).sum()
        assert tree.nth(np.array([a]), np.array([b]), np.array([k]))[0] == sorted(values[a:b])[k]


def test_runs_of_messy_rows(spark, documents):
    long_run = "go round " * 30_000
    rows = MESSY + [(8, long_run), (8, long_run), (9, "x y z"), (10, "a a a a a a"), (11, "a a a a a"), (12, "no " + "la\tla la la " * 2)]
    got = pr.periodic_runs(documents(rows)).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert [tuple(x) for x in by_id[8]["runs"]] == [(0, 60_000, 2)] and by_id[8]["collapsed"] == "go round"
    assert [tuple(x) for x in by_id[10]["runs"]] == [(0, 6, 1)] and by_id[10]["collapsed"] == "a"
    assert by_id[11]["runs"] == [] and by_id[1]["runs"] == [] and by_id[1]["collapsed"] == ""
    assert by_id[6]["collapsed"] == " ".join(re.findall(r"[^\x20\x09-\x0D]+", dict(MESSY)[6]))
    assert pr.periodic_runs(documents([])).collect() == []


def test_op11_by_brute_force(spark, tmp_out, documents):
    rng = random.Random(4)
    rows = [(i, " ".join(stuttering(rng)) if i % 17 else None) for i in range(120)] + [(None, "a a a a a a a"), (120, "one  two\n three " * 40)]
    documents(rows, clash=False).write.parquet(f"{tmp_out}/documents.parquet")

    def want(i, text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = brute_runs(words)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        return (i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(),
                hashlib.sha256(collapsed(words, runs).encode()).hexdigest())

    got = {tuple(r) for r in Q.op11_periodic_runs(spark, tmp_out).collect()}
    assert got == {want(*r) for r in rows}


# conversation trie

def brute_trie(seqs):
    members, nodes = {}, {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    for k, m in members.items():
        nodes[k] = {"conv": min(m), "n": len(m), "kids": 0, "leaves": 0, "saved": 0, "ends": sorted(c for c in m if len(seqs[c]) == len(k))}
    for k in nodes:
        if k:
            nodes[k[:-1]]["kids"] += 1
    for k, v in nodes.items():
        for d in range(len(k) + 1):
            nodes[k[:d]]["leaves"] += v["kids"] == 0
            nodes[k[:d]]["saved"] += (v["n"] - 1) * len(k[-1][1].encode()) if k else 0
    return sorted(((v["conv"], len(k), nodes[k[:-1]]["conv"] if k else None, v["n"], v["kids"], v["leaves"], v["saved"],
                    hashlib.sha256(",".join(map(str, v["ends"])).encode()).hexdigest()) for k, v in nodes.items()), key=repr)


def conversations_of(rng, n):
    """Conversations with shared openings, copies, null and empty turns."""
    convs = {}
    for c in range(n):
        if rng.random() < 0.1:
            continue
        s = list(rng.choice(list(convs.values())))[:rng.randint(1, 14)] if convs and rng.random() < 0.5 else []
        s = s + [(rng.choice(["u", "a", None]), rng.choice(["x", "yy", "é", "", None])) for _ in range(rng.randint(0, 6))]
        if s:
            convs[c] = s
    return convs


def turns_of(spark, convs, rng, extra=(), clash=True):
    rows = [(c, i if i else rng.choice([None, 0]), r, t) for c, s in convs.items() for i, (r, t) in enumerate(s)] + list(extra)
    rng.shuffle(rows)
    names = ["conv_id", "turn", "role", "text"]
    return frame(spark, rows, names, ["long", "long", "string", "string"], clash).repartition(3)


def plain(convs):
    return {c: [(r or "", t or "") for r, t in s] for c, s in convs.items()}


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed,width,cells", [(1, 512, 1 << 19), (2, 512, 40), (3, 3, 30), (4, 2, 1000), (5, 4, 12), (6, 1, 7)])
def test_trie_by_brute_force(spark, seed, width, cells):
    rng = random.Random(seed)
    convs = conversations_of(rng, 50)
    turns = turns_of(spark, convs, rng, extra=[(None, 0, "u", "no conversation")])
    assert table(ct.conversation_trie(turns, width, cells)) == brute_trie(plain(convs))


def test_trie_of_many_copies(spark):
    """A third of all conversations are one text, over many blocks; another third ends inside it."""
    convs = {c: [("u", "same"), ("a", "é")][:1 + c % 3 % 2] for c in range(3000)}
    turns = turns_of(spark, convs, random.Random(1))
    assert table(ct.conversation_trie(turns, cells=100)) == brute_trie(convs)


def test_trie_of_a_very_long_conversation(spark):
    convs = {7: [("u", f"turn {i}") for i in range(300)], 3: [("u", f"turn {i}") for i in range(20)], 9: [("u", "turn 0")]}
    turns = turns_of(spark, convs, random.Random(1))
    keys = ct.turn_keys(turns.repartition(5))
    want = brute_trie(convs)
    assert table(ct.trie_of(keys, width=16, cells=64)) == want


def test_trie_of_no_rows(spark):
    empty = frame(spark, [], ["conv_id", "turn", "role", "text"], ["long", "long", "string", "string"])
    assert ct.conversation_trie(empty).collect() == []


def test_positions_over_partitions(spark):
    convs = {c: [("u", f"{c} {i}") for i in range(1 + 900 * (c == 4))] for c in range(9)}
    keys = ct.turn_keys(turns_of(spark, convs, random.Random(3)))
    got = keys.groupBy("conv_id").agg(F.sort_array(F.collect_list("pos")).alias("p")).collect()
    assert {r["conv_id"]: r["p"] for r in got} == {c: list(range(len(s))) for c, s in convs.items()}


def test_op12_by_brute_force(spark, tmp_out):
    rng = random.Random(8)
    convs = conversations_of(rng, 60)
    turns_of(spark, convs, rng, clash=False).write.parquet(f"{tmp_out}/conversations.parquet")
    whole = plain(convs)
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in whole}
    want = brute_trie({c: whole.get(c - c % 5, [])[:h[c]] + s[h[c]:] for c, s in whole.items()})
    assert table(Q.op12_conversation_trie(spark, tmp_out)) == want


# token counts

ODD = ["", " ", "  ", "\n", "a\nb", " a", "▁", "a▁ b", "a ▁b", "▁▁a  ▁", "<s> hi </s><unk>", "x\x00y", "ﬁ é ｆ", "日本語 テキスト", "\r\n\t x", "　x y", "\n\n \n a", "A" * 20_000, "🙂 ok"]


@pytest.mark.parametrize("head", [1 << 20, 5, 0])
def test_token_counts_by_the_tokenizer(spark, documents, prose, head):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = MESSY + [(100 + i, t) for i, t in enumerate(ODD)] + [(200 + i, prose(i)) for i in range(0, 300, 7)]
    got = tc.token_counts(documents(rows), MODEL, limit=100, head_rows=head).collect()
    want = [(i, len((t or "").encode()), len(model.encode(t or ""))) for i, t in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(((*w, w[2] > 100) for w in want), key=repr)


def test_pretokens_are_cut_where_no_piece_spans():
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    single = tc.alone(MODEL)
    rng = random.Random(6)
    texts = ["".join(rng.choice(" \n\t▁aeé<0x0A>日the") for _ in range(rng.randint(0, 30))) for _ in range(500)]
    found, row, singles = tc.pretokens(pa.array(texts), single)
    counts = singles.copy()
    for r, n in zip(row, tc.count_pieces(found.to_pylist(), MODEL)):
        counts[r] += n
    assert counts.tolist() == [len(model.encode(t)) for t in texts]


def test_token_counts_of_no_rows(spark, documents):
    assert tc.token_counts(documents([]), MODEL).collect() == []
    assert "row" not in CLASH or tc.token_counts(documents([(1, "a")]), MODEL).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
