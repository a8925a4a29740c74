import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm import decontamination as dc
from quadrille.llm import jaccard_join as jj
from quadrille.llm import secret_scan as ss
from quadrille.llm import substring_dedup as sd
from quadrille.llm import textkit as tk
from quadrille.llm import toxicity as tox
from quadrille.llm import url_filters as uf
from tests.llm.conftest import MESSY, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- words and shingles

def test_words_match_the_pattern(prose):
    texts = ["", " ", "a", None, "É Éa\x0bB  c\r\n", "x\x1cy", "ab ab", prose(500), "Z" * 10, "long " * 400_000]
    words = tk.words_of(pa.array(texts))
    raw = words.data.tobytes()
    flat = [raw[a:b].decode() for a, b in zip(words.starts, words.ends)]
    want = [WORD.findall((t or "").translate(LOWER)) for t in texts]
    assert np.diff(words.row_first).tolist() == [len(w) for w in want]
    assert flat == [x for w in want for x in w]
    by_word = {}
    for word, h in zip(flat, words.hashes.tolist()):
        assert by_word.setdefault(word, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_slices_of_a_batch_see_their_own_rows(prose):
    batch = pa.RecordBatch.from_pydict({"text": [prose(20), None, "", prose(3), "end"]})
    whole = tk.words_of(batch.column("text")).hashes
    parts = np.concatenate([tk.words_of(p.column("text")).hashes for p in tk.slices(batch, most=40)])
    assert whole.tolist() == parts.tolist()


# ---- Jaccard join

def shingles(text, k=5):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1)))


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, (_, x)), (b, (_, y)) in itertools.combinations(enumerate(sets), 2):
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            root[top(a)] = top(b)
    ids = {}
    for n, (i, _) in enumerate(sets):
        if i is not None:
            ids[top(n)] = min(ids.get(top(n), i), i)
    return sorted([(i, len(s), ids.get(top(n))) for n, (i, s) in enumerate(sets)], key=repr)


def near_copies(prose, seed):
    """Families around the threshold, shared passages, copies and chance."""
    rng = random.Random(seed)
    passage, rows = prose(60), []
    for f in range(12):
        base = prose(rng.choice([4, 6, 30, 80, 200])).split()
        for _ in range(rng.choice([1, 2, 5, 30])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, len(base) // 40, len(base) // 20])):
                copy[rng.randrange(len(copy))] = prose(1)
            rows.append(" ".join(copy))
    rows += [prose(30) + " " + passage + " " + prose(rng.randint(5, 40)) for _ in range(40)]
    rows += [passage + " " + prose(rng.randint(1, 25)) for _ in range(25)]
    rng.shuffle(rows)
    return MESSY + [(100 + i, t) for i, t in enumerate(rows)] + [(5000, rows[0].upper()), (5001, None)]


@pytest.mark.parametrize("seed,sent", [(1, jj.SENT), (2, 0)])  # survivors broadcast, or exchanged
def test_components_match_all_pairs(spark, documents, prose, monkeypatch, seed, sent):
    monkeypatch.setattr(jj, "TILE", 3)  # many tiles even here
    monkeypatch.setattr(jj, "SENT", sent)
    rows = near_copies(prose, seed)
    got = jj.jaccard_join(documents(rows).repartition(4)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_components(rows)


def test_jaccard_join_of_nothing(spark, documents):
    assert jj.jaccard_join(documents([])).count() == 0
    assert [tuple(r) for r in jj.jaccard_join(documents([(3, ""), (4, "")])).collect()] == [(3, 0, 3), (4, 0, 4)]


# ---- decontamination

def slow_alignment(item, passage):
    best, h = 0, [[0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(passage, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (dc.MATCH if a == b else dc.MISMATCH), h[i - 1][j] + dc.GAP, h[i][j - 1] + dc.GAP)
            best = max(best, h[i][j])
    return best


def test_alignment_matches_the_table():
    rng = random.Random(2)
    for _ in range(300):
        item, passage = ([rng.randint(0, 4) for _ in range(rng.randint(1, 14))] for _ in range(2))
        score, start, end = dc.align(np.array(item), np.array(passage))
        assert score == slow_alignment(item, passage)
        if score:  # the reported span alone scores as much
            assert slow_alignment(item, passage[start:end]) == score


def leaks(spark, documents, prose, **how):
    rng = random.Random(8)
    items = [(i, prose(rng.randint(16, 50))) for i in range(12)] + [(20, "three short words"), (21, None), (22, ""), (23, prose(5))]
    rows, want = list(MESSY), set()
    for n in range(60):
        text = prose(rng.randint(0, 200)).split()
        if n % 3 == 0:
            item = rng.choice(items[:12])
            words = item[1].split()
            for _ in range(rng.choice([0, 1, len(words) // 6])):  # edited copies
                at = rng.randrange(len(words))
                words[at:at + 1] = rng.choice([[], [prose(1)], [words[at], prose(1)]])
            at = rng.randint(0, len(text))
            text[at:at] = [w.upper() + "," for w in words]
            want.add((100 + n, item[0]))
        rows.append((100 + n, " ".join(text)))
    rows += [(300, prose(9) + " three short words " + prose(4)), (301, items[0][1]), (301, items[0][1])]
    want |= {(300, 20), (301, 0)}
    bench = frame(spark, items, ["item_id", "text"], ["long", "string"])
    return {(r["doc_id"], r["item_id"]): r for r in dc.decontaminate(documents(rows), bench, **how).collect()}, want


def test_edited_copies_are_found_and_clean_documents_left(spark, documents, prose):
    got, want = leaks(spark, documents, prose)
    assert set(got) == want
    assert got[301, 0]["score"] == 1.0 and got[301, 0]["start_word"] == 0


def test_blocks_of_items_give_the_same(spark, documents, prose):
    got, want = leaks(spark, documents, prose, block_words=100)
    assert set(got) == want


@pytest.mark.parametrize("copies", [1, 9, 1000])
def test_edited_copies_keep_their_seeds_however_often_they_stand(spark, documents, prose, copies):
    items = [(i, prose(40)) for i in range(3)]
    rows, want = [], set()
    for (i, text), step in zip(items, (5, 6, 7)):
        edited = " ".join(prose(1) + "q" if n % step == step - 1 else w for n, w in enumerate(text.split()))
        for c in range(copies):
            rows.append((10_000 * i + c, prose(12) + " " + edited + " " + prose(12)))
            want.add((10_000 * i + c, i))
    got = dc.decontaminate(documents(rows), frame(spark, items, ["item_id", "text"], ["long", "string"])).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert {round(r["score"], 1) for r in got} == {0.7, 0.8}


def test_a_common_opening_of_items_is_no_leak(spark, documents, prose):
    opening = prose(6)
    items = [(i, opening + " " + prose(30)) for i in range(40)]
    rows = [(i, prose(9) + " " + opening + " " + prose(40)) for i in range(60)] + [(99, prose(5) + " " + items[7][1])]
    got = dc.decontaminate(documents(rows), frame(spark, items, ["item_id", "text"], ["long", "string"])).collect()
    assert [(r["doc_id"], r["item_id"], r["score"]) for r in got] == [(99, 7, 1.0)]


@pytest.mark.parametrize("parts,gap", [(2, 9), (2, 20), (2, 32), (4, 12), (1, 0)])
def test_copies_with_long_insertions_score_as_a_whole(spark, documents, prose, parts, gap):
    words = prose(40).split()
    size = len(words) // parts
    pieces = [words[a:a + size] for a in range(0, 40, size)]
    if parts == 2:
        pieces = [[*p[:9], "changed", *p[10:]] for p in pieces]
    passage = f" {prose(gap)} ".join(" ".join(p) for p in pieces).split()
    rows = [(1, " ".join(passage)), (2, prose(300) + " " + " ".join(passage) + " " + prose(300)), (3, prose(300))]
    got = {r["doc_id"]: r for r in dc.decontaminate(documents(rows), frame(spark, [(7, " ".join(words))], ["item_id", "text"], ["long", "string"])).collect()}
    want = slow_alignment(words, passage) / (dc.MATCH * len(words))
    assert want >= dc.MIN_SCORE and set(got) == {1, 2}
    assert got[1]["score"] == want and got[1]["start_word"] == 0 and got[1]["end_word"] == len(passage)
    assert got[2]["score"] >= want and got[2]["start_word"] <= 300


def test_an_insertion_between_a_seed_and_the_rest(spark, documents, prose):
    words = prose(40).split()
    rest = [w if n % 4 else "q" + w for n, w in enumerate(words[8:])]  # no n-gram of the item left in it
    text = words[:8] + prose(12).split() + rest
    got = dc.decontaminate(documents([(1, " ".join(text))]), frame(spark, [(7, " ".join(words))], ["item_id", "text"], ["long", "string"])).collect()
    assert [r["score"] for r in got] == [slow_alignment(words, text) / 80]
    assert got[0]["end_word"] - got[0]["start_word"] == len(text)


def test_a_copy_with_every_fourth_word_replaced_is_met(spark, documents, prose):
    words = prose(40).split()
    text = " ".join("q" + w if n % 4 == 3 else w for n, w in enumerate(words))
    got = dc.decontaminate(documents([(1, prose(30) + " " + text + " " + prose(30)), (2, prose(90))]), frame(spark, [(7, " ".join(words))], ["item_id", "text"], ["long", "string"])).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(1, 7)] and got[0]["score"] >= 0.63


def test_decontamination_of_nothing(spark, documents):
    empty = frame(spark, [], ["item_id", "text"], ["long", "string"])
    assert dc.decontaminate(documents([]), empty).count() == 0
    assert dc.decontaminate(documents(MESSY), empty).count() == 0
    assert dc.decontaminate(documents([]), frame(spark, [(1, "a b c d e f")], ["item_id", "text"], ["long", "string"])).count() == 0


# ---- substring dedup

def brute_units(rows, least):
    units = []
    for i, text in rows:
        seen = set()
        for start, end, unit in sd.units_of(text or ""):
            assert (text or "")[start:end] == unit
            words = unit.lower().removesuffix(".").split()
            if len(words) >= least:
                units.append((i, start, end, " ".join(words), " ".join(words) in seen))
                seen.add(" ".join(words))
    ids = {}
    for i, _, _, u, _ in units:
        ids.setdefault(u, []).append(i)
    keep = {u: min((i for i in x if i is not None), default=None) for u, x in ids.items()}
    return sorted([(i, a, b, keep[u]) for i, a, b, u, again in units if again or i != keep[u]], key=repr)


def passages(prose):
    rng = random.Random(6)
    shared = [prose(12) + ".", prose(9), prose(30) + ". " + prose(20) + ". " + prose(15)]
    rows = [(i, "\n".join(rng.choice([prose(10), rng.choice(shared), rng.choice(shared).upper(), prose(5) + " " + rng.choice(shared) + " " + prose(4), ""])
                          for _ in range(rng.randint(0, 6)))) for i in range(80, 10, -1)]
    return MESSY + rows + [(400, shared[1])] * 2


def test_repeated_units_match_brute_force(spark, documents, prose):
    rows = passages(prose)
    got = sd.repeated_units(documents(rows)).collect()
    assert sorted([(r["doc_id"], r["start"], r["end"], r["keep_doc_id"]) for r in got], key=repr) == brute_units(rows, sd.MIN_WORDS)


def test_cutting_keeps_the_rest(spark, documents, prose):
    rows = passages(prose)
    gone = {}
    for i, a, b, _ in brute_units(rows, sd.MIN_WORDS):
        gone.setdefault(i, []).append((a, b))
    docs = documents(rows, clash=False)
    out = sd.cut_repeats(docs).collect()
    assert len(out) == len(rows)
    texts = dict(rows)
    for r in out:
        text, want, at = texts[r["doc_id"]], "", 0
        for a, b in sorted(set(gone.get(r["doc_id"], []))):
            want, at = want + text[at:a], b
        assert r["text"] == (text if text is None else want + text[at:])
        assert [tuple(s) for s in r["removed"]] == sorted(set(gone.get(r["doc_id"], [])))


SHORT = ["one two three", "four five", "six seven eight nine", "ten", "a b c d e f", "red green blue"]


def cut_text(spark, documents, rows):
    out = sd.cut_repeats(documents(rows, clash=False), units="passages").collect()
    return {r["doc_id"]: r["text"] for r in out}


def test_passages_of_short_sentences_are_cut_whole(spark, documents, prose):
    line, lines, long = ". ".join(SHORT) + ".", "\n".join(SHORT), prose(12)
    wrapped = " ".join(SHORT).split()
    rows = [(1, "\n".join([prose(9), line, prose(9)])), (2, "\n".join(["new opening words", line.upper(), "its own end"])), (3, lines + "\n\nbye"),
            (4, "hello\n\n" + " ".join(wrapped[:7]) + "\n" + " ".join(wrapped[7:]) + "\n\nbye bye"), (5, long + ". Right so"), (6, "see. " + long + ". Right so. no"),
            (7, ". ".join(["la la"] * 12)), (8, "hello. thank you. bye"), (9, "hello. thank you. bye")]
    got = cut_text(spark, documents, rows)
    assert got == {1: rows[0][1], 2: "new opening words\n\nits own end", 3: "\n\nbye", 4: "hello\n\n\n\nbye bye", 5: rows[4][1], 6: "see. . no",
                   7: ". ".join(["la la"] * 4) + ". ", 8: rows[7][1], 9: rows[8][1]}


def test_passages_keep_every_word_once_and_cover_repeated_runs(spark, documents):
    rng = random.Random(4)
    pool = [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 2, 3, 5, 9, 14]))) for _ in range(60)]
    rows = []
    for i in range(80):
        parts = [pool[(k + j) % 60] for k in rng.choices(range(60), k=3) for j in range(rng.randint(1, 6))]
        rows.append((i, "".join(p + rng.choice([". ", ".\n", "\n\n", "\n"]) for p in parts)))

    got = cut_text(spark, documents, rows)
    assert {w for t in got.values() for _, _, u in sd.units_of(t) for w in sd.normalise(u)} == {w for _, t in rows for _, _, u in sd.units_of(t) for w in sd.normalise(u)}
    runs, seen = {}, set()  # by hand: every run of whole sentences of 8 words or more that an earlier document has
    for i, text in rows:
        pieces = [(a, b, sd.normalise(u)) for a, b, u in sd.units_of(text) if sd.normalise(u)]
        own, gone = set(), [False] * len(pieces)
        for a in range(len(pieces)):
            for b in range(a, len(pieces)):
                words = tuple(w for p in pieces[a:b + 1] for w in p[2])
                if len(words) >= sd.MIN_WORDS:
                    own.add(words)
                    if words in seen:
                        gone[a:b + 1] = [True] * (b + 1 - a)
        seen |= own
        runs[i] = [p for p, g in zip(pieces, gone) if g]
    removed = {}
    for r in sd.repeated_units(documents(rows), units="passages").collect():
        removed.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
    for i, _ in rows:
        assert all(any(a <= p[0] and p[1] <= b for a, b in removed.get(i, [])) for p in runs[i])


def test_no_units(spark, documents):
    assert sd.repeated_units(documents([])).count() == 0


# ---- URL filters

def brute_hand_rule(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for h, p, v in uf.HAND_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else None


URLS = [None, "", "nothing", "http://", "http://Example.NET/en/x", "https://a.b.example.net/en", "ftp://example.net?q=/en/", "http://net/", "http://notnet/", "http://x.org/fr/1#a",
        "http://example.com/de/", "http://sub.EXAMPLE.com/de/y?z", "http://xexample.com/de/", "a://b://c.net/x", "http://é.org/FR/", "http://u:p@h.net:80/p", "://x.net/", "http://x.net", "\nhttp://x.net/\n?"]


def test_hand_rules_match_brute_force(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, "http://x.net/"), (3, "http://x.net/"), (3, "http://x.net/")]
    labels = frame(spark, [], ["page_id", "blocked"], ["long", "boolean"], clash=False)
    got = uf.filter_urls(frame(spark, rows, ["page_id", "url"], ["long", "string"]), labels).collect()
    want = []
    for i, u in rows:
        host, path, hit = brute_hand_rule(u)
        want.append((i, host, path, *(hit or (None, "allow"))))
    assert sorted([tuple(r)[:5] for r in got], key=repr) == sorted(want, key=repr)


def test_mined_rules_block(spark):
    rng = random.Random(1)
    rows = [(i, f"http://{rng.choice(['good', 'fair'])}{i % 7}.com/{rng.choice(['a', 'b'])}/{i}") for i in range(300)]
    rows += [(1000 + i, f"http://w{i % 9}.spam-farm.com/{rng.choice(['a', 'b'])}/buy?ref={i}") for i in range(120)]
    labels = [(i, i >= 1000 if rng.random() < 0.97 else None) for i, _ in rows[::2]]
    pages = frame(spark, rows, ["page_id", "url"], ["long", "string"])
    known = frame(spark, labels, ["page_id", "blocked"], ["long", "boolean"], clash=False)
    got = uf.filter_urls(pages, known).collect()
    assert {r["page_id"] for r in got if r["verdict"] == "block"} == {i for i, _ in rows if i >= 1000}
    # the index finds what checking every rule on every page finds
    distinct = uf.judged_pages(pages)
    rules = uf.mine_rules(distinct, known.select("page_id", "blocked"))
    pruned = [(set(r["antecedent"]), r["confidence"]) for r in rules.collect()]
    assert pruned and not any(a < b and ca >= cb for a, ca in pruned for b, cb in pruned)
    surest = {}
    for r in distinct.collect():
        hits = [c for a, c in pruned if a <= set(r["tokens"])]
        if hits:
            surest[r["page_id"]] = max(hits)
    assert {r["page_id"]: r["confidence"] for r in uf.match_rules(distinct, rules).collect()} == surest


def test_no_urls(spark):
    labels = frame(spark, [], ["page_id", "blocked"], ["long", "boolean"], clash=False)
    assert uf.filter_urls(frame(spark, [], ["page_id", "url"], ["long", "string"]), labels).count() == 0


# ---- secret scans

ASSIGN = re.compile(r"""(?a:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", re.IGNORECASE | re.ASCII)


def brute_base(text):
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


SECRETS = ["password=abcdef", "PassWord : 'abc'", "token=token : abcdefgh", "token=token=abcdefgh", "api_key=\"ab.cd/ef==\"", "apikey:= x", "AKIA" + "A" * 16, "AKIA" + "B" * 15, "AKIAAKIA" + "C" * 14,
           "0123456789abcdef01234567", "0123456789abcdef0123456", "secret=0123456789abcdef01234567ff", "ſecret=abcdefg", "toKen=abcdefg", "passwd  =  \"x1y2z3\"", "é" * 5, "secret:secret:secret"]


def test_base_spans_match_brute_force(spark, documents, prose):
    rng = random.Random(3)
    rows = list(MESSY) + [(20 + i, " ".join(rng.choice([prose(3), rng.choice(SECRETS), rng.choice(SECRETS) + rng.choice([" ", "\n", "", "é"])]) for _ in range(rng.randint(0, 12)))) for i in range(150)]
    rows.append((900, (prose(40) + " password=hunter22 ") * 300))
    got = {}
    for r in ss.scan_secrets(documents(rows)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for i, text in rows:
        base = brute_base(text or "")
        joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in base)
        for r in got[i]:
            assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(1 for x in base if x[1] == k) for k in range(3))
            assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
            kept = [s for s in r["spans"].split(",") if s and s.split(":")[0] in ss.STRONG]
            assert ",".join(kept) == joined


WEAK = "aB3" * 14  # 42 characters of three sorts
ACCESS = "AKIA" + "Q" * 16


def test_weak_parts_need_their_complements(spark, documents):
    far = " x" * 400
    rows = [(1, f"{WEAK}"), (2, f"{ACCESS} {WEAK}"), (3, f"{ACCESS}{far} {WEAK}"), (4, f"http://host.example/p {ACCESS} {WEAK}"), (5, f"http://host.example/p {WEAK}"),
            (6, "client_id=abcdefgh1 and password=abcdefg"), (7, "client_id=abcdefgh1"), (8, f"account_id: abcdefgh1 {WEAK}"), (9, f"token={WEAK} {ACCESS}")]
    got = {r["doc_id"]: r["spans"].split(",") if r["spans"] else [] for r in ss.scan_secrets(documents(rows)).collect()}
    kinds = {i: [s.split(":")[0] for s in v] for i, v in got.items()}
    assert kinds == {1: [], 2: ["access", "secret"], 3: ["access"], 4: ["endpoint", "access", "secret"], 5: [], 6: ["key_id", "assign"], 7: [],
                     8: ["key_id", "secret"], 9: ["assign", "access"]}
    assert got[2] == ["access:0:20", "secret:21:63"]


def test_identifiers_are_labelled_in_either_case(spark, documents):
    labels = ["CLIENT_ID=", "Account-Id: ", "clientId = ", '"clientId": "', "AWS_ACCESS_KEY_ID=", "appID:"]
    rows = [(i, f"{label}abcdefgh1 {WEAK}") for i, label in enumerate(labels)] + [(50, "CLIENT_ID=abcdefgh1"), (51, f"CLIENT_ID=abcdefg {WEAK}"), (52, "http://h.example/ CLIENT_ID=abcdefgh1 PASSWORD=abcdefg")]
    got = {r["doc_id"]: [s.split(":")[0] for s in r["spans"].split(",") if s] for r in ss.scan_secrets(documents(rows)).collect()}
    assert got == {**{i: ["key_id", "secret"] for i in range(len(labels))}, 50: [], 51: [], 52: ["endpoint", "key_id", "assign"]}


def test_scan_of_nothing(spark, documents):
    assert ss.scan_secrets(documents([])).count() == 0


# ---- toxicity

BAD = {"en": ["idiotx", "morony"], "de": ["loweix", "scheisy"]}


def labelled(spark, documents, prose, n=600):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(n):
        lang = "en" if i % 2 else "de"
        words = prose(rng.randint(5, 120)).split()
        bad = i % 5 == 0
        if bad:
            for _ in range(max(1, len(words) // 30)):
                words[rng.randrange(len(words))] = rng.choice(BAD[lang])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_classifier_finds_held_out_labels(spark, documents, prose):
    rows, labels = labelled(spark, documents, prose)
    known = frame(spark, labels + [(5, 1, None), (None, 1, 1)], ["doc_id", "quality", "toxic"], ["long", "int", "int"])
    long = (prose(30_000) + " " + BAD["en"][0] + " " + prose(30_000))
    docs = documents(rows + [(r[0] and 5000 + r[0], r[1]) for r in MESSY] + [(7000, long)])
    got = {r["doc_id"]: r for r in tox.toxicity(docs, known).collect()}
    import zlib
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items() if i is not None)
    for i, _, bad in labels:
        assert got[i]["predicted"] == (1 if got[i]["score"] >= 0.7 else 0)
    held = [(got[i]["predicted"], bad) for i, _, bad in labels if got[i]["held_out"]]
    assert sum(p == b for p, b in held) >= 0.97 * len(held)
    assert got[7000]["predicted"] == 1 and got[5002]["predicted"] == 0 and 0 <= got[None]["score"] <= 1


def test_pooling_in_blocks_is_pooling_at_once(prose, monkeypatch):
    rng = np.random.default_rng(1)
    texts = [prose(n) for n in (0, 1, 2, 3, 400, 0, 50, 1000, 7)]
    words = tk.words_of(pa.array(texts))
    tags, start = np.zeros(tox.ROWS, np.uint32), np.zeros(tox.ROWS, np.float32)
    at = (words.hashes & np.uint64(tox.ROWS - 1)).astype(np.int64)
    tags[at] = tox.tag_of(words.hashes)
    start[at] = rng.normal(0, 1, len(at))
    net = tox.Network(tags, start)
    whole = net.pooled(words.hashes, words.row_first)
    slow = np.zeros_like(whole)
    for r in range(len(texts)):
        rows = np.concatenate([net.rows_of(words.hashes[words.row_first[r]:words.row_first[r + 1]]), np.zeros(2, np.int64)])
        for k in range(len(tox.WIDTHS)):
            if len(rows) > 2:
                slow[r, k * tox.FILTERS:(k + 1) * tox.FILTERS] = np.maximum(net.convolve(net.emb[rows], k).max(0), 0)
    assert np.allclose(whole, slow, atol=1e-5)
    for block in (1, 3, 64):
        monkeypatch.setattr(tox, "BLOCK", block)
        assert np.allclose(net.pooled(words.hashes, words.row_first), whole, atol=1e-5)


def test_toxicity_without_labels(spark, documents):
    labels = frame(spark, [], ["doc_id", "quality", "toxic"], ["long", "int", "int"])
    assert {(r["score"], r["predicted"]) for r in tox.toxicity(documents(MESSY), labels).collect()} == {(0.0, 0)}
    assert tox.toxicity(documents([]), labels).count() == 0


def held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_all_labelled_rows_are_training_rows(spark, documents):
    n = 9000  # more than 3,000 of a label outside the held-out fold
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("few words").alias("text"), F.lit("en").alias("lang"))
    long = next(i for i in range(n) if not held_out(i))
    docs = docs.unionByName(documents([(1, "again"), (1, "again"), (2, "again"), (long, "w " * 20_000), (n, "no label")], clash=False).select("doc_id", "text", "lang"))
    known = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 10 == 0).cast("int").alias("toxic"))
    rows = tox.training_rows(docs, known)
    rows = rows.toPandas() if isinstance(rows, DataFrame) else rows[0].toPandas()
    assert sorted(rows["doc_id"]) == sorted([*(i for i in range(n) if not held_out(i)), *(i for i in (1, 1, 2, long) if not held_out(i))])
    assert rows["text"].str.len().max() == 40_000


def test_long_texts_teach(spark, documents, prose):
    base = prose(4000)  # over 20,000 characters
    rows = [(i, base + (" zzbad " if i % 4 == 0 else " ") + base) for i in range(160)]
    known = frame(spark, [(i, 1, int(i % 4 == 0)) for i, _ in rows], ["doc_id", "quality", "toxic"], ["long", "int", "int"])
    fresh = [(1000 + i, prose(30) + (" zzbad " if i % 2 else " ") + prose(30)) for i in range(20)]
    got = {r["doc_id"]: r["score"] for r in tox.toxicity(documents(rows + fresh), known).collect()}
    bad, good = ([got[i] for i, _ in fresh if i % 2 == odd] for odd in (1, 0))
    assert min(bad) > max(good)


def test_model_does_not_depend_on_partitions(spark, documents, prose):
    rows, labels = labelled(spark, documents, prose, 200)
    known = frame(spark, labels, ["doc_id", "quality", "toxic"], ["long", "int", "int"])
    docs = documents(rows + [(3, rows[3][1]), (5, None)])
    one, other = (tox.train_on(d, known) for d in (docs.coalesce(1), docs.orderBy(F.xxhash64("text")).repartition(7)))
    assert (one.emb == other.emb).all() and (one.out == other.out).all() and one.base == other.base
    assert (one.scale, one.shift, one.thresholds) == (other.scale, other.shift, other.thresholds)


def test_gradient_is_the_slope_of_the_loss(monkeypatch):
    rng = np.random.default_rng(3)
    net = tox.Network(np.arange(16, dtype=np.uint32), rng.normal(0, 1, 16), seed=1)
    first = np.array([0, 0, 1, 3, 40, 41, 300])
    rows = rng.integers(0, 16, first[-1])
    labels, weights = np.array([0, 1, 0, 1, 1, 0]), np.array([1.0, 2.0, 1.0, 2.0, 2.0, 1.0])
    small = tox.Compact(net.emb[:16].astype(np.float64), [f.astype(np.float64) for f in net.filters], net.bias, net.out, net.base)

    def loss():
        z = small.prepare().logits(small.tops(rows, first)[0])
        return (weights * (np.logaddexp(0, z) - labels * z)).sum()

    at, sums, dense = small.prepare().gradient(rows, first, labels, weights)
    assert 0 not in at
    for r in (1, 5):
        for d in (0, 3):
            own = sums[at == r, d].sum() / tox.ONE
            low, high = [], []
            for step, to in ((-1e-3, low), (1e-3, high)):
                small.emb[r, d] += step
                to.append(loss())
                small.emb[r, d] -= step
            assert abs((high[0] - low[0]) / 2e-3 - own) < 0.02 * max(1, abs(own))
    at_filter = 24 + 1 + (64 + 8) + 64 + 3 * 8 + 2  # out, base, the first filters and bias; second filters, second place
    low, high = [], []
    for step, to in ((-1e-3, low), (1e-3, high)):
        small.filters[1][1, 3, 2] += step
        to.append(loss())
        small.filters[1][1, 3, 2] -= step
    assert abs((high[0] - low[0]) / 2e-3 - dense[at_filter] / tox.ONE) < 0.02 * max(1, abs(dense[at_filter] / tox.ONE))
    for piece in (1, 2, 7):
        monkeypatch.setattr(tox, "PIECE", piece)
        for a, b in zip((at, sums, dense), small.prepare().gradient(rows, first, labels, weights)):
            assert (a == b).all()
