import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quadrille.llm import exact_dedup as ed
from quadrille.llm import mixing as mx
from quadrille.llm.components import connected_components
from tests.llm.conftest import MESSY

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(SPACE.sub(" ", t or ""), []).append(i)
    out = []
    for i, t in rows:
        norm = SPACE.sub(" ", t or "")
        ids = [x for x in groups[norm] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[norm]), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_dedup_matches_brute_force(spark, documents, prose):
    rng = random.Random(1)
    texts = [prose(rng.randint(1, 60)) for _ in range(20)]
    rows = MESSY + [(10 + i, rng.choice(texts).replace(" ", rng.choice([" ", "  ", "\n"]))) for i in range(120)]
    rows += [(900, "Long " + prose(30_000)), (901, None), (902, "long")]
    rows.append((903, rows[-3][1].replace(" ", "\t ")))
    got = ed.exact_dedup(documents(rows)).drop("n_bytes").collect()
    assert sorted(map(tuple, got), key=repr) == brute_exact(rows)


def test_fingerprints_compose(spark, documents, prose):
    docs = documents(MESSY + [(50, prose(400)), (51, prose(2000))])
    whole = sorted(map(tuple, ed.fingerprints(docs).collect()), key=repr)
    cut = sorted(map(tuple, ed.fingerprints(docs, part=100).collect()), key=repr)
    assert whole == cut


def test_polynomial_by_hand():
    import numpy as np
    data = np.frombuffer(b"abcxyz", np.uint8)
    for which, (p, b) in enumerate(zip(ed.PRIMES, ed.BASES)):
        got = ed.part_hashes(data, np.array([0, 3, 3, 6]), which)
        want = [sum((c + 1) * pow(b, 2 - i, p) for i, c in enumerate(part)) % p for part in (b"abc", b"", b"xyz")]
        assert got.tolist() == want


def test_equal_fingerprints_of_different_texts_are_told_apart(spark, documents):
    rows = [(1, "aaaa bbbb"), (2, "aaaa cccc"), (3, "aaaa bbbb"), (4, "zzzz")]
    docs = documents(rows)
    prints = ed.fingerprints(docs).withColumns({"f1": F.lit(7).cast("long"), "f2": F.lit(8).cast("long")})
    bad = ed.collided(docs, prints, "doc_id", "text", 4).collect()
    assert [tuple(r) for r in bad] == [(7, 8, 9)]
    assert ed.collided(docs, ed.fingerprints(docs), "doc_id", "text", 4).count() == 0


def test_exact_dedup_of_nothing(spark, documents):
    assert ed.exact_dedup(documents([])).count() == 0


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = dict(zip(order, [3, 1, 2] * len(order)))
    total, full, unit = 1.5 * sum(sizes.values()), set(), 0
    while True:
        left = sum(weight[s] for s in order if s not in full)
        if not left:
            break
        unit = (total - sum(2 * sizes[s] for s in full)) / left
        new = {s for s in order if s not in full and weight[s] * unit > 2 * sizes[s]}
        if not new:
            break
        full |= new
    return {s: 2.0 * sizes[s] if s in full else weight[s] * unit for s in order}


def mixed_rows(prose):
    rng = random.Random(3)
    rows = [(i, prose(rng.randint(1, 80)), rng.choice(["a", "b", "é", None, "Z", "a"])) for i in range(400)]
    return rows + [(1000 + i, t, "messy") for i, (_, t) in enumerate(MESSY)] + [(2000, rows[0][1], "a")] * 2


def test_mixing_meets_targets(spark, documents, prose):
    rows = mixed_rows(prose)
    got = mx.mix(documents(rows)).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows)
    words = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    source = {r[0]: r[2] for r in rows}
    sizes = {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + words[r[0]]
    want, taken = brute_targets(sizes), dict.fromkeys(sizes, 0)
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == words[r["doc_id"]] and r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(want[s], rel=1e-9)
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(0.02 * want[s], 10), s
    again = mx.mix(documents(rows).repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_newton_solves_two_constraints(spark):
    cells = spark.createDataFrame([("a", "x", 100), ("a", "y", 50), ("b", "x", 30), ("b", "y", 20)], "s string, l string, words long")
    by = {"s": spark.createDataFrame([("a", 120.0), ("b", 60.0)], "level string, target double"),
          "l": spark.createDataFrame([("x", 100.0), ("y", 80.0)], "level string, target double")}
    lam = {c: {r["level"]: r["lam"] for r in t.collect()} for c, t in mx.newton_multipliers(cells, by).items()}
    mass = {(s, x): w * math.exp(lam["s"][s] + lam["l"][x]) for s, x, w in [tuple(r) for r in cells.collect()]}
    assert mass["a", "x"] + mass["a", "y"] == pytest.approx(120)
    assert mass["a", "x"] + mass["b", "x"] == pytest.approx(100)


def test_joint_newton_converges_quadratically(spark, monkeypatch):
    monkeypatch.setattr(mx, "STEPS", 8)  # strongly coupled: turns need far more
    words = {("a", "x"): 1000, ("a", "y"): 3, ("b", "x"): 5, ("b", "y"): 2000, ("c", "x"): 40, ("c", "z"): 7}
    rate = {"a": 1.4, "b": 0.3, "c": 0.9}, {"x": 0.8, "y": 2.5, "z": 1.0}
    want = {k: w * rate[0][k[0]] * rate[1][k[1]] for k, w in words.items()}
    cells = spark.createDataFrame([(*k, w) for k, w in words.items()] + [("off", "x", 50)], "s string, l string, words long")
    goal = [{k: sum(m for c, m in want.items() if c[side] == k) for k in rate[side]} for side in (0, 1)]
    by = {c: spark.createDataFrame([*g.items(), ("off", 0.0), ("absent", 3.0)], "level string, target double") for c, g in zip("sl", goal)}
    lam = {c: {r["level"]: r["lam"] for r in t.collect()} for c, t in mx.newton_multipliers(cells, by).items()}
    for k, w in words.items():
        assert w * math.exp(lam["s"][k[0]] + lam["l"][k[1]]) == pytest.approx(want[k], rel=1e-9)
    assert lam["s"]["off"] is None and lam["s"]["absent"] is None


def test_mixing_by_source_and_length(spark, documents, prose):
    rng = random.Random(8)
    rows = [(i, prose(rng.choice([5, 6, 60, 70])), rng.choice("aab")) for i in range(600)]
    words = {i: len(t.split()) for i, t, _ in rows}
    long = {i: words[i] > 30 for i in words}
    sizes = {s: sum(words[i] for i, _, x in rows if x == s) for s in "ab"}
    want = brute_targets(sizes)
    cell = {(s, c): sum(words[i] for i, _, x in rows if x == s and long[i] == c) for s in "ab" for c in (False, True)}
    short = 0.8 * sum(m * want[s] / sizes[s] for (s, c), m in cell.items() if not c)  # fewer short ones than one rate a source gives
    goals = spark.createDataFrame([("false", short), ("true", sum(want.values()) - short)], "level string, target double")
    got = mx.mix(documents(rows), also={"length": (F.length("text") > 160, goals)}).collect()
    is_long = {i: len(t) > 160 for i, t, _ in rows}
    assert is_long == long and len({round(r["rate"], 9) for r in got}) == 4
    source, taken = {i: s for i, _, s in rows}, dict.fromkeys([*sizes, True, False], 0)
    for r in got:
        taken[source[r["doc_id"]]] += r["taken"]
        taken[long[r["doc_id"]]] += r["taken"]
    for key, target in [*want.items(), (False, short), (True, sum(want.values()) - short)]:
        assert abs(taken[key] - target) <= max(0.02 * target, 140), key


def test_mixed_corpus_repeats_rows(spark, documents, prose):
    docs = documents(mixed_rows(prose)[:200])
    mixed = {r["doc_id"]: r["copies"] for r in mx.mix(docs).collect()}
    out = mx.apply_mix(docs)
    assert out.columns == docs.columns
    counts = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert counts == {i: c for i, c in mixed.items() if c}


def test_mixing_of_nothing(spark, documents):
    assert mx.mix(documents([])).count() == 0
    assert mx.apply_mix(documents([(1, None), (2, "")])).count() == 0


def test_components_match_union_find(spark):
    rng = random.Random(9)
    links = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(90)] + [(200 + i, 201 + i) for i in range(40)] + [(300, i) for i in range(301, 400)]
    root = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    got = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert {(r["node"], r["root"]) for r in got} == {(x, top(x)) for x in linked} and len(got) == len(linked)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mixed_rows_of_null_and_shared_ids_meet_targets(spark, documents):
    """Rows are known by all their columns: 1,000 rows of one size with null ids, or of one id."""
    rows = [(None if s == "a" else 7 if s == "b" else i, f"w{i} " + "x " * 9, s) for s in "abc" for i in range(1000)]
    docs = documents(rows)
    want = {r["level"]: r["target"] for r in mx.source_targets(mx.sized(docs, "doc_id", "text", "source"), mx.WEIGHTS, mx.SHARE, mx.CAP).collect()}
    got = {r["source"]: r["n"] * 10 for r in mx.apply_mix(docs).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert sorted(got) == ["a", "b", "c"]
    assert all(abs(a - b) <= 30 for a, b in zip(sorted(got.values()), sorted(want.values())))


def test_rows_alike_are_repeated_together(spark, documents):
    docs = documents([(1, "one two three", "a")] * 2500 + [(2, "four five six", "b")])
    taken = mx.mix(docs).agg(F.sum("copies")).first()[0]
    assert mx.apply_mix(docs).count() == taken
