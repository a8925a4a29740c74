import random

import pytest
from pyspark.sql import types as T

#: Extra columns whose names the operators use inside.
CLASH = ["token", "sig", "mark", "words", "path", "level", "start", "row", "bucket", "removed"]


def frame(spark, rows, names, kinds, clash=True):
    """A DataFrame of ``rows`` with extra columns of clashing names."""
    fields = [T.StructField(n, T._parse_datatype_string(k)) for n, k in zip(names, kinds)]
    extra = [n for n in CLASH if n not in names] if clash else []
    fields += [T.StructField(n, T.StringType()) for n in extra]
    return spark.createDataFrame([tuple(r) + ("x",) * len(extra) for r in rows], T.StructType(fields))


@pytest.fixture
def documents(spark):
    def make(rows, clash=True):
        """rows: (doc_id, text) or (doc_id, text, source)."""
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        return frame(spark, full, ["doc_id", "text", "lang", "source", "n_chars"], ["long", "string", "string", "string", "long"], clash)

    return make


@pytest.fixture
def prose():
    """Deterministic invented prose."""
    rng = random.Random(5)
    stems = [a + b for a in ("ba", "ke", "lo", "mi", "tu", "ra", "sé", "no") for b in ("n", "r", "st", "m", "d", "lk", "x")]

    def make(n):
        return " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 3))) for _ in range(n))

    return make


#: Rows that every operator has to take: null id, null and empty texts, repeated rows, odd white space.
MESSY = [(1, None), (2, ""), (3, " \t\n "), (None, "a null id here"), (4, "same row"), (4, "same row"), (5, "word"), (6, "é ü x\x1cy  z"), (7, "A" * 300_000)]
