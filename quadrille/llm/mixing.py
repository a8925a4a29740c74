"""Mix sources to target weights by entropy balancing.

Every word of a source is equally likely before mixing.  The tilt that meets
the token constraints and stays closest to that (in relative entropy) gives a
document the rate ``exp(sum of its constraint multipliers)``; the multipliers
solve a convex dual, found by Newton steps on aggregated cells (one row per
combination of constraint levels); several constraints are solved jointly, with
the cross terms of their Hessian.  Rates become whole copies by systematic
rounding within classes of similar size, each class making up for what the
classes of larger documents missed, so that the words taken from a source miss
its target by about one small document.

The default constraint is one level per source.  Targets: sources in code point
order (null last) weigh 3, 1, 2, repeating, and share ``share`` times all words;
no target exceeds ``cap`` times its source, and the excess goes to the others by
weight until none is above.

Null texts have size 0, a null source is a source of its own.  Repeated rows
are separate documents.  Equal rows may swap their copies; the result as a set
of rows is the same on every run.  Extra columns are ignored (the operator
:func:`apply_mix` keeps them).  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.common import WORD, text_or_empty, write_result, write_table
from quadrille.plans.session import materialize

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, CAP = 1.5, 2.0
REPEAT = 1000  # times a task repeats a row at a stretch
ROWS = 128  # documents lined up together
CLASSES = 32  # size classes per doubling of the size
TOLERANCE, STEPS = 1e-12, 100
LEVELS = 500  # levels of coupled constraints that are solved together


def level_key(column: str | Column):
    """A level as a string that is never null."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.concat(F.lit("s"), column.cast("string")), F.lit("null"))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", mark_col: str | None = None,
          also: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, source, size (words of the whole text), and row_mark and levels ``by_*`` if asked."""
    size = F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long").alias("size")
    more = [F.col(mark_col).alias("row_mark")] if mark_col else []
    more += [level_key(column).alias(f"by_{name}") for name, column in (also or {}).items()]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size, *more)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, level, source_size, target; one row per source.

    The order of sources is a window over one row per source, not per document.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    at = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at % len(weights) + 1).cast("int"))
    per = write_table(per.select("source", level_key("source").alias("level"), "source_size", weight.alias("weight"),
                                 (F.col("source_size") * cap).alias("most")), "source_weights")
    total = (per.agg(F.sum("source_size")).first()[0] or 0) * share
    unit, full = None, -1
    while True:  # each round fills at least one more source
        above = F.lit(False) if unit is None else F.col("most") < F.col("weight") * unit
        n, used, left = per.agg(F.count(F.when(above, 1)), F.sum(F.when(above, F.col("most")).otherwise(0.0)),
                                F.sum(F.when(above, 0.0).otherwise(F.col("weight")))).first()
        if n == full or not left:
            break
        full, unit = n, (total - used) / left
    target = F.col("most") if unit is None else F.least(F.col("most"), F.col("weight") * unit)
    return per.select("source", "level", "source_size", target.alias("target"))


def newton_multipliers(cells: DataFrame, targets: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Multipliers of the dual, per constraint a table (level, lam).

    ``cells`` has one column per constraint (its level), and ``words``.  A
    constraint's own block of the Hessian is diagonal (levels do not overlap), so
    one constraint may have any number of levels.  Several constraints are solved
    together by :func:`joint_newton`; over LEVELS levels in all, they take turns.
    A level without words or with target 0 has a null multiplier: its rate is 0.
    """
    if len(targets) > 1 and sum(t.count() for t in targets.values()) <= LEVELS:
        return joint_newton(cells, targets)
    lam = {c: materialize(t.select("level", "target", F.when(F.col("target") > 0, F.lit(0.0)).alias("lam")))
           for c, t in targets.items()}
    for _ in range(STEPS):
        worst = 0.0
        for c in targets:
            tilt, joined = F.lit(0.0), cells
            for d, table in lam.items():
                joined = joined.join(table.select(F.col("level").alias(d), F.col("lam").alias(f"lam_{d}")), d, "left")
                tilt = tilt + F.col(f"lam_{d}")
            mass = joined.groupBy(c).agg(F.sum(F.col("words") * F.exp(tilt)).alias("mass")).withColumnRenamed(c, "level")
            # gradient mass - target, Hessian mass; the step is cut to stay in reach of exp
            step = F.greatest(F.lit(-4.0), F.least(F.lit(4.0), (F.col("target") - F.col("mass")) / F.col("mass")))
            moved = lam[c].join(mass, "level", "left").select(
                "level", "target", F.when(F.col("mass") > 0, F.col("lam") + step).alias("lam"),
                F.when(F.col("mass") > 0, F.abs(F.col("mass") - F.col("target")) / F.col("target")).alias("miss"))
            moved = materialize(moved)
            worst = max(worst, moved.agg(F.max("miss")).first()[0] or 0.0)
            lam[c] = moved.drop("miss")
        if worst <= TOLERANCE:
            break
    return {c: t.select("level", "lam") for c, t in lam.items()}


def joint_newton(cells: DataFrame, targets: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Multipliers of coupled constraints by Newton steps on all of them at once.

    Spark tilts the cells and adds up their words per pair of levels, which is the
    Hessian of the dual (its diagonal less the targets is the gradient); the driver
    gets at most LEVELS^2 sums and solves for the step, which is halved until the
    dual falls enough.  Multipliers are fixed up to shifts between constraints that
    leave all rates alone; the smallest step is taken.  Targets that cannot hold
    together end at the step where the dual stops falling.
    """
    spark, goal, numbered = cells.sparkSession, [], {}
    for c, table in targets.items():
        levels = [tuple(r) for r in table.where("target > 0").select("level", "target").collect()]  # at most LEVELS rows
        numbered[c] = {level: len(goal) + i for i, (level, _) in enumerate(levels)}
        goal += [float(t) for _, t in levels]
    goal, sides = np.array(goal), list(targets)
    pairs = F.explode(F.array(*[F.struct(F.col(f"at_{c}").alias("i"), F.col(f"at_{d}").alias("j")) for n, c in enumerate(sides) for d in sides[n:]]))

    def tilted(lam: np.ndarray) -> tuple[float, np.ndarray]:
        """The dual and its Hessian at ``lam``."""
        joined, tilt = cells, F.lit(0.0)
        for c in sides:  # cells of a level with target 0 hold no words
            table = spark.createDataFrame([(level, i, float(lam[i])) for level, i in numbered[c].items()], f"`{c}` string, `at_{c}` int, `lam_{c}` double")
            joined, tilt = joined.join(F.broadcast(table), c), tilt + F.col(f"lam_{c}")
        sums = joined.select((F.col("words") * F.exp(tilt)).alias("mass"), pairs.alias("at")).groupBy("at.i", "at.j").agg(F.sum("mass").alias("mass"))
        hessian = np.zeros((len(goal), len(goal)))
        for i, j, mass in sums.collect():
            hessian[i, j] = hessian[j, i] = mass
        own = np.diag(hessian)
        return own[list(numbered[sides[0]].values())].sum() - (goal * lam)[own > 0].sum(), hessian

    lam = np.zeros(len(goal))
    dual, hessian = tilted(lam)
    for _ in range(STEPS):
        live = np.diag(hessian) > 0
        slope = np.where(live, np.diag(hessian) - goal, 0.0)
        if not live.any() or (np.abs(slope) / goal).max() <= TOLERANCE:
            break
        scale = np.sqrt(np.where(live, np.diag(hessian), 1.0))
        step = -np.linalg.lstsq(hessian / np.outer(scale, scale), slope / scale, rcond=1e-10)[0] / scale
        step *= min(1.0, 4.0 / max(np.abs(step).max(), 1e-300))  # stays in reach of exp
        fall, part = float(slope @ step), 1.0
        while part > 1e-6:
            there, matrix = tilted(lam + part * step)
            if there <= dual + 1e-4 * part * fall + 1e-14 * abs(dual):
                break
            part /= 2
        else:
            break
        lam, dual, hessian = lam + part * step, there, matrix
    live = np.diag(hessian) > 0
    out = {}
    for c, table in targets.items():
        found = spark.createDataFrame([(level, float(lam[i])) for level, i in numbered[c].items() if live[i]], "level string, lam double")
        out[c] = table.select("level").join(F.broadcast(found), "level", "left")
    return out


def extra_copies(klasses: DataFrame) -> DataFrame:
    """Adds to (level, klass, n, words, part) how many of the n get a copy more.

    From the largest documents to the smallest, each class rounds its share and
    hands what is left to the next; a level has a few hundred classes at most.
    """
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("klass")).alias("order"), "n", "words", "part")))

    def step(state, c):
        mean = c["words"] / c["n"]
        due = state["carry"] + c["part"] * c["words"]
        more = F.when(mean > 0, F.greatest(F.lit(0.0), F.least(c["n"].cast("double"), F.round(due / mean)))).otherwise(F.lit(0.0))
        done = F.struct((-c["order"]).alias("klass"), more.cast("long").alias("extra"))
        return F.struct((due - more * mean).alias("carry"), F.concat(state["out"], F.array(done)).alias("out"))

    start = F.struct(F.lit(0.0).alias("carry"), F.array().cast("array<struct<klass:bigint,extra:bigint>>").alias("out"))
    shared = klasses.groupBy("level").agg(ordered.alias("all")).select(
        "level", F.explode(F.aggregate("all", start, step)["out"]).alias("e")).select("level", "e.klass", "e.extra")
    return klasses.join(shared, ["level", "klass"])


def round_copies(rated: DataFrame, cap: float = CAP) -> DataFrame:
    """Adds ``copies`` to (doc_id, source, level, size, rate).

    Each document gets the whole part of its rate.  Of the n documents of a size
    class, lined up by a hash, the k-th gets one more if floor(k * extra / n)
    steps up.  The line is cut into buckets of about ROWS documents, so that no
    task orders a whole source or class.
    """
    rated = rated.select("*", F.floor(F.log2(F.col("size") + 1) * CLASSES).alias("klass"), F.xxhash64("doc_id", "source", "size").alias("mark"))
    klasses = rated.groupBy("level", "klass").agg(
        F.count("*").alias("n"), F.sum("size").alias("words"), F.first(F.col("rate") - F.floor("rate")).alias("part"))
    klasses = extra_copies(write_table(klasses, "size_classes"))
    klasses = write_table(klasses.select("level", "klass", "n", "extra", F.ceil(F.col("n") / ROWS).alias("n_buckets")), "class_copies")
    rated = write_table(rated.join(klasses, ["level", "klass"]).withColumn("bucket", F.pmod("mark", F.col("n_buckets"))), "rated")
    line = Window.partitionBy("level", "klass").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = rated.groupBy("level", "klass", "bucket").agg(F.count("*").alias("own"))
    buckets = write_table(buckets.select("level", "klass", "bucket", F.coalesce(F.sum("own").over(line), F.lit(0)).alias("before")), "buckets")
    within = Window.partitionBy("level", "klass", "bucket").orderBy("mark", "doc_id", "size", *(["row_mark"] if "row_mark" in rated.columns else []))
    rated = rated.join(buckets, ["level", "klass", "bucket"]).withColumn("k", F.col("before") + F.row_number().over(within))
    more = F.floor(F.col("k") * F.col("extra") / F.col("n")) - F.floor((F.col("k") - 1) * F.col("extra") / F.col("n"))
    return rated.withColumn("copies", F.least(F.floor("rate") + more, F.lit(int(cap))).cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, share: float = SHARE, cap: float = CAP, mark_col: str | None = None,
        also: dict[str, tuple[Column, DataFrame]] | None = None) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, rate.

    ``mark_col``, if given, is a column that knows rows apart whose ids are alike; it is
    returned as ``row_mark``.  ``also`` gives further constraints by name: a column over
    ``docs`` and a table (level, target) of the words to take of each of its values.  Rates
    then differ within a source, rows without a target are not taken, and rates above
    ``cap`` are cut to it, so that targets which need more are missed.
    """
    also = also or {}
    by = ["level", *[f"by_{name}" for name in also]]
    sizes = sized(docs, id_col, text_col, source_col, mark_col, {name: column for name, (column, _) in also.items()})
    sizes = write_table(sizes.withColumn("level", level_key("source")), "sizes")
    targets = write_table(source_targets(sizes, weights, share, cap), "targets")
    cells = write_table(sizes.groupBy(*by).agg(F.sum("size").alias("words")), "cells")
    goals = {f"by_{name}": write_table(table.select(level_key("level").alias("level"), F.col("target").cast("double")), "goals") for name, (_, table) in also.items()}
    lam = newton_multipliers(cells, {"level": targets, **goals})
    rates = cells.join(targets.select("level", "source_size", "target"), "level")
    for c in by:
        rates = rates.join(lam[c].select(F.col("level").alias(c), F.col("lam").alias(f"lam_{c}")), c, "left")
    tilt = sum((F.col(f"lam_{c}") for c in by), F.lit(0.0))
    rates = write_table(rates.select(*by, "source_size", "target", F.least(F.coalesce(F.exp(tilt), F.lit(0.0)), F.lit(float(cap))).alias("rate")), "rates")
    rated = sizes.join(rates, by)
    if also:  # documents of one rate are rounded together
        rated = rated.withColumn("level", F.to_json(F.array(*by)))
    return round_copies(rated, cap).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "rate",
        *(["row_mark"] if mark_col else []))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as it has copies.

    Rows are known by a 128-bit hash of all their columns, whatever their ids.  Rows
    alike in all columns are one row that is taken as often as all of them together.
    """
    names, mark = docs.columns, "mix_mark"
    while mark in names:
        mark += "_"
    unset = F.array(*[F.col(f"`{n}`").isNull() for n in names])
    own = [F.hex(F.xxhash64(F.lit(seed), unset, *[F.col(f"`{n}`") for n in names])) for seed in (0, 1)]
    marked = docs.withColumn(mark, F.concat(*own))

    def copies() -> DataFrame:
        mixed = mix(marked, id_col, mark_col=mark, **how)
        return mixed.groupBy("row_mark").agg(F.sum("copies").alias("mix_copies")).where("mix_copies > 0")

    mixed = write_result(copies, "mix_copies")
    rows = marked.select(F.col(mark).alias("of"), F.struct(*[F.col(f"`{n}`") for n in names]).alias("row")).dropDuplicates(["of"])
    rows = rows.join(mixed, F.col("of") == F.col("row_mark")).select("row", "mix_copies")
    some = rows
    if mixed.where(F.col("mix_copies") > REPEAT).limit(1).count():
        some = rows.where(F.col("mix_copies") <= REPEAT)
        many = rows.where(F.col("mix_copies") > REPEAT)  # in chunks, dealt out
        many = many.select("row", "mix_copies", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("mix_copies") - 1) / REPEAT))).alias("chunk"))
        many = many.select("row", F.least(F.lit(REPEAT).cast("long"), F.col("mix_copies") - F.col("chunk") * REPEAT).alias("mix_copies"), "chunk").repartition("chunk").drop("chunk")
        some = some.unionByName(many)
    out = some.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies"))))
    return out.select(*[F.col(f"row.`{n}`").alias(n) for n in names])
