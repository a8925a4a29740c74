"""Registered queries: schema, whole tables, and oracle SQL at small scale."""
import os
import re

import pytest

import __spark_entry__ as E
import corpus_pipeline
from quadrille.llm import queries
from quadrille.llm.common import dropping, write_result, write_table
from quadrille.llm.substring_dedup import repeated_units
from quadrille.plans.session import ensure_checkpoint_dir
from tests import oracle_check
from tests.conftest import SF001, SF01
from tests.llm.conftest import frame


def test_eleven_queries_are_registered():
    names = E.queries()
    assert all(sum(k.startswith(f"op{n}_") for k in names) == 1 for n in range(1, 11)) and "pipeline" in names


@pytest.mark.skipif(not os.path.exists(SF01), reason="no sf0.01 data")
@pytest.mark.parametrize("key", sorted(queries.ORACLE_SQL))
def test_queries_match_their_sql(spark, key):
    assert oracle_check.run(spark, SF01, [key])[key]["values_match"]


@pytest.mark.skipif(not os.path.exists(SF001), reason="no sf0.001 data")
def test_sentence_units_match_their_sql(spark):
    got = repeated_units(queries.read(spark, SF001, "documents"), units="sentences").drop("mark").toPandas()
    assert oracle_check.compare(got, oracle_check.duck(SF001).execute(queries.UNITS_SQL).df())["values_match"]


@pytest.mark.skipif(not os.path.exists(SF001), reason="no sf0.001 data")
def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    names = docs.columns
    for stage, f in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, f(spark, docs, SF001).cache()
        assert docs.columns == names
        ids = {r[0] for r in docs.select("doc_id").collect()}
        assert ids <= {r[0] for r in before.select("doc_id").collect()}
        if stage == "near_duplicates":
            again = corpus_pipeline.jaccard_join(docs).where("doc_id <> component_id")
            assert again.count() == 0
        if stage == "decontamination":
            assert corpus_pipeline.decontaminate(docs, spark.read.parquet(f"{SF001}/benchmark.parquet")).count() == 0
    out = corpus_pipeline.tokens(spark, docs, SF001)
    assert out.count() == docs.count()
    assert corpus_pipeline.run(spark, SF001).count() == docs.count()


def test_stages_judge_rows_by_id_and_text(spark, documents, prose, tmp_out):
    item, near, bad = prose(40), prose(60), "idiotx morony " * 3
    frame(spark, [(1, item)], ["item_id", "text"], ["long", "string"], clash=False).write.parquet(f"{tmp_out}/benchmark.parquet")
    clean = {i: prose(30) for i in range(400)}
    texts = {i: t + (" " + bad if i % 4 == 0 else "") for i, t in clean.items()}
    frame(spark, [(i, 1, int(i % 4 == 0)) for i in texts], ["doc_id", "quality", "toxic"], ["long", "int", "int"], clash=False).write.parquet(f"{tmp_out}/labels.parquet")

    leaks = documents([(None, prose(5) + " " + item), (None, clean[1]), (7, clean[2]), (7, item), (8, clean[3]), (9, None), (None, None)])
    got = corpus_pipeline.decontamination(spark, leaks, tmp_out).collect()
    assert sorted([(r["doc_id"], r["text"]) for r in got], key=repr) == sorted([(None, clean[1]), (7, clean[2]), (8, clean[3]), (9, None), (None, None)], key=repr)

    toxic = documents([*texts.items(), (None, clean[4] + " " + bad), (None, clean[6]), (901, clean[4] + " " + bad), (901, clean[7])])
    got = {(r["doc_id"], r["text"]) for r in corpus_pipeline.toxicity(spark, toxic, tmp_out).collect()}
    assert {g for g in got if g[0] is None or g[0] > 900} == {(None, clean[6]), (901, clean[7])}

    rows = [(5, near), (5, near), (5, clean[8]), (None, near + " more"), (6, "  ".join(near.split())), (4, clean[9]), (None, clean[10]), (None, clean[10]), (3, ""), (3, ""), (2, clean[11])]
    got = corpus_pipeline.near_duplicates(spark, documents(rows).repartition(4), tmp_out).collect()
    want = [(5, near), (5, clean[8]), (4, clean[9]), (None, clean[10]), (3, ""), (3, ""), (2, clean[11])]
    assert sorted([(r["doc_id"], r["text"]) for r in got], key=repr) == sorted(want, key=repr)


def tables_of(spark) -> set[str]:
    """The tables in the shared folder."""
    folder = re.sub("^file:/+", "/", ensure_checkpoint_dir(spark)) + "/quadrille-out"
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_results_outlive_the_tables_on_the_way(spark):
    before = tables_of(spark)

    def steps():
        one = write_result(lambda: write_table(spark.range(9), "a").where("id > 2"), "b")
        assert sorted(re.sub("-.*", "", t) for t in tables_of(spark) - before) == ["b"]
        return one.union(write_table(spark.range(2), "c"))

    out = write_result(steps, "d")
    assert sorted(re.sub("-.*", "", t) for t in tables_of(spark) - before) == ["d"]
    assert sorted(r["id"] for r in out.collect()) == [0, 1, 3, 4, 5, 6, 7, 8]
    with pytest.raises(ZeroDivisionError), dropping():
        write_table(spark.range(2), "e")
        1 / 0
    assert sorted(re.sub("-.*", "", t) for t in tables_of(spark) - before) == ["d"]
    assert out.count() == 8


def test_stages_drop_the_tables_on_the_way(spark, documents, prose, tmp_out):
    item, bad = prose(40), "idiotx morony " * 3
    frame(spark, [(1, item)], ["item_id", "text"], ["long", "string"], clash=False).write.parquet(f"{tmp_out}/benchmark.parquet")
    texts = {i: prose(30) + (" " + bad if i % 4 == 0 else "") for i in range(100)}
    frame(spark, [(i, 1, int(i % 4 == 0)) for i in texts], ["doc_id", "quality", "toxic"], ["long", "int", "int"], clash=False).write.parquet(f"{tmp_out}/labels.parquet")
    docs = documents([*texts.items(), (200, texts[1] + " end"), (201, texts[1]), (202, texts[2] + " " + item)], clash=False)
    left = {}
    for stage, f in corpus_pipeline.STAGES[:-1]:
        before = tables_of(spark)
        f(spark, docs, tmp_out).write.parquet(f"{tmp_out}/{stage}")
        docs = spark.read.parquet(f"{tmp_out}/{stage}")
        left[stage] = {re.sub("-.*", "", t) for t in tables_of(spark) - before}
    assert 201 not in {r["doc_id"] for r in docs.collect()} and docs.count() > 10
    assert left == {"toxicity": {"gone"}, "decontamination": {"leaks", "gone"}, "mixing": {"mix_copies"},
                    "near_duplicates": {"near_components", "several", "near_members", "near_best", "repeated_rows", "gone"}}
