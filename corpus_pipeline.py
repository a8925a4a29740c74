"""The corpus pipeline: toxicity, near duplicates, decontamination, mixing, tokens.

Each stage takes ``(spark, docs, sf_dir)``, works on all its predecessor kept,
and returns a DataFrame; all but the last return the columns of documents.
``run`` writes each stage as Parquet to the shared folder and reads it again.

* toxicity: documents that the classifier rejects (score of THRESHOLD or more)
  go; it learns from the labels of documents outside the held-out fold.
* near_duplicates: of each component of the 5-word Jaccard join the document
  with the smallest id stays.
* decontamination: documents that hold a passage of a benchmark item go.
* mixing: every row appears as often as the mix takes it (0, 1 or 2 times); rows are
  known by a 128-bit hash of all columns, so null and shared ids do no harm.
* tokens: the mixed corpus as token files, described per document.

Decisions hold for rows of an id and a text: the three stages that reject rows
know them by ``mark``, a 64-bit hash of both, so that rows with a null id are
judged like others and rows that share an id apart.  Of near copies the smallest
id stays (null last, then the smallest mark), and of rows with the same id and
text (of one word at least) one.

Tables that a stage writes on the way are dropped once nothing reads them.

Null texts and empty tables fare as the operators say; columns beyond those of
documents are left out.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import toxicity as tox
from quadrille.llm.common import read, text_or_empty, write_result, write_table
from quadrille.llm.decontamination import decontaminate
from quadrille.llm.jaccard_join import jaccard_join
from quadrille.llm.mixing import apply_mix
from quadrille.llm.token_output import token_output

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def marked(docs: DataFrame) -> DataFrame:
    """The columns of documents and ``mark``, a hash of the id and the text."""
    unset = F.col("doc_id").isNull()  # a hash leaves nulls out
    return docs.select(*COLUMNS, F.xxhash64(unset, "doc_id", text_or_empty()).alias("mark"))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` less the rows with a mark (``doc_id``) of ``gone``; both sides are exchanged by it."""
    gone = gone.select(F.col("doc_id").alias("gone_mark")).distinct()
    return docs.join(write_table(gone, "gone"), F.col("mark") == F.col("gone_mark"), "left_anti")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = marked(docs)
    net = tox.train_on(docs, read(spark, sf_dir, "labels"))
    scored = tox.score_documents(docs, net, id_col="mark")
    return without(docs, scored.where("predicted = 1")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = marked(docs)
    joined = write_result(lambda: jaccard_join(docs, id_col="mark").where("n_shingles > 0"), "near_components")
    # components of several rows: their ids, by the mark
    several = joined.groupBy(F.col("component_id").alias("c")).count().where("count > 1").select("c")
    several = write_table(several, "several")
    members = joined.join(several, F.col("component_id") == F.col("c")).groupBy("doc_id", "component_id").count()
    ids = docs.select(F.col("doc_id").alias("id"), "mark").distinct()
    members = write_table(members.join(ids, F.col("doc_id") == F.col("mark")), "near_members")
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("mark"))
    best = members.groupBy(F.col("component_id").alias("c")).agg(F.min(order)["mark"].alias("best"))
    judged = members.join(write_table(best, "near_best"), F.col("component_id") == F.col("c"))
    gone = judged.where((F.col("mark") != F.col("best")) | (F.col("count") > 1)).select("doc_id")
    again = judged.where((F.col("mark") == F.col("best")) & (F.col("count") > 1)).select(F.col("mark").alias("again"))
    again = write_table(again, "repeated_rows")
    once = docs.join(again, F.col("mark") == F.col("again"), "left_semi").dropDuplicates(["mark"])  # rows alike in id and text
    return without(docs, gone).unionByName(once).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = marked(docs)
    return without(docs, decontaminate(docs, read(spark, sf_dir, "benchmark"), id_col="mark")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return apply_mix(docs.select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # a smaller memory of words: workers still hold what the stages before them loaded
    return token_output(docs, public_tokenizers.path("byte_bpe_50k.json"), remember=1 << 18).drop("path")


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("tokens", tokens)]

ORACLE_SQL = None  # a trained classifier and a tokenizer are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
