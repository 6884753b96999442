"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the docs of the next. All but the last return
the columns of ``documents``. A document is known by its id and a hash of its
text, so rows that share an id are judged apart, and rows of equal id and text
alike.

Defined results: a null text is an empty one; empty texts are scored like any
other, are copies of one another, contain no benchmark window and have the
size 0, so a source's mixture may leave them out; a null id stands behind all
others; of rows with equal id and text the first in the order of their other
columns stays, as text, so a rerun or another order of the rows keeps the same;
an empty table gives empty tables; further columns are kept, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import decontaminate, line_crf, mixing, simhash, token_files
from quarryline.llm.shared import discard, fresh, written

#: SQL cannot express the classifier, the near-duplicate components or the tokenizer.
ORACLE_SQL = None
NO_ID = 2**63 - 1


def _keyed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` and two further columns, their names returned: the id and a hash of the text."""
    names = [fresh(docs, "__id"), fresh(docs, "__text")]
    return docs.select("*", F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias(names[0]), F.xxhash64("text").alias(names[1])), names


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field scores below one half go."""
    model, name = line_crf.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), fresh(docs, "__score")
    return line_crf.score(docs, model, keep=tuple(docs.columns), score_col=name).where(F.col(name) >= 0.5).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents (5-word shingles, similarity 0.8 or more), the row with the smallest id stays; of equal rows, one."""
    keyed, names = _keyed(docs)
    rows = simhash.similar_documents(keyed.select("text", *names), tuple(names))
    kept = written(rows.groupBy("component").agg(F.min(F.struct(*names)).alias("first")).select("first.*"), "dedup-kept")
    order, first = fresh(keyed, "__order"), fresh(keyed, "__first")
    others = [F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(docs.columns) if c.lower() != "text"]
    ordered = keyed.withColumn(order, F.to_json(F.struct(*others)))
    least = written(ordered.select(*names, order).join(kept, names, "left_semi").groupBy(*names).agg(F.min(order).alias(first)), "dedup-least")
    # joined by the names alone, so that equal rows meet in the same partition and the texts are shuffled once
    return ordered.join(least, names).where(F.col(order) == F.col(first)).dropDuplicates(names).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a window of a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed, names = _keyed(docs)
    marked = keyed.select(F.struct(*names).alias("key"), "text")
    found = decontaminate.contamination(marked, items, id_col="key").where("contaminated").select("doc_id.*").distinct()
    return keyed.join(written(found, "contaminated"), names, "left_anti").select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it."""
    return mixing.mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files' rows: doc_id, start, n_tokens, ids_crc32."""
    return token_files.tokenize(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
