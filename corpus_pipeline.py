"""The corpus pipeline: language ID, near-duplicates, decontamination, secrets, mixing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next one's ``docs``. All but the last return the columns of
``documents``. Every stage works on all rows that its predecessor kept:

1. documents whose language can't be told (no letter, no text, or no learned language that scores enough) go;
2. of each near-duplicate group the row with the smallest id stays;
3. documents that hold a benchmark item go;
4. secrets are replaced by a mask, the documents stay;
5. documents that the mix takes come out with how often (``copies``) and with how many words (``taken``).

Every stage decides by row: where ids are null or repeat, stages 2 and 3 number the rows first. A row whose
doc_id is null stands for its near-duplicate group only if that has no other id; among equal ids the row with the
smallest content hash does. Columns beside those of ``documents`` are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.llm import decontaminate, langid, mixing, secrets, simhash
from tickframe.llm.common import cut, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised."""
    return langid.recognised(docs, langid.train(docs))


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a column that names each of them, and its name: doc_id if that does, else a number.

    Numbers are written down with the rows, so that a second reading can't give others.
    """
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs, "doc_id"
    name = "row_number"
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return cut(docs.withColumn(name, F.monotonically_increasing_id())), name


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first row of every near-duplicate group."""
    rows, key = numbered(docs)
    groups = cut(simhash.near_duplicates(rows, id_col=key))
    if key == "doc_id":
        first = groups.where("doc_id = component_id or component_id is null").select(F.col("doc_id").alias("first_id"))
    else:
        columns = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
        order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), F.xxhash64(columns), key)
        ranks = rows.select(F.col(key).alias("member_id"), order.alias("place"))
        placed = groups.join(ranks, F.col("doc_id") == F.col("member_id"))
        first = placed.groupBy("component_id").agg(F.min_by("doc_id", "place").alias("first_id"))
    first = first.select("first_id")
    return rows.join(first, rows[key].eqNullSafe(first["first_id"]), "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    rows, key = numbered(docs)
    leaks = decontaminate.leaks(rows, table(spark, sf_dir, "benchmark"), id_col=key).select(F.col("doc_id").alias("leak_id"))
    return rows.join(leaks, rows[key].eqNullSafe(leaks["leak_id"]), "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets in the texts."""
    return secrets.redacted(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with size, target of their source, copies and words taken."""
    return mixing.mix(docs).where("copies > 0").select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("language_id", language),
    ("simhash_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
]

#: Not expressible in SQL: the kernel classifier and the alignment scores; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
