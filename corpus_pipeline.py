"""A corpus pipeline: toxicity, line dedup, n-gram dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's documents. All but the last return the
columns of documents, whatever further columns come in, and the last one a row for
each piece of a document. Texts of any length are read whole. Rows that repeat a
doc_id, or have none, are documents of their own unless a stage says otherwise. Empty
tables go through all stages and give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webweft.llm import jaccard_join, line_dedup, mixing, packing, toxicity
from webweft.runtime import materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic, whole and unchanged. Null and empty texts are scored
    by the model's bias; rows alike tie, and stay or go together. Null labels, and labels
    without a document, are not learnt from; without labels every document stays."""
    return toxicity.drop_toxic(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a smaller document holds. Null text stays
    null, and a document without an id keeps its lines; rows that share an id are one
    document. A document of which every line goes stays, with an empty text: which
    documents go is for the filtering stages to say. n_chars is counted anew."""
    kept = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id. Texts that are
    null, empty or without words link with nothing and stay, and so do rows without an id
    and rows that repeat the id that is kept."""
    return jaccard_join.keep_one(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, whole, in the order of the slots in which they begin in the mix.
    A null source is a source of its own; null texts take no room. Documents tie only
    where an empty one begins where its predecessor ended."""
    return mixing.mixed_order(docs.select(*COLUMNS))


def written_order(docs: DataFrame) -> DataFrame:
    """``docs``, read from Parquet files, with ``_position``: the row's number in
    the order of the tasks that wrote them. Only a count a file is collected."""
    file = F.col("_metadata.file_name")
    rows = docs.select(*COLUMNS, file.alias("_file"), F.col("_metadata.row_index").alias("_row"))
    counts = {r[0]: r[1] for r in rows.groupBy("_file").count().collect()}
    first, at = [], 0
    for name in sorted(counts, key=lambda n: (int(n.split("-")[1]), n)):
        first.append((name, at))
        at += counts[name]
    starts = docs.sparkSession.createDataFrame(first, "_file string, _first long")
    return rows.join(F.broadcast(starts), "_file").withColumn("_position", F.col("_first") + F.col("_row")).drop("_file", "_first", "_row")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the training sequences, which
    follow the order in which the mix was written. Null and empty texts are a piece of
    the end id alone."""
    return packing.pack(written_order(docs), position="_position")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Trained scores, local search and token ids are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = materialize(docs, "stage")
    return docs
