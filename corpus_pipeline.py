"""A corpus pipeline: quality classifier, quality rules, line dedup, near-dedup, packing.

Each stage takes all that the stage before it kept; what it decides takes effect on the rows it returns.
Quality classifier: documents that it rejects go.  Quality rules: documents that they reject go.  Line dedup:
later repeated runs of lines go, and documents of which nothing is left.  Near-dedup: of each component the
document with the smallest id stays (five-word shingles, similarity 0.8).  Packing: every piece gets its place.

A verdict holds for its row alone, whatever other rows have its id: the classifier and the rules judge each row where
it is read, and near-dedup numbers rows by their file and their place in it, which every reading finds again.

Rows: null and empty texts are scored like others by the classifier, and what it keeps of them the quality rules
reject (fewer than ten words); texts are taken whole at any length; rows without an id are judged as all others, and
in near-dedup they come after those with one; of rows that repeat an id, or an id and a text, the one with the
smallest number comes first, so of exact repeats one row stays; ties in near-dedup are decided by the smaller id; an
empty table gives an empty result; other columns are kept up to packing, whatever their names (but those that start with ``__``), and
of those of the documents only doc_id and text must be there.  Tables that a stage has saved are deleted when its
own result is written.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canopy.llm import lines, neardup, packing, quality, repeats
from canopy.llm.queries import PACK_TOKENIZER
from canopy.llm.store import drop, keep, save, scratch

ROW = "__row"
#: Row numbers up to this count may be broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Files up to this count are numbered by a broadcast table of their names; rows of more are numbered in a written copy.
BROADCAST_FILES = 100_000


def _numbered(docs: DataFrame) -> DataFrame:
    """The documents with a number of each row that doesn't change when they are read again."""
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    except AnalysisException:  # not a table of files
        return _numbered_copy(docs)
    files = save(placed.select("__file").distinct(), "files")
    if files.count() > BROADCAST_FILES:
        return _numbered_copy(docs)
    number = files.select("__file", (F.row_number().over(Window.orderBy("__file")) - 1).cast("long").alias("__number"))
    number = save(number, "files")
    return placed.join(F.broadcast(number), "__file").withColumn(ROW, F.shiftleft("__number", 40) + F.col("__at")).drop("__file", "__at", "__number")


def _numbered_copy(docs: DataFrame) -> DataFrame:
    return save(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def _without(rows: DataFrame, rejected: DataFrame) -> DataFrame:
    """The documents whose number isn't among ``rejected``; few are rejected, so those are what is joined."""
    gone = save(rejected.select(F.col("row").alias(ROW)), "rejected")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return rows.join(gone, ROW, "left_anti").drop(ROW)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeats.keep_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    had = docs.columns  # may have a column n_deleted of its own
    out = lines.dedup_lines(docs.withColumnsRenamed({"n_deleted": "__n_deleted"})).filter("n_deleted = 0 or text rlike '[^ \\\\t-\\\\r]'")
    if "n_chars" in had:
        out = out.withColumn("n_chars", F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.drop("n_deleted").withColumnsRenamed({"__n_deleted": "n_deleted"}).select(*had)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _numbered(docs)
    found = neardup.near_duplicates(rows, id_col=ROW)
    later = found.filter("not kept").select(F.col("doc_id").alias(ROW), F.col("component_id").alias("component"))
    member = save(later.union(later.select("component", "component").distinct()), "members")  # of components of several rows
    order = F.struct(F.col("doc_id").isNull(), "doc_id", ROW)
    stays = rows.select(ROW, "doc_id").join(member, ROW).groupBy("component").agg(F.min_by(ROW, order).alias(ROW))
    return _without(rows, member.join(stays, ROW, "left_anti").select(F.col(ROW).alias("row")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, PACK_TOKENIZER)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("best-fit packing", best_fit_packing),
]
#: No stage can be written in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn; what a stage returns is written as Parquet and read as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch(spark):
            after = keep(save(stage(spark, docs, sf_dir), name.replace(" ", "-")))
        drop(docs)
        docs = after
    return docs
