"""A training corpus from raw documents: five stages, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. What a stage returns is written as Parquet and read again before the next; tables that
an operator wrote on its way, and a stage's own once its successor is written, are deleted from the shared folder.

Defined results: a null text is scored as one without words, has no near copies and no repeats, and is packed as
its end id; rows with a null id or a repeated one are rows like others; equal rows are near copies of each other; an
empty table gives no piece; further columns stay through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelkeel.llm.common import delete_table, scratch_tables, staged
from voxelkeel.llm.jaccard import keep_one_of_each
from voxelkeel.llm.mixing import mix_documents, repeat_by_copies
from voxelkeel.llm.packing import pack_documents
from voxelkeel.llm.quality import keep_good
from voxelkeel.llm.subdedup import remove_repeats


def drop_bad_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by similar five-word shingle sets one stays."""
    return keep_one_of_each(docs, n=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; n_chars follows the text."""
    cut = remove_repeats(docs)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cut.select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that languages come nearer to equal shares; none is made rarer."""
    return repeat_by_copies(mix_documents(docs, least_rate=1.0), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 ids."""
    return pack_documents(docs)


STAGES = [
    ("quality", drop_bad_quality),
    ("near_copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("mixing", mix_languages),
    ("packing", pack_sequences),
]

#: Three stages learn or pack with Python, so no SQL states the result.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch_tables(spark) as inner:
            docs = staged(stage(spark, docs, sf_dir), name)
            written = inner.pop()  # the stage's own table stays for its successor
        if before is not None:
            delete_table(spark, before)
        before = written
    return docs
