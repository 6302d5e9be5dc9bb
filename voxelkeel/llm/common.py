"""Helpers the training-data operators share: staging, words as columns, joins with hot keys."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelkeel.session import scratch_folder

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"
#: A key that holds more than one row in this many is joined apart; so many such keys can be at most.
HOT_SHARE = 1000


#: With this set, Spark deletes a query's shuffle files when the query ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Lists of paths that enclosing ``scratch_tables`` blocks will delete.
_OPEN: list[list[str]] = []


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[list[str]]:
    """Tables staged within the block are deleted at its end; what they led to must be written by then."""
    paths: list[str] = []
    _OPEN.append(paths)
    try:
        yield paths
    finally:
        _OPEN.remove(paths)
        for path in paths:
            delete_table(spark, path)


def delete_table(spark: SparkSession, path: str) -> None:
    """Delete a staged table, on whatever file system the shared folder lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the files, which outlive lost executors.

    What was shuffled on the way is not needed again, so its files go at once. The table stays until
    the ``scratch_tables`` block around it ends, if there is one.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    if _OPEN:
        _OPEN[-1].append(path)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column) -> Column:
    """Words of a text, in order; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; the fold of a document."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0))


def join_keeping_hot(left: DataFrame, right: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Left join where a few keys may hold a large part of the left rows.

    ``right`` has one row per ``key`` and the number of left rows in ``weight``. Keys with more
    than one row in ``HOT_SHARE`` of ``total`` are at most ``HOT_SHARE``, so they are broadcast and
    their left rows stay where they are; all other keys are shuffled.
    """
    bound = total / HOT_SHARE
    hot = F.broadcast(right.filter(F.col(weight) > bound).drop(weight).withColumn("_hot", F.lit(True)))
    marked = left.join(hot, key, "left")
    rest = right.filter(F.col(weight) <= bound).drop(weight)
    columns = [c for c in right.columns if c not in (key, weight)]
    cold = marked.filter(F.col("_hot").isNull()).drop("_hot", *columns)
    return marked.filter(F.col("_hot")).drop("_hot").unionByName(cold.join(rest, key, "left"), allowMissingColumns=True)
