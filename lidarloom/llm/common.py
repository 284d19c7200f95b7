"""Helpers that the text operators share."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
#: The blanks that part words in every contract: space and U+0009 to U+000D.
BLANKS = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package where they see the driver's path (else use --py-files)."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and goes on from there, whatever executors are lost."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names; a folder of this machine only if there is no other machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and not spark.sparkContext.master.partition("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or tempfile.mkdtemp(prefix="lidarloom-")


#: Tables of cut_table() that this session still has.
_tables: list[str] = []


def cut_table(df: DataFrame) -> DataFrame:
    """As cut(), for large tables: written as Parquet into the shared folder, which is smaller, and removed by drop_tables() or when the session ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/lidarloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    _tables.append(path)
    return spark.read.parquet(path)


def drop_tables(spark: SparkSession, since: int = 0) -> None:
    """Removes the tables cut after the first since ones. For a caller that has written what it wanted from them."""
    for path in _tables[since:]:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    del _tables[since:]
    release(spark)


def n_tables() -> int:
    return len(_tables)


def release(spark: SparkSession) -> None:
    """Asks Spark to drop what nothing refers to any more, so that shuffle files of finished steps don't pile up."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def let(value: Column, body) -> Column:
    """body(value), where value is evaluated once for each row however often body uses it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Array of the words of a text; a null or blank text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, mod by: the fold of a document. A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(by))


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that df hasn't (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def smallest_hashes(df: DataFrame, key: Column, most: int) -> DataFrame:
    """About most rows of df at most: those whose key hash is among the smallest. Bounded, repeatable, free of order.

    Only hash values reach the driver (8 * most bytes). Equal rows share a hash: ties are kept whole unless that exceeds 2 * most rows.
    """
    found = [r[0] for r in df.select(key.alias("h")).orderBy("h").limit(most).collect()]
    if len(found) < most:
        return df
    return df.where(key <= F.lit(found[-1])).limit(2 * most)
