"""What the operators of this subpackage share: tables, the shared folder, written stages."""

from __future__ import annotations

import functools
import gc
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space: space, and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, one of our own, for a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="inkmill-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, and lost executors don't lose it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/inkmill-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.inkmill_path = path
    return back


def removed(df: DataFrame) -> None:
    """Deletes what written() wrote for df; later reads of df fail."""
    path = getattr(df, "inkmill_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that extra columns can't clash with those an operator adds."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def row_key(*names: str) -> Column:
    """A hash of the named columns, nulls told apart: rows with the same key are alike in them."""
    return F.xxhash64(*[x for n in names for x in (F.col(n).isNull(), F.col(n))])


#: What tells rows of documents apart: those alike in these are interchangeable.
ROW = ("doc_id", "text", "lang", "source")


#: The columns of documents that stages work on.
KNOWN = (*ROW, "n_chars")


def carried(*made: str) -> Callable:
    """A stage of documents, so that columns of any other names stay with their rows and can't clash with its own: they travel as one struct. Columns named in made are the stage's to make; docs' own of these names go."""

    def wrap(stage: Callable) -> Callable:
        @functools.wraps(stage)
        def whole(docs: DataFrame, *args, **named) -> DataFrame:
            names = [c for c in docs.columns if c not in made]
            others = [c for c in names if c not in KNOWN]
            packed = [F.struct(*[F.col(f"`{c}`").alias(c) for c in others]).alias("others")] if others else []
            out = stage(docs.select(*[c for c in names if c in KNOWN], *packed), *args, **named)
            return out.select(*[F.col(c) if c in KNOWN else F.col("others")[c].alias(c) for c in names], *[c for c in out.columns if c in made])

        return whole

    return wrap


def numbered(docs: DataFrame, *names: str) -> DataFrame:
    """docs with _key, the row_key() of names, and _n, which numbers rows of the same key from 1."""
    docs = docs.withColumn("_key", row_key(*names))
    return docs.withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy(*[n for n in ROW if n in docs.columns and n != "text"])))


def small_enough(df: DataFrame, most_rows: int) -> bool:
    """Whether df has most_rows at most; reads no more than that."""
    return df.limit(most_rows + 1).count() <= most_rows


def free(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of jobs whose result is written: it learns of them by garbage collection, first of Python's references, then of the JVM's. It only saves disk; a local run needs none of it."""
    if spark.sparkContext.master.startswith("local["):
        return
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)
