"""Tables in the folder that the driver and all executors share.

Cutting lineage means writing Parquet there and reading it back, so a lost
executor loses nothing that was finished. Operators work inside ``scratch()``,
so that only what their results still read stays on disk.
"""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables made in the ``scratch()`` block that is open, of each thread for itself.
OPEN: contextvars.ContextVar[list[Stored] | None] = contextvars.ContextVar("open", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where that is unset, a local folder for a local master and an error for any other."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="cytoloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/cytoloom/{label}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place))


class Stored:
    """A table written to the shared folder: ``df`` reads it, ``drop()`` deletes it.

    One made inside ``scratch()`` goes at the end of that, unless it is to last;
    one that lasts goes when the process ends.
    """

    def __init__(self, df: DataFrame, label: str, lasting: bool = False):
        self.spark = df.sparkSession
        self.path = new_path(self.spark, label)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        tables = OPEN.get()
        if tables is not None and not lasting:
            tables.append(self)
        atexit.register(delete, self.spark, self.path)

    def drop(self) -> None:
        delete(self.spark, self.path)


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Tables stored inside that are not to last are deleted at the end."""
    outer = OPEN.set([])
    try:
        yield
    finally:
        for table in OPEN.get():
            table.drop()
        OPEN.reset(outer)


def result(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to last, so that what it was made from can go."""
    return Stored(df, label, lasting=True).df


#: Bytes of a table that may be broadcast, as its rows and values are counted.
BROADCAST = 16 << 20


def beside(table: DataFrame, values: Column | None = None) -> DataFrame:
    """``table`` with the hint to join it to a much larger one: broadcast if its size, counted first, is bounded,
    else the side that a shuffled join holds in memory, so that the larger one is not sorted. ``values``: numbers in a row's arrays."""
    n, more = table.agg(F.count(F.lit(1)), F.sum(values if values is not None else F.lit(0))).first()
    return table.hint("broadcast" if 32 * n + 8 * (more or 0) <= BROADCAST else "shuffle_hash")


def without(docs: DataFrame, verdicts: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``docs`` whose id has a true ``kept`` in ``verdicts`` (doc_id, kept); the columns as they are.

    Only the ids that go are written and joined. While they are few, texts stay where they are.
    """
    gone = verdicts.groupBy(F.col("doc_id").alias("gone")).agg(F.max("kept").alias("kept")).where(~F.col("kept")).select("gone")
    gone = beside(result(gone, "gone"))
    return docs.join(gone, docs[f"`{id_col}`"].eqNullSafe(gone["gone"]), "left_anti")
