"""What the operators share: tables, shared scratch folders, row keys."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Only where all tasks run in the
    driver's own process (a local master, as in tests) may the session name none; a cluster must."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or f"{tempfile.gettempdir()}/seqloom-{sc.applicationId}")
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage by a reliable checkpoint in the shared folder; for narrow tables. It is deleted when
    the application ends."""
    shared_dir(df.sparkSession)
    out = df.checkpoint(True)
    if (held := out._jdf.queryExecution().analyzed().rdd().getCheckpointFile()).isDefined():
        _note(df.sparkSession, held.get())
    return out


def written(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Writes df as compressed Parquet in the shared folder and reads it back: survives lost
    executors, takes less disk than a checkpoint and has a size that Catalyst knows. The folder is
    deleted when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    _note(spark, path)
    return spark.read.schema(df.schema).parquet(path)


_OPEN: list[list[str]] = []


@contextmanager
def collecting() -> Iterator[list[str]]:
    """Notes what is written or checkpointed inside, so that the caller can delete it once it is read."""
    made: list[str] = []
    _OPEN.append(made)
    try:
        yield made
    finally:
        _OPEN.remove(made)


def _note(spark: SparkSession, path: str) -> None:
    atexit.register(_remove, spark, path)
    for made in _OPEN:
        made.append(path)


def remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None or spark.sparkContext._jsc is None:
        return
    try:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the gateway may already be closed when Python ends
        return


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bucket_of(columns: list[Column], n: int | Column) -> Column:
    """A bucket from 0 to n - 1 by hash of the columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(n).cast("long") if isinstance(n, int) else n)
