"""What several operators share: tables in the shared folder, and null-safe texts."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.session import prepared

#: The white space that separates words in the contracts: U+0020 and U+0009 to U+000D.
SPACES = r" \t-\r"

_own: dict[str, str] = {}
#: Tables of ``materialize`` that this process has written and not deleted.
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Only a local master, as in tests, may leave it
    unset; a cluster without it is an error, since a machine-local folder would lose data there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="quillspark-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return _own["dir"]


def materialize(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: lineage ends in files that any executor can reread."""
    spark = prepared(df.sparkSession)
    path = f"{shared_dir(spark)}/quillspark/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table of ``materialize`` that no later plan reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if path in _written:
        _written.remove(path)


def written() -> list[str]:
    """The tables of ``materialize`` that are there now."""
    return list(_written)


def sweep(spark: SparkSession, keep: list[str]) -> None:
    """Delete the tables of ``materialize`` but those in ``keep``: for a caller who has written what it needs of their results."""
    for path in written():
        if path not in keep:
            drop(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def tidy(run):
    """A function over batches that gives its worker's unused memory back when it ends: workers stay, beside the executor's own memory."""

    def wrapped(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return wrapped


def boxed(docs: DataFrame, **columns) -> DataFrame:
    """``docs`` with each row in one struct column ``row`` beside ``columns``, so that no column of ``docs`` can clash with these; ``row.*`` unpacks it."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(e.alias(n) for n, e in columns.items()))
