"""What the operators of this package share: the shared folder, written tables, files on it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset and everything runs on this machine (tests in local
    mode) a folder of this machine is made and set; on a cluster it must be set.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {master})")
        where = "file://" + tempfile.mkdtemp(prefix="quarryline-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    """A path of its own under the shared folder; nothing is created yet."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder, a folder for each value of the columns ``by``, and read it again.

    This cuts the lineage with a copy that outlives any executor, and gives
    the planner the table's true size.
    """
    spark = df.sparkSession
    path = new_folder(spark, what)
    df.write.partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame | str, spark: SparkSession | None = None) -> None:
    """Delete tables that ``written`` returned, or folders; for those that nothing reads any more, lazily either."""
    for df in tables:
        session = spark or df.sparkSession
        path = session._jvm.org.apache.hadoop.fs.Path(df if isinstance(df, str) else df.written_at)
        path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)


def releasing(run):
    """``run``, a function for mapInArrow; what its task has freed goes back to the system in the end, as Python's workers live on and wait."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes

            import pyarrow as pa

            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return wrapped


def open_fs(uri: str):
    """(file system, path) of pyarrow for a URI or a plain path, on any executor."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have; Spark's names differ by more than case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. ``lower`` does that where all is ASCII, and is much faster there."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds
