"""What the corpus operators share: reading tables, durable intermediate tables, byte tables for words."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes between words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower case; all are ASCII, so UTF-8 bytes can be split.
_GAPS = {*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)} - {*range(0x41, 0x5B)}
#: bytes.translate table: A-Z to a-z, gaps to a blank.
WORD_BYTES = bytes(32 if b in _GAPS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: bytes.translate table: A-Z to a-z only.
LOWER_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))

BATCH_BYTES = 4 << 20

#: The gaps as a Java/RE2 class, for texts whose A-Z are lower case.
GAP_CLASS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_CLASS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@cache
def _own_dir(application: str) -> str:
    return f"file://{tempfile.mkdtemp(prefix='slantstack-')}"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Where it is unset, a local session gets a temporary folder (tests); any other session must set it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (folder or _own_dir(spark.sparkContext.applicationId)).rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@cache
def scratch_dir(spark: SparkSession, application: str) -> str:
    """Folder of the application's intermediate tables; what is left of it goes when the driver's Python ends."""
    path = f"{shared_dir(spark)}/slantstack-{application}"

    def end() -> None:
        with suppress(Exception):  # the JVM may be gone
            _delete(spark, path)

    atexit.register(end)
    return path


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_deleted(spark: SparkSession):
    """Shuffle files of the queries run here go as soon as these end: their results are in the shared folder."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def durable(df: DataFrame, label: str, *spent: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and lost executors cost nothing.

    ``spent``: durable tables that nothing reads any more; they are deleted once ``df`` is written. A table read back
    also has no partitioning of its own, so joins on it get an exchange that adaptive execution can split where one key is hot.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark, spark.sparkContext.applicationId)}/{label}-{uuid.uuid4().hex}"
    with _shuffles_deleted(spark):
        df.write.parquet(path)
    discard(*spent)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*spent: DataFrame) -> None:
    """Delete durable tables."""
    for df in spent:
        _delete(df.sparkSession, df.scratch)


def small_batches(spark: SparkSession) -> None:
    """At most ``BATCH_BYTES`` of rows go to a Python worker at a time, unless the session has a limit of its own.

    By default it is 10,000 rows whatever their size, which the JVM and the worker both hold.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that only a few texts at a time are Python objects."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def frequent(counts: DataFrame, most: int, key: str) -> DataFrame:
    """The ``most`` rows of ``counts`` (durable; columns n and ``key``) with the greatest n, ties in order of the key's hash.

    A level of n comes from a histogram of 64 steps a doubling; the rows of the step at the limit are told apart by n and
    then by ever longer prefixes of their hash. So the driver never gets more than ``most`` rows, whereas a sorted limit
    sends it that many from every partition.
    """
    hashed = F.xxhash64(key)
    orders = [-F.floor(F.log2("n") * 64).cast("long"), -F.col("n"), *(F.shiftrightunsigned(hashed, 64 - b).bitwiseAND(F.lit(1023)) for b in (10, 20, 30, 40, 50, 60))]
    kept, open_ = F.lit(False), F.lit(True)
    for order in orders:
        cut = None
        for r in sorted(counts.where(open_).groupBy(order.alias("step")).count().collect()):
            if r["count"] > most:
                cut = r["step"]
                break
            most -= r["count"]
        if cut is None:
            return counts.where(kept | open_)
        kept, open_ = kept | (open_ & (order < cut)), open_ & (order == cut)
        if not most:
            break
    return counts.where(kept)


def spare(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def source_key(name: str = "text"):
    """128-bit digest of a text column, null like null: with the id it tells rows apart, equal rows share it."""
    return F.md5(F.coalesce(F.col(name), F.lit("\x00null")).cast("binary"))
