"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of an Arrow batch that goes to a Python worker; long texts make smaller batches.
BATCH_ROWS, BATCH_BYTES = 10_000, 8 << 20


def configured(spark: SparkSession) -> SparkSession:
    """Bounds the Arrow batches, so that a worker's memory does not depend on text lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The columns of the table documents; doc_id and text if none are named."""
    return configured(spark).read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


def parallelism(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the cluster's session is set."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where it is unset and all runs in
    one process. Raises on a cluster without the setting."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="trackloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def stored(df: DataFrame, what: str, compression: str = "snappy") -> DataFrame:
    """df, written as Parquet to the shared folder and read again: cuts the lineage and survives lost executors.

    The files go when the driver's process ends, or by discard().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/trackloom/{what}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", compression).parquet(path)
    atexit.register(_removed, spark, path)
    out = spark.read.schema(schema).parquet(path)
    _STORED[id(out)] = (weakref.ref(out), path)
    return out


#: Where stored tables are, by the identity of the DataFrame.
_STORED: dict[int, tuple[weakref.ref, str]] = {}


def discard(df: DataFrame) -> None:
    """Removes the files of a table from stored() that nothing reads any more; other tables stay as they are."""
    known, path = _STORED.pop(id(df), (lambda: None, ""))
    if known() is df:
        _removed(df.sparkSession, path)


def of_classes(rows: DataFrame, classes: DataFrame, keys: dict[str, str], size: str = "n") -> DataFrame:
    """rows with the columns of their class; keys: rows' columns and those of classes (no name in common), unique there.

    size is how many rows a class has. A class of over a quarter of a partition's fair share goes to all tasks (there are
    at most four times as many as partitions), so that its rows are not moved; the others meet by a shuffle.
    """
    width = parallelism(rows.sparkSession)
    fair = max(1, rows.count() // (4 * width))
    on = lambda right: [rows[a] == right[b] for a, b in keys.items()]
    hot, others = F.broadcast(classes.where(F.col(size) > fair)), classes.where(F.col(size) <= fair)
    rest = rows.join(hot.select(*keys.values()), on(hot), "left_anti")
    return rows.join(hot, on(hot)).unionByName(rest.join(others, [rest[a] == others[b] for a, b in keys.items()]))


def _removed(spark: SparkSession, path: str) -> None:
    jvm = getattr(spark, "_jvm", None)
    if jvm is None or spark.sparkContext._jsc is None:
        return
    with contextlib.suppress(Exception):  # the session may be gone already
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def texts_of(column: pa.Array) -> list[bytes]:
    """A column of texts as UTF-8 bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def keyed(docs: DataFrame) -> DataFrame:
    """(_k long, doc_id, text): _k is unique and ascends with doc_id.

    It is doc_id where that is unique and never null. Otherwise rows are numbered by (doc_id, text), nulls first, so
    that rows of one doc_id count as documents of their own in the order of their texts; the numbered rows are stored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    twice = docs.select("doc_id").groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count()
    if not twice:
        return docs.select(F.col("doc_id").alias("_k"), "doc_id", "text")
    n = parallelism(docs.sparkSession)
    numbered = docs.repartitionByRange(n, "doc_id", "text").sortWithinPartitions("doc_id", "text")
    return stored(numbered.select(F.monotonically_increasing_id().alias("_k"), "doc_id", "text"), "keyed")


def free_name(columns: list[str], name: str) -> str:
    """name, with underscores before it until no column has it, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def with_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with one more column, and its name: a unique long that ascends with doc_id (see keyed())."""
    key = free_name(docs.columns, "row_key")
    twice = docs.select("doc_id").groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count()
    if not twice:
        return docs.withColumn(key, F.col("doc_id").cast("long")), key
    n = parallelism(docs.sparkSession)
    return stored(docs.repartitionByRange(n, "doc_id", "text").sortWithinPartitions("doc_id", "text").withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def with_text(docs: DataFrame, text: Column) -> DataFrame:
    """docs with another text and, where there is such a column, its count of characters."""
    docs = docs.withColumn("text", text)
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


#: What drops a worker's caches, by the work that they are for; and the work that the worker did last.
CACHES: dict[str, Callable[[], None]] = {}
_LAST = [""]


def turn(work: str) -> None:
    """Called where a task begins: a worker that turns to other work drops the caches of what it did before."""
    if _LAST[0] != work:
        for name, drop in CACHES.items():
            if name != work:
                drop()
        gc.unfreeze()
        gc.collect()
        trim()
        _LAST[0] = work


def trim() -> None:
    """Gives freed memory back to the system, where the C library can."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def trimming(run: Callable) -> Callable:
    """run, a function for mapInArrow, that leaves no freed memory behind: workers stay when their task is over."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return whole


@contextlib.contextmanager
def without_cycles(keep: bool = False) -> Iterator[None]:
    """For work that makes many objects and no cycles: the collector doesn't walk through them meanwhile, nor (keep)
    later."""
    gc.disable()
    try:
        yield
    finally:
        if keep:
            gc.freeze()
        gc.enable()


def reuse_freed() -> None:
    """For work on many arrays of some MB: freed memory stays with the process until trim(), where the C library can."""
    with contextlib.suppress(OSError, AttributeError):
        c = ctypes.CDLL(None)
        c.mallopt(-3, 64 << 20)  # M_MMAP_THRESHOLD
        c.mallopt(-1, 256 << 20)  # M_TRIM_THRESHOLD


def put(batch: pa.RecordBatch, keep: list[str], **columns: pa.Array) -> pa.RecordBatch:
    """The columns keep of batch, then the given ones."""
    return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep] + list(columns.values()), [*keep, *columns])
