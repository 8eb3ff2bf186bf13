"""What the text operators share: table reading, Arrow helpers, the shared checkpoint folder, connected components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

#: An Arrow batch of texts has at most so many rows and, but for a longer row alone, so many bytes.
BATCH_ROWS, BATCH_BYTES = 4000, 8_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    limit_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def limit_batches(spark: SparkSession) -> None:
    """Have Spark cut the batches that it sends to Python; whoever calls operators directly may do so too."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def cut(batches: Iterator[pa.RecordBatch], most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most `most` bytes, whatever the session's limits; a longer row is a piece of its own."""
    for b in batches:
        parts = min(b.num_rows, -(-b.nbytes // most))
        if parts < 2:
            yield b
            continue
        size = np.zeros(b.num_rows, np.int64)
        for c in b.columns:
            if pa.types.is_string(c.type) or pa.types.is_binary(c.type):
                size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
            else:
                size += c.nbytes // b.num_rows
        stop, i = np.cumsum(size), 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(stop, (stop[i - 1] if i else 0) + most, side="right")))
            yield b.slice(i, j - i)
            i = j


_held: dict[Hashable, Any] = {}


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """What make() built, kept in this worker process until another operator's function runs in it."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


#: Bytes of a worker from which what it no longer uses is worth giving back.
RESIDENT = 200_000_000


def release(least: int = RESIDENT) -> None:
    """Give the system back what is free. Spark keeps its workers between tasks, and the allocators keep what they had.

    least: bytes that the process has from which it is done.
    """
    try:
        with open("/proc/self/statm") as f:
            if int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") < least:
                return
    except OSError:
        pass
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable) -> Callable:
    """A function of one or two arguments for applyInArrow, after which the worker holds nothing that it used."""

    def call(*args: Any) -> pa.Table:
        _held.clear()
        try:
            return run(*args)
        finally:
            release()

    # Spark tells the kinds of functions apart by their number of arguments
    return (lambda x: call(x)) if run.__code__.co_argcount == 1 else (lambda x, y: call(x, y))


def pieces(run: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], holds: bool = False) -> Callable:
    """A function for mapInArrow from one of a bounded batch. holds: it uses held()."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not holds:
            _held.clear()
        try:
            for b in cut(batches):
                yield from run(b)
        finally:
            release()

    return inner


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local session that names none gets a folder of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: the executors need a folder that they share")
        at = tempfile.mkdtemp(prefix="cadenza-checkpoint")
        atexit.register(shutil.rmtree, at, True)
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _path(spark: SparkSession, at: str) -> tuple:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def goes_at_exit(spark: SparkSession, at: str) -> None:
    """Have the driver's file system remove a folder when the session's JVM ends: lazy results may read it until then."""
    path, fs = _path(spark, at)
    fs.deleteOnExit(path)


def on_disk(df: DataFrame) -> DataFrame:
    """df on the executors' disks once it is made, for tables that are used again; what a lost executor had is made again.

    Lazy results may read it, so it stays until whoever asked for it calls unpersist() or clears the session's cache.
    """
    return df.persist(StorageLevel.DISK_ONLY)


#: Bytes that a file of a narrow table should have at least.
FILE_BYTES = 32_000_000


def write_out(df: DataFrame, name: str, most_bytes: float | None = None) -> DataFrame:
    """df written to the shared folder and read back: lineage ends here, and a lost executor costs one task at most.

    most_bytes: what the table has at most, of a narrow one; it then gets few files, not one for each shuffle partition.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if most_bytes is not None:
        df = df.coalesce(max(1, int(-(-most_bytes // FILE_BYTES))))
    df.write.parquet(at)
    goes_at_exit(spark, at)
    return spark.read.schema(df.schema).parquet(at)


def drop_out(df: DataFrame) -> None:
    """Remove the files that write_out made for df, when nothing lazy reads them any more."""
    spark = df.sparkSession
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        path, fs = _path(spark, f)
        fs.delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Have the driver collect its garbage, upon which Spark removes the shuffle files of steps that nothing refers to.

    They would stay on the executors' disks until the driver happens to need memory. What is free then goes back to the
    system, of the driver's Python and of its JVM. For the end of a large eager step.
    """
    gc.collect()
    spark._jvm.System.gc()
    release(0)
    trim_jvm(spark)


def trim_jvm(spark: SparkSession) -> bool:
    """Have the driver's JVM give back what its native allocator keeps: some 200 MB after many plans.

    By the JVM's own command, which the managed beans of 17.0.19 on Linux offer; where there is none nothing happens. The bean
    server's class is not open to py4j, so the call goes through its interface.
    """
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    try:
        kind = jvm.java.lang.Class.forName
        given, types = gateway.new_array(jvm.java.lang.Object, 4), gateway.new_array(jvm.java.lang.Class, 4)
        values = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap", gateway.new_array(jvm.java.lang.Object, 0), gateway.new_array(jvm.java.lang.String, 0)
        names = "javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"
        for i in range(4):
            given[i], types[i] = values[i], kind(names[i])
        kind("javax.management.MBeanServer").getMethod("invoke", types).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:  # another JVM, or one that lets nobody do this
        return False
    return True


def unused(df: DataFrame, name: str) -> str:
    """A column name that df has not, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def strings(batch: pa.RecordBatch, name: str) -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def utf8_lists(col: pa.Array) -> tuple[bytes, np.ndarray]:
    """The bytes of a string column end to end (null: empty), and n+1 offsets."""
    col = col.fill_null("") if col.null_count else col
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if len(col) == 0:
        return b"", np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    raw = b"" if data is None else data.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes()
    return raw, offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place on a copy."""
    x = x.copy()
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def components(edges: DataFrame, a: str = "a", b: str = "b", edges_about: int | None = None) -> DataFrame:
    """Connected components of an edge list: (node, component), component the smallest node reached.

    edges_about: about how many edges there are, for the number of files of the first round.

    Alternates large-star and small-star steps, each one grouped minimum and one join-free flat map, until the edge set is
    a set of stars. The state is written to the shared folder each round; only one count per round comes to the driver. A
    round never adds edges, and the rounds grow as the square of the logarithm of the edges at most.
    """

    def state(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = write_out(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges", edges_about and 16 * edges_about)
    was = state(e)
    while was[0]:
        # large star: every neighbour larger than u links to the least neighbour of u
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(m, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every neighbour not larger than u, and u itself, link to the least of them
        ms = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(ms, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("s")).select("s.u", "s.v").where("u <> v").distinct()
        new = write_out(small, "edges", 16 * was[0])
        drop_out(e)
        e, before, was = new, was, state(new)
        if was == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct().toDF("node", "component"))
