"""Helpers shared by the training-data operators: shared storage, iteration, text access."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share; a private one is set only where none is configured and all run in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tesserae-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 4 MB where the session has Spark's default of 64: whole texts are long. It stays set, since frames run later."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("67108864b", "64MB"):
        spark.conf.set(name, "4m")


_MADE: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A folder's name in the shared folder. Frames that operators return read their last folders when they run; `remove_made` takes them away
    once a caller has written what it wants."""
    _MADE.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def made() -> int:
    """How many folders there have been."""
    return len(_MADE)


def remove_made(spark: SparkSession, since: int, *keep: str) -> None:
    """Deletes the folders made since, but for some."""
    gone = [p for p in _MADE[since:] if p not in keep]
    remove(spark, *gone)
    _MADE[since:] = [p for p in _MADE[since:] if p in keep]


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders through Hadoop's file system, so that any store works."""
    jvm = spark._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame, name: str, few: bool = False) -> tuple[DataFrame, str]:
    """Write a frame to the shared folder and read it back: lineage ends there, on replicated storage.
    few: rows are few beside the corpus, so Spark may deal them to fewer files, by their bytes."""
    spark = df.sparkSession
    path = new_path(spark, name)
    if few:
        df = df.hint("rebalance")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def released() -> None:
    """Gives memory that a finished task held back to the system: idle Python workers stay for a while."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def driver_released(spark: SparkSession) -> str | None:
    """Gives memory that the driver held back to the system: garbage, with the shuffle files of finished steps, which go with it, and what the
    JVM's allocator keeps of finished compilations. What the JVM says of the latter; None if it can't do it."""
    gc.collect()
    jvm = spark._jvm
    jvm.System.gc()
    try:
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        return call.invoke(server, args)
    except Py4JError:  # other JVMs and systems
        return None


def texts(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column without decoding."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def bit_test(keys: Column, rows: DataFrame, most_bits: int):
    """A test, in the JVM, that every value of `keys` in `rows` passes and few others do: a Bloom filter with two bits a value and 16 bits of room for
    each, 2^most_bits at most (beyond that it lets more values through, and what follows decides). The driver holds its bits. None if there
    are no rows."""
    n = rows.count()
    if not n:
        return None
    bits = min(most_bits, max(10, (16 * n - 1).bit_length()))

    def spots(value: Column) -> tuple[Column, Column]:
        h = F.xxhash64(value)
        return F.pmod(h, F.lit(1 << bits)).cast("int"), F.pmod(F.shiftright(h, 32), F.lit(1 << bits)).cast("int")

    held = rows.select(F.explode(F.array(*spots(keys))).alias("h"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("h", F.lit(64)).cast("int"))
    words = ["0"] * (1 << (bits - 6))
    for r in held.select(F.shiftright("h", 6).alias("i"), bit.alias("b")).groupBy("i").agg(F.bit_or("b").alias("b")).collect():
        words[r["i"]] = str(r["b"])
    array = F.split(F.lit(",".join(words)), ",").cast("array<long>")  # folded into one literal

    def test(value: Column) -> Column:
        one, two = (F.getbit(F.get(array, F.shiftright(h, 6)), F.pmod(h, F.lit(64)).cast("int")) == 1 for h in spots(value))
        return one & two

    return test


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_mod(column: str, n: int):
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(n)
