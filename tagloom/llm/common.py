"""What the training-data operators share: table access and cut lineage."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters that are neither blank nor one of U+0009..U+000D.
BLANKS = r"[\x20\x09-\x0D]+"
_FALLBACK: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session's ``spark.checkpoint.dir`` names.

    Where it is unset, as in local tests, one temporary folder per process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if "dir" not in _FALLBACK:
        _FALLBACK["dir"] = "file://" + tempfile.mkdtemp(prefix="tagloom-")
    return _FALLBACK["dir"]


def releasing(run):
    """run (batches -> batches) for mapInArrow; at its end the worker's free memory goes back to the system.

    Workers outlive tasks and stages, and else keep the most that any task of theirs held."""

    def wrapped(batches):
        some = []

        def noted():
            for batch in batches:
                some[:] = [True]
                yield batch

        yield from run(noted())
        if some:  # many tasks of few rows get none
            release()

    return wrapped


#: What drops the caches that a worker has from other operators.
ON_RELEASE: list = []


def release(others: bool = True) -> None:
    """Give free memory back, and, unless others is false, that of other operators' caches."""
    import ctypes

    import pyarrow as pa

    for drop in ON_RELEASE if others else ():
        drop()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def trim_driver(spark: SparkSession) -> None:
    """Collect the driver's garbage, and give what its JVM and its Python hold free in native memory back to the system.

    The C library keeps what compilers and buffers of hundreds of threads gave back; where the JVM has no command for that, it stays."""
    release(others=False)
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    jvm.System.gc()
    beans = jvm.java.lang.Class.forName("javax.management.MBeanServer")  # the server's own class is closed to reflection
    server, name = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    invoke = next(m for m in beans.getMethods() if m.getName() == "invoke")
    values = array(jvm.java.lang.Object, 4)
    values[0], values[1] = name, TRIM
    try:
        invoke.invoke(server, values)
    except Py4JJavaError:  # no such bean or command
        pass


TRIM = "systemTrimNativeHeap"
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's limits on what is sent to a Python worker at a time, so texts of any length fit in little memory."""
    name = "spark.sql.execution.arrow.max{}PerBatch"
    if int(spark.conf.get(name.format("Records"))) not in range(1, BATCH_ROWS + 1):
        spark.conf.set(name.format("Records"), BATCH_ROWS)
    size = spark.conf.get(name.format("Bytes")).rstrip("b")
    if size.isdigit() and int(size) > BATCH_BYTES:
        spark.conf.set(name.format("Bytes"), BATCH_BYTES)


#: Tables of so many rows at most are written in so many files, or two for each core.
FEW_ROWS, FEW_FILES = 200_000, 24


class Scratch:
    """Tables written to the shared folder to cut lineage.

    A written table survives the loss of executors and is computed once, where
    ``checkpoint()`` would compute its input twice."""

    cleaned = 0.0

    def __init__(self, spark: SparkSession, label: str):
        bounded_batches(spark)
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}", 0
        self.few = False

    def write(self, df: DataFrame, wide: bool = False) -> DataFrame:
        """df as a written table. While ``few`` is set it has few files, unless it is made where much is read (wide).

        Where Hadoop has no native library, each file costs a process (chmod) that shares all memory of the executor as it starts."""
        self.n += 1
        if self.few and not wide:
            df = df.coalesce(max(FEW_FILES, 2 * self.spark.sparkContext.defaultParallelism))
        path = f"{self.root}/{self.n}"
        schema = df.schema
        df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._tagloom_path = path
        self.tidy()
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing still to run will read.

        Spark deletes the shuffle files of finished plans when the driver collects its
        garbage, which a large heap may put off for long; so it is asked to here."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for x in tables:
            if getattr(x, "_tagloom_path", None):
                path = jvm.org.apache.hadoop.fs.Path(x._tagloom_path)
                path.getFileSystem(conf).delete(path, True)
        self.tidy()

    def free(self) -> None:
        """Have the shuffle files of finished plans deleted.

        The JVM is told what the driver's garbage held by a thread that looks once a second."""
        gc.collect()
        time.sleep(1.5)
        trim_driver(self.spark)
        Scratch.cleaned = time.monotonic()

    def tidy(self) -> None:
        """Have the driver's free memory given back, every few seconds."""
        if time.monotonic() > Scratch.cleaned + 5:
            trim_driver(self.spark)
            Scratch.cleaned = time.monotonic()


def fresh(columns, *names: str) -> list[str]:
    """The names with as many underscores before them as make them new among columns (letter case apart)."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def words_of(text):
    """The words of a text as an array; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")
