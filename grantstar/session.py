"""Session set-up and the folder for written intermediate tables."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Callable, Container, Iterable
from concurrent.futures import ThreadPoolExecutor
from threading import Lock
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from grantstar.operators.keyed import KeyFacts, repeated_keys

# Runtime settings every plan here counts on. A key that holds a third of all rows must not end
# in one task: skewed joins are split even where that costs one more shuffle further down.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}

# Fixed when a session starts. The call-site record of every column expression costs more than
# planning does for plans built from many expressions.
START_CONF = {"spark.python.sql.dataFrameDebugging.enabled": "false"}

#: Shuffled bytes that one task takes, at any size of the input. Rows of ids are packed to a few bytes and sorted or
#: hashed as a hundred, several times over in a stage of joins on one key.
TASK_SHARE = 16 << 20
_SHARE_KEY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
_PARTS_KEY = "spark.sql.shuffle.partitions"


def tune(spark: SparkSession) -> SparkSession:
    """Apply ``RUNTIME_CONF`` to a session that somebody else has built.

    The session keeps these settings, the time zone UTC among them: plans are lazy, so they must still
    hold when a result is fetched later.
    """
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return share_out(spark)


def share_out(spark: SparkSession, input_bytes: int = 0) -> SparkSession:
    """Lower the bytes that a shuffle hands to one task to ``TASK_SHARE``, and raise the number of partitions so that each
    has no more than that of an input of so many bytes. A session with smaller shares, or more of them, keeps its own."""
    share = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_SHARE_KEY))
    if share > TASK_SHARE:
        spark.conf.set(_SHARE_KEY, f"{TASK_SHARE}b")
    if (parts := -(-input_bytes // TASK_SHARE)) > int(spark.conf.get(_PARTS_KEY)):
        spark.conf.set(_PARTS_KEY, str(parts))
    return spark


def build_session(app: str = "grantstar", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; ``conf`` keys are written with ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (RUNTIME_CONF | START_CONF).items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return share_out(builder.getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, named in ``spark.checkpoint.dir``.

    A session on one machine may do without and gets a local folder; on a cluster each executor would
    write that to its own disk, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.conf.get("spark.master", "")
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError(f"spark.checkpoint.dir must name a shared folder (master {master})")
    return tempfile.mkdtemp(prefix="grantstar-")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which the file system removes when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    fs, at = _file_system(spark, path)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def files_below(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, bytes, modification time) of the data files at or below a path (or pattern), in order of
    path. A path that does not exist is an error."""
    fs, at = _file_system(spark, path)
    found, roots = [], fs.globStatus(at)
    if not roots:
        raise FileNotFoundError(path)
    for root in roots:
        listing = fs.listFiles(root.getPath(), True)
        while listing.hasNext():
            status = listing.next()
            if not status.getPath().getName().startswith(("_", ".")):
                found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return sorted(found)


def first_line(spark: SparkSession, file: str) -> str:
    """The first line of a text file that is not blank, '' without one."""
    fs, at = _file_system(spark, file)
    codec = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration()).getCodec(at)
    stream = fs.open(at)
    raw = codec.createInputStream(stream) if codec else stream
    reader = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(raw, "UTF-8"))
    try:
        while (line := reader.readLine()) is not None:
            if line.strip():
                return line
        return ""
    finally:
        reader.close()


def parquet_schema(spark: SparkSession, file: str) -> StructType:
    """The schema that the footer of one parquet file declares."""
    _, at = _file_system(spark, file)
    source = spark._jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(at, spark._jsc.hadoopConfiguration())
    reader = spark._jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
    try:
        written = reader.getFooter().getFileMetaData().getKeyValueMetaData().get(_SPARK_SCHEMA)
    finally:
        reader.close()
    if written is None:  # of another writer
        return spark.read.parquet(file).schema
    return StructType.fromJson(json.loads(written))


#: Where Spark's own writer keeps the schema in a footer.
_SPARK_SCHEMA = "org.apache.spark.sql.parquet.row.metadata"


class TableStage:
    """A stage that writes each frame as parquet and reads it back.

    This cuts the lineage at a table that outlives lost executors, and lets several consumers
    read one result in place of computing it once each. With ``names`` only those frames are
    written and the others stay lazy: a frame with one consumer is better not stored. A name is
    written once per stage, also when several threads ask for it. ``close`` removes the tables, once
    nothing reads them any more.
    """

    def __init__(self, spark: SparkSession, root: str, names: Container[str] | None = None):
        self._spark, self.root, self._names = spark, root, names
        self._stored: dict[str, DataFrame] = {}
        self._locks: dict[str, Lock] = {}
        self._facts: dict[tuple[str, str], KeyFacts] = {}

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        if self._names is not None and name not in self._names:
            return df
        return self._store(df, name)

    def _store(self, df: DataFrame, name: str) -> DataFrame:
        with self._locks.setdefault(name, Lock()):
            if name not in self._stored:
                path = f"{self.root}/{name}"
                df.write.mode("overwrite").parquet(path)
                self._stored[name] = self._spark.read.schema(df.schema).parquet(path)
            return self._stored[name]

    def key_facts(self, name: str, key: str) -> KeyFacts | None:
        """What is known of a key of a table that this stage has written, None for any other table. Worked out
        once, from the key column alone; the list of repeated keys is stored like a table."""
        table = self._stored.get(name)
        if table is None:
            return None
        repeated = self._store(repeated_keys(table, key), f"{name}_repeated_{key}")
        with self._locks.setdefault(f"facts of {key} in {name}", Lock()):
            if (name, key) not in self._facts:
                has_null = not table.where(table[key].isNull()).select(key).isEmpty()
                self._facts[name, key] = KeyFacts(repeated, repeated.count(), has_null)
            return self._facts[name, key]

    def close(self) -> None:
        for name in self._stored:
            fs, at = _file_system(self._spark, f"{self.root}/{name}")
            fs.delete(at, True)
        self._stored.clear()
        self._facts.clear()


def table_stage(
    spark: SparkSession, folder: str | None = None, names: Container[str] | None = None
) -> TableStage:
    """A writing stage under ``folder``, by default a new one in the shared folder, removed when the application ends."""
    return TableStage(spark, folder or scratch_folder(spark, "grantstar"), names)


S, T = TypeVar("S"), TypeVar("T")

#: Small requests to the file system that are under way at once.
REQUESTS = 16


def in_parallel(one: Callable[[S], T], items: Iterable[S]) -> list[T]:
    """``one`` of each item, in order; for requests to the file system, which wait more than they work."""
    with ThreadPoolExecutor(REQUESTS) as pool:
        return list(pool.map(one, items))


def concurrently(*tasks: Callable[[], T]) -> list[T]:
    """Run independent Spark actions side by side, so that the tail of one job leaves no idle cores.

    The threads carry the caller's job group. The first error is raised after all have ended.
    """
    inherit = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(len(tasks)) as pool:
        running = [pool.submit(inherit(task)) for task in tasks]
    return [job.result() for job in running]
