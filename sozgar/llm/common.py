"""What several operators share: scratch tables in the shared folder, worker caches, Arrow helpers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches are cut to about so many bytes of text before numpy works on them.
CHUNK_BYTES = 2 << 20
#: Rows of an Arrow batch, where the session has not chosen otherwise; long texts make batches large.
BATCH_ROWS = 1000
_BATCH_KEY, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def bound_batches(spark: SparkSession) -> None:
    """Lowers the rows of an Arrow batch from Spark's default, which lets a batch of texts grow to hundreds of megabytes.

    Spark reads the setting when a frame runs, so it must outlast the call that makes a lazy frame; ``release`` puts
    the default back. A value that the caller has chosen stays.
    """
    if spark.conf.get(_BATCH_KEY, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_KEY, str(BATCH_ROWS))


def give_back() -> None:
    """Returns a worker's freed memory to the system; workers stay alive between tasks."""
    pa.default_memory_pool().release_unused()
    libc = worker_cache("libc", lambda: ctypes.CDLL(None))
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a temporary one on a single machine; on a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="sozgar-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """Tables written under the shared folder to cut lineage; a lost executor costs no recomputation.

    ``drop`` removes tables that no later plan reads, ``close`` all of them. A frame that is returned to the caller
    still reads some: ``release`` removes all scratch tables of the session when the caller has used it.
    """

    def __init__(self, spark: SparkSession, name: str):
        bound_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.names: set[str] = set()
        _OPEN.append(self)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        schema = df.schema
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        self.names.add(name)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.names:
                self.names.discard(name)
                self._delete(f"{self.root}/{name}")

    def keep(self, *names: str) -> None:
        """Drops all tables but these."""
        self.drop(*(self.names - set(names)))

    def sweep(self) -> None:
        """Lets Spark remove the shuffle files of what has been written; it does so when the driver collects its garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def close(self) -> None:
        self._delete(self.root)
        self.names.clear()
        if self in _OPEN:
            _OPEN.remove(self)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


_OPEN: list[Scratch] = []


def release(spark: SparkSession) -> None:
    """Removes the scratch tables of all operators that this session has run, and what they set; frames that read them must be done."""
    if spark.conf.get(_BATCH_KEY, _BATCH_DEFAULT) == str(BATCH_ROWS):
        spark.conf.set(_BATCH_KEY, _BATCH_DEFAULT)
    for scratch in [s for s in _OPEN if s.spark is spark]:
        scratch.close()


def worker_cache(name: str, make: Callable[[], object]):
    """A value kept for the life of a Python worker, across the tasks that it runs."""
    kept = sys.modules.setdefault("_sozgar_worker", types.ModuleType("_sozgar_worker"))
    if not hasattr(kept, name):
        setattr(kept, name, make())
    return getattr(kept, name)


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of each row; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in order, cut so that each piece holds about ``limit`` bytes of ``column`` or one row."""
    for batch in batches:
        lengths = [x or 0 for x in pa.compute.binary_length(batch.column(column)).to_pylist()]
        start, held = 0, 0
        for i, n in enumerate(lengths):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)
    give_back()


def quoted(name: str) -> str:
    """A column's name as Spark reads it, whatever signs it holds."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    return F.col(quoted(name))


def free_name(name: str, taken: list[str]) -> str:
    """A name that none of the caller's columns bears."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def boxed(df: DataFrame, name: str = "row") -> Column:
    """All columns of the caller's frame in one, so that their names meet no inner names."""
    return F.struct(*(column(c) for c in df.columns)).alias(name) if df.columns else F.lit(None).alias(name)


def unboxed(df: DataFrame, names: list[str], name: str = "row") -> list[Column]:
    """The caller's columns out of the box again."""
    return [F.col(name).getField(c).alias(c) for c in names]


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; null ids are not held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
