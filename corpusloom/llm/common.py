"""What several operators of this subpackage share: words, hashes, shared files, hot-key joins."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, in every operator here: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_SPACE = " \t\n\x0b\x0c\r"

#: At most this many groups can each hold more than one part in HOT_GROUPS of all rows.
HOT_GROUPS = 1000
#: Groups of fewer rows than this are never worth splitting off.
HOT_LEAST = 10_000


def hashed_words(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, the number of words of each text, and where each word starts.

    A word's hash is a polynomial over its bytes plus one: a difference of two sums over all bytes of all
    texts, divided by the power at which the word starts.
    Starts count bytes in the texts joined by newlines.
    """
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    inside = (raw != 32) & (raw - np.uint8(9) > 4)
    if lower:
        raw = raw + ((raw - np.uint8(65) < 26).view(np.uint8) << 5)
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.concatenate([[0], edges])
    starts, stops = edges[0::2], edges[1::2]  # the last byte is a newline, so every word stops
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64), np.empty(0, np.int64)
    power, inverse = (_POWERS, _INVERSES) if len(raw) <= len(_POWERS) else (_powers(_BASE, len(raw)), _powers(_BASE_INVERSE, len(raw)))
    with np.errstate(over="ignore"):
        value = np.multiply(raw + np.uint8(1), power[: len(raw)])  # UTF-8 has no byte 255
        total = np.cumsum(value, out=value)
        before = total[starts - 1]
        if starts[0] == 0:
            before[0] = 0
        h = mix((total[stops - 1] - before) * inverse[starts])
    ends = np.cumsum([len(t) + 1 for t in texts])
    return h, np.diff(np.searchsorted(starts, ends), prepend=0), starts.astype(np.int64, copy=False)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2 and so on, modulo 2^64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out, out=out)


#: For as many bytes as slices() gives at once, unless one text is longer.
_POWERS, _INVERSES = (_powers(b, (1 << 18) + 4096) for b in (_BASE, _BASE_INVERSE))
_FACTORS = [np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1) ^ (k << 7) | 1) & 0xFFFFFFFFFFFFFFFF) for k in range(64)]


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of n words (64 at most), from the words' own hashes."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = h[:m] * _FACTORS[0]
        for k in range(1, n):
            out += h[k : k + m] * _FACTORS[k]
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(29)
    return out


def frugal(run):
    """A mapInArrow function whose worker returns free memory to the system when a task ends.

    Workers serve stage after stage, and what an allocator keeps for later adds up beside the executor's heap.
    """

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # a system whose C library lacks it keeps the memory
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or, in local mode only, a new one where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="corpusloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Workspace:
    """Tables that one query writes into the shared folder to cut lineage.

    They outlive the call, because the frame that a query returns reads them lazily; they go
    when the interpreter ends, or earlier by drop().
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        self._count = 0
        atexit.register(self._forget)

    def _forget(self) -> None:
        try:
            if self.spark.sparkContext._jsc.sc().isStopped() is False:
                delete(self.spark, self.root)
        except Exception:  # noqa: BLE001  the session may be gone already
            pass

    def table(self, df: DataFrame, by: list[str] | None = None) -> DataFrame:
        """Write df and read it again; by: columns that become folders."""
        self._count += 1
        path = f"{self.root}/{self._count}"
        writer = df.write.mode("overwrite")
        with self._tidy():
            (writer.partitionBy(*by) if by else writer).parquet(path)
        schema = df.schema
        if by:
            schema = type(schema)([f for f in schema if f.name not in by] + [f for f in schema if f.name in by])
        out = self.spark.read.schema(schema).parquet(path)
        out._corpusloom_path = path
        return out

    @contextlib.contextmanager
    def _tidy(self):
        """Spark deletes the shuffle files of a step when the step has been written: nothing reads them again."""
        key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(key)
        self.spark.conf.set(key, "true")
        try:
            yield
        finally:
            self.spark.conf.set(key, before)

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for df in frames:
            if path := getattr(df, "_corpusloom_path", None):
                delete(self.spark, path)


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, least: int = HOT_LEAST) -> DataFrame:
    """rows joined to their group's one row in groups, whatever share of rows a group holds.

    groups carries in column size a lower bound of 0 and an upper bound on how many of the rows
    have its key. Groups above total / HOT_GROUPS number HOT_GROUPS at most, so they are broadcast
    with that proven bound; the rest shuffles, and no task gets more than about that share.
    """
    limit = max(least, total // HOT_GROUPS)
    if total <= limit:
        return rows.join(groups, keys)
    hot = groups.where(F.col(size) > limit)
    cold = groups.where(F.col(size) <= limit)
    few = F.broadcast(hot.select(*keys))
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(few, keys, "left_anti").join(cold, keys))


def short_batches(spark: SparkSession, rows: int = 2_500) -> None:
    """Arrow batches of at most `rows` rows and about 8 MB, and Parquet batches of 1,024 rows, in this session: texts are long, and a batch is held by Spark and by Python."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", 1 << 23), ("spark.sql.parquet.columnarReaderBatchSize", 1024)):
        now = spark.conf.get(key).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def slices(column, rows: int = 1000, most: int = 1 << 18):
    """(start, stop) of runs of a batch's texts: at most `rows` of them and about `most` bytes (arrays of that many bytes stay in caches), one text at least."""
    n = len(column)
    size = np.diff(np.frombuffer(column.buffers()[1], np.int32 if str(column.type) in ("string", "binary") else np.int64)[column.offset : column.offset + n + 1])
    total = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    a = 0
    while a < n:
        b = min(a + rows, max(a + 1, int(np.searchsorted(total, total[a] + most, side="right")) - 1))
        yield a, b
        a = b


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def ordered_ids(space: Workspace, ids: DataFrame) -> DataFrame | None:
    """None where the one column of ids holds integers; else (id, number): longs in the order of the ids, nulls left out."""
    name = ids.columns[0]
    if ids.schema[0].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        return None
    ids = ids.where(F.col(name).isNotNull()).select(F.col(name).alias("id")).distinct().orderBy("id")
    return space.table(ids.withColumn("number", F.monotonically_increasing_id()))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
