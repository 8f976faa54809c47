"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a folder of
    our own only where the session names none, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint that survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def body(text_col: str) -> Column:
    """The text as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(text_col), F.lit("")).cast("binary")


def held(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod


#: Spark's own limit on the bytes of an Arrow batch, and ours.
_BATCH_KEY, _BATCH_DEFAULT, _BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, "4m"


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches between the JVM and Python by bytes, as texts may be long and
    each running task holds a few of them on both sides. A session's own setting stays."""
    if (spark.conf.get(_BATCH_KEY, None) or "").rstrip("b") == str(_BATCH_DEFAULT):
        spark.conf.set(_BATCH_KEY, _BATCH)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release() -> None:
    """Give free memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """run, a function from Arrow batches to Arrow batches, giving its free memory back at
    the end of a task: workers live on, and several of them share an executor."""

    def tidied(batches):
        yield from run(batches)
        release()

    return tidied


class Scratch:
    """Tables written to the shared folder, until the block ends. What leaves the
    block must not read them: cut it first."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.count = spark, f"{checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}", 0
        self.places: dict[DataFrame, str] = {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self._delete(self.path)

    def _delete(self, place: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more, and the files of shuffles that are done:
        Spark deletes those only once the driver's garbage is collected."""
        for table in tables:
            self._delete(self.places.pop(table))
        self.spark._jvm.System.gc()

    def table(self, df: DataFrame) -> DataFrame:
        """df, written and read again."""
        self.count += 1
        path = f"{self.path}/{self.count}"
        df.write.option("compression", "zstd").parquet(path)
        found = self.spark.read.schema(df.schema).parquet(path)
        self.places[found] = path
        return found


class KeySet:
    """A Bloom filter of 64-bit keys, at most LIMIT bytes whatever their number.

    It only spares a shuffle what an exact join behind it would drop: a key that is
    in is never missed, and beyond the size limit more others pass.
    """

    LIMIT, WORDS, PER_KEY = 32 << 20, 1 << 10, 12

    def __init__(self, blocks: dict[int, bytes], count: int):
        empty = np.zeros(self.WORDS, np.uint64)
        self.bits = np.concatenate([np.frombuffer(blocks[i], np.uint64) if i in blocks else empty for i in range(count)])
        self.count = count

    @classmethod
    def _spots(cls, keys: np.ndarray, count: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """The block of each key, and its bits in the block."""
        x = keys.view(np.uint64) * np.uint64(0x9FB21C651E98DF25)
        x ^= x >> np.uint64(31)
        y = x * np.uint64(0xD6E8FEB86659FD93)
        y ^= y >> np.uint64(32)
        return (x % np.uint64(count)).astype(np.int64), [(y >> np.uint64(16 * i)) & np.uint64(64 * cls.WORDS - 1) for i in range(4)]

    @classmethod
    def of(cls, keys: DataFrame, column: str) -> KeySet:
        rows = keys.select(F.col(column).cast("long").alias("key"))
        bound = cls.LIMIT // (8 * cls.WORDS)
        count = int(min(bound, max(1, -(-rows.count() * cls.PER_KEY // (64 * cls.WORDS)))))

        @tidy
        def block(batches):
            for batch in batches:
                keys = batch.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(cls._spots(keys, count)[0]), batch.column(0)], names=["block", "key"])

        @tidy
        def fill(batches):
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                keys = batch.column(1).to_numpy(zero_copy_only=False)
                where, spots = cls._spots(keys, count)
                order = np.argsort(where, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(where[order])) + 1):
                    if len(part):
                        bits = held.setdefault(int(where[part[0]]), np.zeros(cls.WORDS, np.uint64))
                        for s in spots:
                            np.bitwise_or.at(bits, (s[part] >> np.uint64(6)).astype(np.int64), np.uint64(1) << (s[part] & np.uint64(63)))
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([b.tobytes() for b in held.values()])], names=["block", "bits"])

        found = rows.mapInArrow(block, "block long, key long").repartition("block").mapInArrow(fill, "block long, bits binary")
        # At most LIMIT bytes, by one job; an iterator would run one a partition.
        got = found.toArrow()
        return cls(dict(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True)), count)

    def has(self, keys: np.ndarray) -> np.ndarray:
        where, spots = self._spots(np.asarray(keys, np.int64), self.count)
        out = np.ones(len(keys), bool)
        for s in spots:
            word = self.bits[where * self.WORDS + (s >> np.uint64(6)).astype(np.int64)]
            out &= (word >> (s & np.uint64(63))) & np.uint64(1) == 1
        return out


def only(rows: DataFrame, known: KeySet) -> DataFrame:
    """The rows whose first column, a long, is in known."""
    shared = rows.sparkSession.sparkContext.broadcast(known)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.has(batch.column(0).to_numpy(zero_copy_only=False))))

    return rows.mapInArrow(run, rows.schema)


def among(keys: Column, known: KeySet, spark: SparkSession) -> Column:
    """Whether keys, longs, are in known. Only the keys go to Python, whatever else a row holds."""
    shared = spark.sparkContext.broadcast(known)

    @F.arrow_udf("boolean")
    def has(keys: pa.Array) -> pa.Array:
        return pa.array(shared.value.has(keys.to_numpy(zero_copy_only=False)))

    return has(keys)
